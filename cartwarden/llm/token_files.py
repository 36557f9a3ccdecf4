"""Token-id files with a minimal perfect hash index.

Layout below a root folder (any file system that pyarrow and Spark both reach):

* ``ids/ids-<shard>-<attempt>.bin``: 8 bytes b"CWIDS" + width + two zeros, then the raw little-endian ids (2 or 4 bytes
  each) of one shard's documents in ascending doc_id order, shards ascending too;
* ``directory``, ``shards``: Parquet tables that say which attempts count, and where shards and documents start;
* ``index``: Parquet, one row a segment of about 512 keys: the pilots of a hash-and-displace minimal perfect hash and
  its slots (fingerprint, shard, offset, length).

A file's name carries the task's attempt, and only attempts whose directory rows were committed are read, so retried
and speculative tasks do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import encoder

MAGIC = b"CWIDS"
HEADER = 8
#: Keys of an index segment on average, and keys of a bucket that share a pilot.
SEGMENT_KEYS, BUCKET_KEYS = 512, 4
#: Bytes of ids that a reader hands on at once.
BATCH_BYTES = 8 << 20
SLOT = np.dtype([("fingerprint", "<u8"), ("shard", "<i4"), ("offset", "<i8"), ("length", "<i8")])

_DIRECTORY = "doc_id string, ordinal long, shard int, attempt long, offset long, length long"


def _file(root: str, shard: int, attempt: int) -> tuple[pafs.FileSystem, str]:
    system, path = pafs.FileSystem.from_uri(f"{root}/ids/ids-{shard:06d}-{attempt}.bin")
    return system, path


def _write_shard(root: str, tokenizer: str, end_id: int, width: int):
    kind = f"<u{width}"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        encode, end = encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        out, offset, last, ordinal = None, 0, (), 0
        for batch in batches:
            if out is None:
                system, path = _file(root, shard, attempt)
                system.create_dir(path.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(path)
                out.write(MAGIC + bytes([width, 0, 0]))
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.frombuffer(encode(text) + end, "<u4")
                if width == 2 and ids.max() > 0xFFFF:
                    raise ValueError("an id does not fit in two bytes; use width 4")
                out.write(ids.astype(kind).tobytes())
                ordinal = ordinal + 1 if last == (key,) else 0
                last = (key,)
                rows.append((key, ordinal, shard, attempt, offset, len(ids)))
                offset += len(ids)
            yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "shard", "attempt", "offset", "length"])
        if out is not None:
            out.close()

    return write


def _mix(h: np.ndarray, g: np.ndarray, pilot: np.ndarray) -> np.ndarray:
    """Well mixed 64 bits from a key's two hashes and a pilot."""
    x = h ^ (pilot * np.uint64(0x9E3779B97F4A7C15) + g)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def build_hash(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pilots, slot of each key) of a minimal perfect hash over distinct key hashes (h, g)."""
    n = len(h)
    buckets = max(1, n // BUCKET_KEYS)
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    sizes = np.bincount(bucket, minlength=buckets)
    order = np.argsort(bucket, kind="stable")
    first = np.cumsum(sizes) - sizes
    pilots, slots, taken = np.zeros(buckets, np.uint32), np.zeros(n, np.int64), np.zeros(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        keys = order[first[b] : first[b] + sizes[b]]
        if not len(keys):
            break
        at, step = 0, 64
        while True:
            tried = np.arange(at, at + step, dtype=np.uint64)
            place = (_mix(h[keys][:, None], g[keys][:, None], tried[None, :]) % np.uint64(n)).astype(np.int64)
            fits = ~taken[place].any(axis=0)
            if len(keys) > 1:
                ranked = np.sort(place, axis=0)
                fits &= (ranked[1:] != ranked[:-1]).all(axis=0)
            if fits.any():
                pick = int(np.argmax(fits))
                break
            at, step = at + step, min(step * 4, 1 << 14)
            if at > 1 << 26:
                raise ValueError("two keys have the same hashes")
        pilots[b], slots[keys] = at + pick, place[:, pick]
        taken[place[:, pick]] = True
    return pilots, slots


def find_slots(pilots: np.ndarray, n: int, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The slot of each key, in constant time: one pilot, one mix. Absent keys get any slot."""
    pilot = pilots[(h % np.uint64(len(pilots))).astype(np.int64)].astype(np.uint64)
    return (_mix(h, g, pilot) % np.uint64(n)).astype(np.int64)


def _build_segment(rows: pd.DataFrame) -> pd.DataFrame:
    h, g = (rows[c].to_numpy().view(np.uint64) for c in ("h", "g"))
    pilots, slots = build_hash(h, g)
    table = np.zeros(len(rows), SLOT)
    for name, column in (("fingerprint", g), ("shard", rows["shard"]), ("offset", rows["offset"]), ("length", rows["length"])):
        table[name][slots] = column
    return pd.DataFrame({"segment": [rows["segment"].iloc[0]], "keys": [len(rows)], "pilots": [pilots.tobytes()], "slots": [table.tobytes()]})


def _look_up(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = keys[["doc_id", "ordinal"]].assign(shard=-1, offset=-1, length=-1)
    if len(keys) and len(index):
        h, g = (keys[c].to_numpy().view(np.uint64) for c in ("h", "g"))
        table = np.frombuffer(index["slots"].iloc[0], SLOT)
        got = table[find_slots(np.frombuffer(index["pilots"].iloc[0], np.uint32), len(table), h, g)]
        out = out.assign(**{c: got[c].astype(np.int64) for c in ("shard", "offset", "length")})[got["fingerprint"] == g]
    else:
        out = out[:0]
    return out


def _hashed(keys: DataFrame, segments: int) -> DataFrame:
    """h, g and the segment of keys(doc_id, ordinal)."""
    return (
        keys.withColumn("h", F.xxhash64("doc_id", "ordinal"))
        .withColumn("g", F.xxhash64("ordinal", F.lit("fingerprint"), "doc_id"))
        .withColumn("segment", F.pmod(F.xxhash64("h"), F.lit(segments)))
    )


def write_token_files(docs: DataFrame, root: str, tokenizer: str, end_id: int = 2, width: int = 2) -> None:
    """Writes docs(doc_id, text) below root; null texts count as empty, so they hold the end id alone.

    Shards are as many as the session's shuffle partitions, cut by ranges of (doc_id, place in the input), nulls
    first, so that a doc_id that a third of the rows share is cut as well. A key is (doc_id, ordinal): rows that repeat
    a doc_id are numbered from 0 in file order. An empty table gives empty tables and no id file.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("place"))
        .repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "place")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "place")
        .select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # pandas would make floats of longs among nulls
    )
    ranged.mapInPandas(_write_shard(root, tokenizer, end_id, width), _DIRECTORY).withColumn("doc_id", F.col("doc_id").cast("long")).write.parquet(f"{root}/directory")
    directory = spark.read.parquet(f"{root}/directory")
    # a row for each shard, as many as shuffle partitions: the driver chains them
    ends = (
        directory.groupBy("shard", "attempt")
        .agg(
            F.sum("length").alias("ids"),
            F.count("*").alias("docs"),
            F.min_by(F.struct("doc_id"), "offset").alias("first"),
            F.max_by(F.struct("doc_id"), "offset").alias("last"),
            F.max_by("ordinal", "offset").alias("last_ordinal"),
        )
        .orderBy("shard")
        .collect()
    )
    start, rows, before, carried = 0, [], None, 0
    for e in ends:
        base = carried if before is not None and before == e["first"] else 0
        rows.append((e["shard"], e["attempt"], start, e["ids"], e["docs"], e["first"]["doc_id"], base, width))
        start += e["ids"]
        carried = e["last_ordinal"] + 1 + (base if e["last"] == e["first"] else 0)
        before = e["last"]
    schema = "shard int, attempt long, start long, ids long, docs long, first_id long, first_ordinal long, width int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/shards")
    segments = max(1, sum(e["docs"] for e in ends) // SEGMENT_KEYS)
    known = spark.read.parquet(f"{root}/shards")
    more = F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.col("first_ordinal")).otherwise(0)
    keyed = directory.join(known.select("shard", "first_id", "first_ordinal"), "shard").withColumn("ordinal", F.col("ordinal") + more)
    (
        _hashed(keyed.select("doc_id", "ordinal", "shard", "offset", "length"), segments)
        .groupBy("segment")
        .applyInPandas(_build_segment, "segment long, keys long, pilots binary, slots binary")
        .withColumn("segments", F.lit(segments))
        .write.parquet(f"{root}/index")
    )


def look_up(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    """keys(doc_id, ordinal) -> (doc_id, ordinal, shard, offset, length) of those that the files hold."""
    index = spark.read.parquet(f"{root}/index")
    some = index.select("segments").first()
    hashed = _hashed(keys.select("doc_id", F.col("ordinal").cast("long").alias("ordinal")), some["segments"] if some else 1)
    return (
        hashed.withColumn("doc_id", F.col("doc_id").cast("string"))
        .groupBy("segment")
        .cogroup(index.drop("segments").groupBy("segment"))
        .applyInPandas(_look_up, "doc_id string, ordinal long, shard int, offset long, length long")
        .withColumn("doc_id", F.col("doc_id").cast("long"))
    )


def _read_ids(root: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, file, held, size = None, None, [], 0
        columns = ["doc_id", "ordinal", "start", "n_tokens", "ids"]
        for batch in batches:
            for row in batch.itertuples(index=False):
                if name != (row.shard, row.attempt):
                    name = (row.shard, row.attempt)
                    system, path = _file(root, *name)
                    file = system.open_input_file(path)
                    if file.read(HEADER) != MAGIC + bytes([row.width, 0, 0]):
                        raise ValueError(f"{path} is not a token file of width {row.width}")
                file.seek(HEADER + row.width * row.offset)
                ids = np.frombuffer(file.read(row.width * row.length), f"<u{row.width}").astype("<u4").tobytes()
                held.append((row.doc_id, row.ordinal, row.start + row.offset, len(ids) // 4, ids))
                size += len(ids)
                if size >= BATCH_BYTES:
                    yield pd.DataFrame(held, columns=columns)
                    held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=columns)

    return read


def read_token_files(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    """keys(doc_id, ordinal) -> (doc_id, ordinal, start, n_tokens, ids binary) of those that the files hold.

    Places come from the index; they are then sorted by shard and offset, so that each file is read forwards. ids are
    little-endian unsigned 32-bit, whatever the width on disk; start counts the ids of all documents before.
    """
    shards = spark.read.parquet(f"{root}/shards").select("shard", "attempt", "start", "width")
    placed = look_up(spark, root, keys).join(shards, "shard")
    return (
        placed.withColumn("doc_id", F.col("doc_id").cast("string"))
        .repartitionByRange("shard", "offset")
        .sortWithinPartitions("shard", "offset")
        .mapInPandas(_read_ids(root), "doc_id string, ordinal long, start long, n_tokens long, ids binary")
        .withColumn("doc_id", F.col("doc_id").cast("long"))
    )


def document_keys(docs: DataFrame) -> DataFrame:
    """The keys (doc_id, ordinal) of all rows of docs."""
    counts = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
    return counts.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("ordinal"))


