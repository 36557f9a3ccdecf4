"""Alignment of two tokenizers over whole texts, with an inverted index of id pairs.

Tokens of both ends meet at common byte offsets; an A and a B token that end together are a link. Documents get a place
in a block of at most 4,096. For each block and id pair the index holds compressed document bitmaps, one for each bit of
the pair's number of links in a document (multiplicity planes): the planes OR-merged say which documents hold the pair,
and 2^j times the set bits of plane j, summed, how many links. Pairs' counts are summed over blocks, the postings take
them back to their blocks, and there each document's bits collect its scores. Links themselves are never shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .tokens import Encoder, _byte_letters, _Memo

#: Documents in a block, and the bytes of text after which it is closed whatever their number.
BLOCK, BLOCK_BYTES = 4096, 16 << 20
BITMAP = BLOCK // 8
#: Bytes of memory that remembered pieces of the second tokenizer may take.
REMEMBERED = 120 << 20
#: Rows of a batch that leaves a task.
ROWS = 16_384

ENTRIES = "block long, doc_id long, slot int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, planes array<binary>"


class SideA:
    """A byte-level BPE file of the tokenizers library; encode(text) encodes a space and the text, all as plain text."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        self.encoder.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self.encoder.added = [t["content"] for t in made.get("added_tokens", []) if not t.get("special")]
        byte = {letter: b for b, letter in enumerate(_byte_letters())}
        entries = {i: token for token, i in made["model"]["vocab"].items()}
        self.bytes = [bytes(byte[c] for c in entries[i]) if i in entries and all(c in byte for c in entries[i]) else entries.get(i, "").encode() for i in range(max(entries) + 1)]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encoder.encode(" " + text), "<u4")


class SideB:
    """A sentencepiece file; encode(text) is the library's.

    Where no piece of the vocabulary goes on after a space mark that follows another character, and the file normalises
    nothing, a merge never crosses from a character to a space after it, so pieces that start there are encoded once.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        byte = [re.fullmatch("<0x([0-9A-F]{2})>", p) if self.model.is_byte(i) else None for i, p in enumerate(pieces)]
        self.bytes = [bytes([int(b[1], 16)]) if b else p.replace("▁", " ").encode() for p, b in zip(pieces, byte, strict=True)]
        probe = "ﬁ  Å é　½ \t x "  # ligature, sign, combining accent, wide space, runs of spaces
        plain = b"".join(self.bytes[i] for i in self.model.encode(probe)) == (" " + probe).encode()
        self.by_piece = plain and not any(re.search("[^▁]▁", p) for p in pieces)
        self.known = _Memo(lambda piece: np.array(self.model.encode(piece), "<u4").tobytes(), REMEMBERED)
        self.known[""] = np.array([self.model.piece_to_id("▁")], "<u4").tobytes()  # a space at the end of a text

    def encode(self, text: str) -> np.ndarray:
        if not self.by_piece or "▁" in text or not text:
            return np.array(self.model.encode(text), "<u4")
        if "  " in text or text[:1] == " ":
            parts = re.split("(?<=[^ ]) ", text)
        else:
            parts = text.split(" ")
        return np.frombuffer(b"".join(map(self.known.__getitem__, parts)), "<u4")


class Aligner:
    """Both tokenizers, and the alignment of one text."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = SideA(path_a), SideB(path_b)
        self.size_a, self.size_b = (np.array([len(t) for t in side.bytes], np.int64) for side in (self.a, self.b))
        # what an id writes into the list of groups: within its side of the group, and at the end of it
        self.shown = [b"%d%c" % (i, end) for i in range(len(self.size_a)) for end in b",|"] + [b"%d%c" % (i, end) for i in range(len(self.size_b)) for end in b",;"]

    def align(self, text: str | None):
        """(A ids, B ids, linked A ids, linked B ids, sha256 of the groups), or None for a text without tokens."""
        if not text:
            return None
        whole, a, b = (" " + text).encode(), self.a.encode(text), self.b.encode(text)
        if b"".join(map(self.a.bytes.__getitem__, a.tolist())) != whole or b"".join(map(self.b.bytes.__getitem__, b.tolist())) != whole:
            return None
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.zeros(len(whole) + 1, bool)
        ends[end_a] = True
        last_b = np.flatnonzero(ends[end_b])  # of each group
        last_a = np.searchsorted(end_a, end_b[last_b])
        # the list of groups: each side's tokens of a group, then the other's
        count_a, count_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        groups = np.arange(len(last_a))
        place_a = np.arange(len(a)) + np.repeat(np.cumsum(count_b) - count_b, count_a)
        place_b = np.arange(len(b)) + np.repeat(np.cumsum(count_a), count_b)
        codes = np.empty(len(a) + len(b), np.int64)
        codes[place_a] = a.astype(np.int64) * 2
        codes[place_a[last_a]] += 1
        codes[place_b] = (b.astype(np.int64) + len(self.size_a)) * 2
        codes[place_b[last_b]] += 1
        listed = b"".join(map(self.shown.__getitem__, codes.tolist()))[:-1]
        return a, b, a[last_a], b[last_b], hashlib.sha256(listed).hexdigest(), len(groups)


@functools.cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process and pair of files."""
    return Aligner(path_a, path_b)


def make_planes(rows: np.ndarray, slots: np.ndarray, counts: np.ndarray, n_rows: int) -> pa.Array:
    """An array of binaries for each row: its planes' bitmaps, from (row, slot, count) sorted by row and slot.

    A bitmap of at most a sixteenth of the block is the list of its places, two bytes each, otherwise a bit for each.
    """
    kept_rows, kept_planes, sizes, chunks = [], [], [], []
    plane, left = 0, counts
    while True:
        on = np.flatnonzero((left >> plane) & 1)
        if len(on):
            at, n = np.unique(rows[on], return_counts=True)
            dense = n * 2 >= BITMAP
            body = slots[on].astype("<u2")
            starts = np.concatenate([[0], np.cumsum(n)])
            if dense.any():
                data, sparse_bytes = [], body.tobytes()
                before = 0
                for i in np.flatnonzero(dense):
                    data.append(sparse_bytes[2 * before : 2 * starts[i]])
                    bits = np.zeros(BLOCK, np.uint8)
                    bits[body[starts[i] : starts[i + 1]]] = 1
                    data.append(np.packbits(bits, bitorder="little").tobytes())
                    before = starts[i + 1]
                data.append(sparse_bytes[2 * before :])
                chunks.append(b"".join(data))
            else:
                chunks.append(body.tobytes())
            kept_rows.append(at)
            kept_planes.append(np.full(len(at), plane))
            sizes.append(np.where(dense, BITMAP, 2 * n))
        elif not (left >> plane).any():
            break
        plane += 1
    # planes up to a row's highest one, empty ones too, in the order of rows
    row, level, size = np.concatenate(kept_rows), np.concatenate(kept_planes), np.concatenate(sizes)
    high = np.zeros(n_rows, np.int64)
    np.maximum.at(high, row, level + 1)
    first = np.concatenate([[0], np.cumsum(high)])
    lengths, begins = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
    lengths[first[row] + level], begins[first[row] + level] = size, np.cumsum(size) - size
    store = np.frombuffer(b"".join(chunks), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    data = store[np.repeat(begins - offsets[:-1], lengths) + np.arange(offsets[-1])]
    values = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), values)


def read_planes(planes: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, count): for each row the documents of its planes OR-merged, and how often each holds the pair."""
    if not len(planes):
        return (np.zeros(0, np.int64),) * 3
    first = planes.offsets.to_numpy().astype(np.int64)
    values = planes.values
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None else np.zeros(0, np.uint8)
    first, used = first - first[0], slice(first[0], first[-1])
    starts, size = offsets[:-1][used], np.diff(offsets)[used]
    row = np.repeat(np.arange(len(planes)), np.diff(first))
    level = np.arange(len(row)) - np.repeat(first[:-1], np.diff(first))
    dense = size == BITMAP
    n = np.where(dense, 0, size // 2)
    # places of the short ones
    index = np.repeat(starts - 2 * (np.cumsum(n) - n), n) + 2 * np.arange(n.sum())
    slots = [data[index].astype(np.int64) | data[index + 1].astype(np.int64) << 8]
    rows, weights = [np.repeat(row, n)], [np.repeat(np.int64(1) << level, n)]
    if dense.any():
        bits = np.unpackbits(data[starts[dense][:, None] + np.arange(BITMAP)], axis=1, bitorder="little")
        at, slot = np.nonzero(bits)
        rows.append(row[dense][at])
        slots.append(slot)
        weights.append((np.int64(1) << level[dense])[at])
    rows, slots, weights = np.concatenate(rows), np.concatenate(slots), np.concatenate(weights)
    if level.any():  # the planes of a row meet
        keys = rows * BLOCK + slots
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        begins = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[begins] // BLOCK, keys[begins] % BLOCK, np.add.reduceat(weights[order], begins)
    return rows, slots, weights


def index_entries(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The alignment of every document (rows without a pair) and the postings of its block (rows with one), written."""
    entries = pa.schema([
        ("block", pa.int64()), ("doc_id", pa.int64()), ("slot", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pair", pa.int64()), ("planes", pa.list_(pa.binary())),
    ])

    def batch(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in entries], schema=entries)

    def work(batches):
        both = aligner(path_a, path_b)
        block, rows, pairs, size = TaskContext.get().partitionId() << 32, [], [], 0

        def closed():
            names = ("doc_id", "slot", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
            yield batch(block=[block] * len(rows), **dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
            if not any(len(p) for p in pairs):
                return
            keys = np.concatenate([p * BLOCK + i for i, p in enumerate(pairs)])
            keys.sort()
            begins = np.flatnonzero(np.diff(keys, prepend=-1))
            counts, keys = np.diff(np.append(begins, len(keys))), keys[begins]
            pair, slot = keys // BLOCK, keys % BLOCK
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            distinct, bounds = pair[first], np.append(first, len(pair))
            for at in range(0, len(distinct), ROWS):
                some = slice(bounds[at], bounds[min(at + ROWS, len(distinct))])
                ids = distinct[at : at + ROWS]
                yield batch(block=np.full(len(ids), block), pair=ids, planes=make_planes(np.searchsorted(ids, pair[some]), slot[some], counts[some], len(ids)))

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                found = both.align(text)
                if found is None:
                    rows.append((doc_id, len(rows), 0, 0, 0, 0, ""))
                    pairs.append(np.zeros(0, np.int64))
                else:
                    a, b_ids, link_a, link_b, digest, groups = found
                    rows.append((doc_id, len(rows), len(a), len(b_ids), groups, len(link_a), digest))
                    pairs.append(link_a.astype(np.int64) << 24 | link_b)
                size += len(text or "")
                if len(rows) == BLOCK or size >= BLOCK_BYTES:
                    yield from closed()
                    block, rows, pairs, size = block + 1, [], [], 0
        if rows:
            yield from closed()

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, ENTRIES), "pair-index")


def pair_counts(entries: DataFrame) -> DataFrame:
    """(pair, n_docs, n_links, best): over all blocks' postings; best where no other pair of its B id has more links."""

    def work(batches):
        for batch in batches:
            row, _, count = read_planes(_planes(batch.column(1)))
            n = batch.num_rows
            links = np.zeros(n, np.int64)
            np.add.at(links, row, count)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(row, minlength=n).astype(np.int64)), pa.array(links)], ["pair", "n_docs", "n_links"])

    parts = entries.where("pair is not null").select("pair", "planes").mapInArrow(work, "pair long, n_docs long, n_links long")
    counts = parts.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 24) - 1)))  # at most one row for each id of A
    return counts.withColumn("best", F.col("n_links") == F.max("n_links").over(of_b))


def _planes(column: pa.Array) -> pa.ListArray:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row a document: its tokens and links under both tokenizers, and how common its links are in the corpus.

    doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair's count is the highest of its B id, ties included),
    count_sum (pairs' counts over all links), groups_sha256. A text that is null or empty, or that one of the tokenizers
    doesn't give back as it was, has no tokens: zeros and ''. Repeated rows and null ids are documents of their own;
    texts of any length are encoded whole; other columns are dropped; an empty table gives no rows.
    """
    entries = index_entries(docs, path_a, path_b)
    counts = written(pair_counts(entries), "pair-counts")
    scored = entries.where("pair is not null").select("block", "pair", "planes").join(counts.select("pair", "n_links", "best"), "pair")

    def collect(batches):
        block, best, total, held = None, None, None, None

        def ready():
            at = np.flatnonzero(held)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(at.astype(np.int32)), pa.array(best[at]), pa.array(total[at])], ["block", "slot", "n_best", "count_sum"])

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            row, slot, count = read_planes(_planes(batch.column(1)))
            links, top = batch.column(2).to_numpy()[row], batch.column(3).to_numpy(zero_copy_only=False)[row]
            changes = np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1)) if len(blocks) else []
            order = np.argsort(row, kind="stable")
            row, slot, count, links, top = row[order], slot[order], count[order], links[order], top[order]
            for begin, end in zip(changes, [*changes[1:], len(blocks)], strict=True):
                if block != int(blocks[begin]):
                    if block is not None:
                        yield ready()
                    block, best, total, held = int(blocks[begin]), np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64), np.zeros(BLOCK, bool)
                some = slice(*np.searchsorted(row, [begin, end]))
                held[slot[some]] = True
                np.add.at(best, slot[some], count[some] * top[some])
                np.add.at(total, slot[some], count[some] * links[some])
        if block is not None:
            yield ready()

    by_block = scored.select("block", "planes", "n_links", "best").repartition("block").sortWithinPartitions("block")
    scores = by_block.mapInArrow(collect, "block long, slot int, n_best long, count_sum long")
    found = entries.where("pair is null").drop("pair", "planes").join(scores, ["block", "slot"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
