"""The stream of records: ledger and dead letters against batch, over restarts; what a batch reads of a growing ledger."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cartwarden.operators import contract as C
from cartwarden.operators import records
from cartwarden.plans import ledger_queries, record_queries
from cartwarden.streaming import ingest, keyed, ledger

SF = "/root/testdata/sf0.001"


def run(spark, tmp_path, frames, **options):
    """Each frame is a file and a run of its own; the queries' last progress."""
    keyed.with_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    found = []
    try:
        for i, frame in enumerate(frames):
            frame.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
            query = ledger.ingest(ingest.read_records(spark, f"{tmp_path}/in/*"), f"{tmp_path}/ledger", f"{tmp_path}/dead", f"{tmp_path}/checkpoint", **options)
            query.awaitTermination()
            found.append([p for p in query.recentProgress if p["numInputRows"]])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    return found


def restyled(df, ids: bool = False):
    """The same events with other spacing, order of keys and offsets of times; with ids in braces, which headers don't match."""
    text = F.col("value").cast("string")
    text = F.regexp_replace(text, r'^\{(.*),"payload":(\{.*\})\}$', '{ "payload" : $2 ,\n $1 }')
    text = F.regexp_replace(text, r'(\d\d:\d\d:\d\d)Z"', '$1+00:00"')
    return df.withColumn("value", (F.regexp_replace(text, r'"(\w{8}-0000-4000-8000-\w{12})"', '"{$1}"') if ids else text).cast("binary"))


@pytest.fixture(scope="module")
def raw(spark):
    return record_queries.raw_records(spark, SF).orderBy("offset", "partition").limit(400).cache()


def test_canonical_form_ignores_style(spark, raw):
    sound = C.classify(raw).where("category is null").select(*raw.columns)
    assert sound.count() > 100
    both = C.with_canonical(sound).select("partition", "offset", F.col("body").alias("a")).join(C.with_canonical(restyled(sound, ids=True)).select("partition", "offset", F.col("body").alias("b"), "value"), ["partition", "offset"])
    rows = both.collect()
    assert all(r.a == r.b and bytes(r.value).decode() != r.b for r in rows)
    one = spark.createDataFrame([(bytearray(b'{"payload":{"b":"x","unit_price":12.50,"a":{"z":1,"y":[2,"\xc3\xa9"]},"amount":"1.50"},"event_time":"2024-01-01T01:00:00.120+01:00","event_id":"URN:UUID:{0000000A-0000-4000-8000-000000000001}","source":null}'),), (None,), (bytearray(b"[1]"),)], "value binary")
    found = [r.body for r in C.with_canonical(one).collect()]
    assert found == ['{"event_id":"0000000a-0000-4000-8000-000000000001","event_time":"2024-01-01T00:00:00.120000Z","payload":{"a":{"y":[2,"é"],"z":1},"amount":"1.50","b":"x","unit_price":"12.5"},"source":null}', None, None]


def test_stream_equals_batch_over_restarts(spark, raw, tmp_path):
    again = restyled(raw.where("offset % 7 = 0").withColumn("offset", F.col("offset") + 100_000))
    # other content under a known event_id, and another event at a used place
    other = raw.where("offset % 11 = 0").withColumn("offset", F.col("offset") + 200_000).withColumn("value", F.regexp_replace(F.col("value").cast("string"), '"amount":"', '"amount":"1').cast("binary"))
    run(spark, tmp_path, [raw, again, other])
    table = spark.read.schema(ledger.LEDGER).parquet(f"{tmp_path}/ledger")
    got = {(r.partition, r.offset): r.outcome for r in table.collect()}
    everything = raw.unionByName(again).unionByName(other)
    classified = C.classify(everything)
    sound = C.with_canonical(classified.where("category is null").select(*everything.columns))
    there = records.delivery_outcomes(sound.select("event_id", "content_hash", "topic", "partition", "offset"))
    assert got == {(r.partition, r.offset): r.outcome for r in there.collect()}
    assert {o for o in got.values()} == {"processed", "duplicate", "dlq"} and {o for (_, offset), o in got.items() if 100_000 <= offset < 200_000} == {"duplicate"}
    letters = spark.read.parquet(f"{tmp_path}/dead").groupBy("error_category").count().collect()
    count = {r.error_category: r["count"] for r in letters}
    assert count["database_integrity_error"] == sum(o == "dlq" for o in got.values())
    assert sum(count.values()) == classified.where("category is not null").count() + count["database_integrity_error"]


def test_places_are_unique_across_batches(spark, raw, tmp_path):
    first = raw.where("offset < 40")
    ids = F.regexp_replace(F.col("value").cast("string"), "00000008-0000", "00000018-0000").cast("binary")
    headers = F.transform("headers", lambda h: F.struct(h["key"].alias("key"), F.when(h["key"] == "event_id", F.regexp_replace(h["value"].cast("string"), "00000008-0000", "00000018-0000").cast("binary")).otherwise(h["value"]).alias("value")))
    clash = first.withColumn("value", ids).withColumn("headers", headers)
    run(spark, tmp_path, [first, clash, first], store=False)
    table = spark.read.schema(ledger.LEDGER).parquet(f"{tmp_path}/ledger")
    outcomes = {(r.batch_id, r.outcome): r.n for r in table.groupBy("batch_id", "outcome").agg(F.count("*").alias("n")).collect()}
    n = C.classify(first).where("category is null").count()
    assert outcomes == {(0, "processed"): n, (1, "dlq"): n, (2, "duplicate"): n} and n > 20  # a batch that is read again is no clash
    assert {r.body for r in table.collect()} == {"{}"}
    assert spark.read.parquet(f"{tmp_path}/dead").where("error_message = 'place of another event'").count() == n


def test_reads_of_a_batch_do_not_grow_with_the_ledger(spark, raw, tmp_path):
    sound = C.classify(raw).where("category is null").select(*raw.columns).limit(40).cache()

    def part(i: int, times: int):
        change = lambda text: F.regexp_replace(text, "00000008-0000", F.format_string("%08x-%04x", F.lit(8 + 16 * (i + 1)), "copy"))
        many = sound.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("offset", F.col("offset") + (i * 100 + F.col("copy")) * 10_000)
        headers = F.transform("headers", lambda h: F.struct(h["key"].alias("key"), F.when(h["key"] == "event_id", change(h["value"].cast("string")).cast("binary")).otherwise(h["value"]).alias("value")))
        return many.withColumn("value", change(F.col("value").cast("string")).cast("binary")).withColumn("headers", headers).drop("copy")

    seen = run(spark, tmp_path, [part(0, 1), part(1, 60), part(2, 1)])
    reads = [sum(p["stateOperators"][k]["customMetrics"]["rocksdbGetCount"] for p in run_ for k in range(2)) for run_ in seen]
    rows = [run_[-1]["stateOperators"][0]["numRowsTotal"] for run_ in seen]
    assert rows[2] > 50 * rows[0] and 0 < reads[2] <= 1.5 * reads[0] and reads[1] > 20 * reads[0]


def test_windowed_counts(spark, tmp_path):
    raw = record_queries.raw_records(spark, SF).where("value is not null")
    raw.coalesce(1).write.parquet(f"{tmp_path}/in")
    counts = ingest.windowed_counts(ingest.read_records(spark, f"{tmp_path}/in"), window="1 day")
    query = counts.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windowed").agg(F.sum("n")).first()[0] == raw.count()


def test_plain_bodies_are_sound_and_canonical(spark):
    """The pattern of a whole body holds for most sound records, whose text is then their canonical form, field by field."""
    raw = record_queries.raw_records(spark, SF)
    ready = C.parsed(raw).withColumn("text", F.col("__json").cast("string")).withColumn("canonical", C.canonical())
    held = ready.where(C.plain(F.col("text"))).select("text", "canonical").collect()
    assert len(held) > 0.5 * raw.count() and all(r.text == r.canonical for r in held)


def test_redeliveries_come_from_their_records_row(spark):
    """Records are made and classified once, not once a side of a union."""
    assert "Union" not in ledger_queries.redeliveries(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
