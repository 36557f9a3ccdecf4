"""State per customer and parking: streams in several runs against batch, batch against plain loops."""

from __future__ import annotations

import random
from dataclasses import replace
from functools import partial

import pytest
from pyspark.sql import functions as F

from cartwarden.operators import arrivals as R
from cartwarden.operators import parking as P
from cartwarden.streaming import keyed
from test_arrivals import CFG, make, raw

KINDS = ["customer", "cart", "order", "payment"]


def entities(n: int, seed: int) -> list[tuple]:
    r, out = random.Random(seed), []
    for i in range(n):
        kind = r.randrange(4)
        parents = [(KINDS[k], str(r.randrange(6))) for k in range(kind) if r.random() < 0.7]
        out.append((str(r.randrange(3)), KINDS[kind], str(r.randrange(8)), r.randrange(0, 6000), parents if parents or r.random() < 0.5 else None))
    return out


def by_hand(rows: list[tuple]) -> list[tuple]:
    """Kind by kind: when was each parent first admitted, and at which attempt did the last of them stand?"""
    admitted, out = {}, []
    for kind in KINDS:
        level = []
        for journey, k, id_, at, parents in rows:
            if k != kind:
                continue
            there = [admitted.get((journey, *p)) for p in parents or ()]
            for attempt, wait in enumerate((0, 500, 1500), 1):
                if all(t is not None and t <= at + wait for t in there):
                    level.append(((journey, kind, id_), at + wait))
                    out.append((journey, kind, id_, at, attempt, "admitted", at + wait, None))
                    break
            else:
                missing = min(f"{p[0]}:{p[1]}" for p, t in zip(parents, there, strict=True) if t is None or t > at + 1500)
                out.append((journey, kind, id_, at, 3, "dead_letter", at + 1500, missing))
        for name, t in level:
            admitted[name] = min(t, admitted.get(name, t))
    return sorted(out, key=str)


def test_parking_equals_loops(spark):
    rows = entities(400, 1)
    rows += rows[:20]
    found = sorted(map(tuple, P.park(spark.createDataFrame(rows, P.ENTITY), KINDS).collect()), key=str)
    assert found == by_hand(rows) and {r[4] for r in found} == {1, 2, 3} and any(r[5] == "dead_letter" for r in found)


def test_parking_of_awkward_rows(spark):
    rows = [(None, "customer", "1", 5, None), (None, "order", "1", 1, [("customer", "1")]), ("a", "customer", "1", None, None), ("a", None, "1", 1, None), ("a", "order", None, 1, None), ("a", "order", "2", 1, [("nothing", "7")])]
    found = sorted(map(tuple, P.park(spark.createDataFrame(rows, P.ENTITY), ["customer", "order"]).collect()), key=str)
    assert found == [("a", "order", "2", 1, 3, "dead_letter", 1501, "nothing:7"), (None, "customer", "1", 5, 1, "admitted", 5, None), (None, "order", "1", 1, 2, "admitted", 501, None)]
    assert P.park(spark.createDataFrame([], P.ENTITY), ["customer", "order"]).count() == 0
    with pytest.raises(ValueError):
        P.park(spark.createDataFrame([], P.ENTITY), ["order", "order"])


def runs(spark, tmp_path, frames, schema, make_stream) -> list[tuple]:
    """Each frame is a file and a run of its own from the same checkpoint; the rows of all runs."""
    keyed.with_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for i, frame in enumerate(frames):
            frame.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
            stream = make_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"))
            query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark.read.parquet(f"{tmp_path}/out")


def test_stream_of_features_equals_batch_over_restarts(spark, tmp_path):
    rows = make(450, 4, 9)
    df = spark.createDataFrame(rows, R.ARRIVAL).withColumn("arrived", F.timestamp_seconds(F.col("seq") * 10 + 1_000))
    frames = [df.where(f"seq >= {a} and seq < {b}") for a, b in ((0, 200), (200, 201), (201, 450))]
    found = runs(spark, tmp_path, frames, df.schema, lambda s: keyed.customer_features(s, CFG, lateness_days=30))
    assert raw(found) == raw(R.arrival_features(df, CFG)) and found.where("not exact").count() == 0


def test_stream_forgets_what_is_too_old_and_says_so(spark, tmp_path):
    day = R.DAY
    rows = [(1, i, "payment", i, i * day, "completed", 100, "USD", "d", "DE", "DE", None) for i in range(40)]
    rows += [(1, 40, "payment", 40, 2 * day, "completed", 1, "USD", "d", "DE", "DE", None), (1, 41, "payment", 41, 39 * day, "failed", 1, "USD", "d", "DE", "DE", None)]
    df = spark.createDataFrame(rows, R.ARRIVAL).withColumn("arrived", F.timestamp_seconds(F.col("seq") + 1_000))
    cfg = replace(CFG, newest=3)
    found = {r.payment_id: r for r in runs(spark, tmp_path, [df.where("seq < 40"), df.where("seq >= 40")], df.schema, lambda s: keyed.customer_features(s, cfg, lateness_days=2)).collect()}
    assert not found[40].exact and found[41].exact and found[41].successes == 3 and len(found) == 42


def test_stream_of_parking_equals_loops_over_restarts(spark, tmp_path):
    rows = sorted([(*r[:3], r[3] + 10**9, r[4]) for r in entities(150, 4)], key=lambda r: r[3])
    flush = [(str(j), "customer", "end", 10**9 + 60_000, None) for j in range(3)] + [(str(j), "customer", "last", 10**9 + 120_000, None) for j in range(3)]
    parts = [rows[:60], rows[60:100], rows[100:], flush[:3], flush[3:]]
    frames = [spark.createDataFrame(p, P.ENTITY) for p in parts]
    found = runs(spark, tmp_path, frames, frames[0].schema, partial(keyed.parked_stream, delay="2 seconds"))
    assert sorted((tuple(r) for r in found.where("id <> 'end' and id <> 'last'").collect()), key=str) == by_hand(rows)




def test_parking_moves_rows_once(spark):
    """Rows join their list's times; they are not grouped by their whole content, nor joined once a parent."""
    rows = [("j", "customer", "c", 0, []), *(("j", "order", f"o{i % 3}", 100, [("customer", "c")]) for i in range(6)), (None, "order", "x", 5, [None, ("customer", "c")])]
    parked = P.park(spark.createDataFrame(rows, P.ENTITY), ["customer", "order"])
    assert "__row" not in parked._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id, r.outcome, r.missing or "") for r in parked.collect()) == [("c", "admitted", ""), *[(f"o{i // 2}", "admitted", "") for i in range(6)], ("x", "dead_letter", "customer:c")]
