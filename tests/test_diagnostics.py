"""Artifacts as files of unlike shape, summaries of samples against plain loops, recovery and phases on small cases."""

from __future__ import annotations

import json
import random
import statistics

from cartwarden.operators import diagnostics as D
from cartwarden.sources import artifacts as S


def test_scan_reads_files_of_unlike_shape(spark, tmp_path):
    orders = [r.o_totalprice for r in spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_totalprice").collect()]
    for phase in ("warm", "load"):
        (tmp_path / phase).mkdir()
        for n in range(6):
            body = {"summary": {"total": orders[n] * (2 if phase == "load" else 1)}, "deep": {"a": {"b": n}}, "on": n % 2 == 0}
            if n == 1:
                body["summary"]["total"] = str(body["summary"]["total"])  # a numeral in quotes is no number
            if n == 2:
                body["deep"] = [1, 2]
            (tmp_path / phase / f"rate_run{n}.json").write_text(json.dumps(body, indent=n))
    (tmp_path / "warm" / "rate_run9.json").write_text('{"summary": {')
    (tmp_path / "warm" / "rate_run10.json").write_text("")
    (tmp_path / "warm" / "notes.json").write_text("{}")
    files = S.scan(spark, f"{tmp_path}/*/*.json")
    states = sorted((r.phase or "", r.repeat_no if r.repeat_no is not None else -1, r.state) for r in files.collect())
    assert len(states) >= 14 and [s for s in states if s[2] != "ok"][0] == ("", -1, "unnamed") and ("warm", 9, "malformed") in states
    found = {(r.phase, r.metric): (r.n, r.median, r.lowest, r.highest) for r in S.repeat_statistics(S.metrics(files, {"total": "$.summary.total", "b": "$.deep.a.b", "on": "$.on", "none": "$.x.y"})).collect()}
    for phase, times in (("warm", 1), ("load", 2)):
        total = [orders[n] * times for n in (0, 2, 3, 4, 5)]
        assert found[phase, "total"] == (5, statistics.median(total), min(total), max(total))
        assert found[phase, "b"] == (5, 3.0, 0.0, 5.0) and found[phase, "on"] == (6, 0.5, 0.0, 1.0)
    assert {m for _, m in found} == {"total", "b", "on"}


def test_series_summary_equals_loops(spark):
    r = random.Random(8)
    rows = [
        (r.choice(["a", "b", None]), i, float(i), r.choice([0, 1, 3, None]), r.randint(0, 9), r.choice([None, {}, {"x": 1, "y": r.randint(0, 9)}, {"x": None, "z": 4}]), {"m": r.randint(0, 20)}, r.randint(0, 100))
        for i in range(300)
    ] + [("idle", 1, 1.0, 0, 5, {"x": 1}, {"m": 1}, 1), ("single", 1, 1.0, 2, 5, None, None, 7)]
    df = spark.createDataFrame(rows, "name string, place long, t double, active int, gauge int, waits map<string,int>, locks map<string,int>, done long").repartition(3)
    found = {x.name: x for x in D.series_summary(df, "name", ["place"], "t", "active", ["gauge"], ["waits"], ["locks"], ["done"]).collect()}
    assert set(found) == {"a", "b", None, "idle", "single"}
    for name, x in found.items():
        mine = [row for row in rows if row[0] == name]
        used = sorted((row for row in mine if row[3]), key=lambda row: row[1])
        assert (x.sample_count, x.considered_count) == (len(mine), len(used))
        assert x.gauge_max == max((row[4] for row in used), default=None)
        sums, peaks = {}, {}
        for row in used:
            for k, v in (row[5] or {}).items():
                if v is not None:
                    sums[k] = sums.get(k, 0) + v
            for k, v in (row[6] or {}).items():
                peaks[k] = max(peaks.get(k, 0), v)
        assert [(e.name, e.n) for e in x.waits_totals] == sorted(sums.items(), key=lambda kv: (-kv[1], kv[0]))
        assert [(e.name, e.n) for e in x.locks_peaks] == sorted(peaks.items(), key=lambda kv: (-kv[1], kv[0]))
        assert x.per_second == ((used[-1][7] - used[0][7]) / (used[-1][2] - used[0][2]) if len(used) > 1 else None)
    bare = D.series_summary(df, "name", ["place"], "t", "active", ["gauge"])
    assert bare.columns == ["name", "sample_count", "considered_count", "gauge_avg", "gauge_max", "per_second"] and bare.count() == 5
    assert D.series_summary(df.limit(0), "name", ["place"], "t", "active", ["gauge"], ["waits"]).count() == 0


def test_recovery(spark):
    rows = [("a", 0, 1.0), ("a", 10, 50.0), ("a", 12, 50.0), ("a", 20, 9.0), ("a", 30, 3.0), ("a", 40, 0.0), ("up", 0, 1.0), ("up", 5, 9.0), ("up", 9, 4.0), ("flat", 3, 2.0), (None, 1, 5.0), ("a", None, 99.0), ("a", 50, None)]
    found = {r.p: tuple(r)[1:] for r in D.recovery(spark.createDataFrame(rows, "p string, at long, value double"), "p", "at", "value").collect()}
    assert found == {"a": (1.0, 50.0, 10, 30, 49 / 20), "up": (1.0, 9.0, 5, None, None), "flat": (2.0, 2.0, 3, None, None), None: (5.0, 5.0, 1, None, None)}


def test_phases(spark):
    full = {"fraud_context": 3.0, "processed_events_insert": 1.0, "business_persistence": 2.0, "fraud_persistence": 4.0, "commit": 5.0, "pool_acquire": 0.5, "connection_release": 0.25, "transaction_total": 20.0}
    rows = [("full", s, v) for s, v in full.items()] + [("some", "commit", 2.0), ("some", "transaction_total", 5.0), ("some", "other", 9.0), ("bare", "transaction_total", 5.0), ("none", "business_persistence", 1.0), ("none", "commit", None)]
    found = {r.run: tuple(r)[1:] for r in D.phase_groups(spark.createDataFrame(rows, "run string, stage string, avg_ms double"), "run").collect()}
    assert found == {
        "full": (3.0, 7.0, 5.0, 0.5, 0.25, 20.0, 4.25), "some": (None, None, 2.0, None, None, 5.0, 3.0), "bare": (None, None, None, None, None, 5.0, None), "none": (None, 1.0, None, None, None, None, None),
    }
