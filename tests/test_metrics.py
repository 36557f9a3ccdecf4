"""Labelled series and alert rules against plain loops over every tick, and each rule to its firing."""

from __future__ import annotations

import math
import random
import re

import pytest

from cartwarden.operators import metrics as M

SCHEMA = "metric string, labels map<string,string>, at_us long, value double"
STEP, SECOND = 10_000_000, 1_000_000


def made(seed: int) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for job in ("a", "b"):
        for instance in "01":
            total, at = 0.0, 0
            for _ in range(120):
                at += r.randint(1, 25 * SECOND)  # uneven, with gaps
                total = 0.0 if r.random() < 0.05 else total + r.randint(0, 9)  # resets
                rows.append(("count", {"job": job, "instance": instance}, at, total))
                rows.append(("gauge", {"job": job, "instance": instance}, at + 1, float(r.randint(0, 5))))
    for le in ("1", "2", "5", "+Inf"):
        total, at = 0.0, 0
        for _ in range(80):
            at += 15 * SECOND
            total += {"1": 1, "2": 3, "5": 4, "+Inf": 4 if at < 600 * SECOND else 9}[le]
            rows.append(("took", {"le": le}, at, total))
    return rows


def by_loops(rows: list[tuple], e: M.Expression, lookback: int = 300 * SECOND) -> dict:
    series: dict[tuple, list] = {}
    for metric, labels, at, value in rows:
        labels = labels or {}
        s = e.selector
        ok = metric == s.metric and all(labels.get(k, "") == v for k, v in s.equal.items()) and all(labels.get(k, "") != v for k, v in s.unequal.items())
        ok = ok and all(re.fullmatch(p, labels.get(k, "")) for k, p in s.like.items()) and not any(re.fullmatch(p, labels.get(k, "")) for k, p in s.unlike.items())
        if ok:
            series.setdefault(tuple(sorted(labels.items())), []).append((at, value))
    found: dict = {}
    end = max((-(-at // STEP) for points in series.values() for at, _ in points), default=0)
    for tick in range(1, end + 1):
        now, groups = tick * STEP, {}
        for labels, points in series.items():
            points = sorted(set(points))
            back = lookback if e.take == "last" else e.window_s * SECOND
            inside = [i for i, (at, _) in enumerate(points) if now - back < at <= now]
            if not inside:
                continue
            if e.take == "last":
                value = points[inside[-1]][1]
            else:
                value = sum(0 if i == 0 else points[i][1] if points[i][1] < points[i - 1][1] else points[i][1] - points[i - 1][1] for i in inside) / e.window_s
            group = tuple(kv for kv in labels if (e.over is None and kv[0] != "le") or kv[0] in e.by)
            groups.setdefault(group, []).append((dict(labels), value))
        for group, values in groups.items():
            v = [x for _, x in values]
            if e.take == "quantile":
                counts = sorted((math.inf if l["le"] == "+Inf" else float(l["le"]), x) for l, x in values)
                rank = e.level * counts[-1][1]
                if not rank > 0:
                    continue
                i = next(i for i, (_, c) in enumerate(counts) if c >= rank * (1 - 1e-12))
                low, below = counts[i - 1] if i else (0.0, 0.0)
                found[group, tick] = low if counts[i][0] == math.inf else low + (counts[i][0] - low) * (rank - below) / (counts[i][1] - below)
            else:
                found[group, tick] = {"sum": sum(v), "max": max(v), "min": min(v), "avg": sum(v) / len(v), "count": len(v), None: v[0]}[e.over]
    return found


EXPRESSIONS = {
    "each": M.Expression(M.Selector("gauge"), over=None),
    "sum": M.Expression(M.Selector("gauge", {"job": "a"})),
    "max by": M.Expression(M.Selector("gauge", unequal={"instance": "1"}), over="max", by=("job",)),
    "avg": M.Expression(M.Selector("gauge", like={"job": "a|x"}), over="avg"),
    "count": M.Expression(M.Selector("gauge", unlike={"job": "a.*"}), over="count", by=("job", "none")),
    "rate": M.Expression(M.Selector("count"), "rate", 60, over="sum", by=("job",)),
    "each rate": M.Expression(M.Selector("count", {"absent": ""}), "rate", 300, over=None),
    "p95": M.Expression(M.Selector("took"), "quantile", 60),
    "p50": M.Expression(M.Selector("took"), "quantile", 120, level=0.5),
}


@pytest.mark.parametrize("chunk", [4096, 7])
def test_expressions_equal_loops(spark, monkeypatch, chunk):
    monkeypatch.setattr(M, "CHUNK", chunk)  # series cut into many chunks of ticks
    rows = made(3)
    odd = [(None, {"job": "a"}, 5, 1.0), ("gauge", {"job": "a"}, None, 1.0), ("gauge", {"job": "a"}, 5, None), ("gauge", None, 77 * SECOND, 3.0), ("other", {}, 9**15, 1.0), rows[0], rows[0], rows[1]]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(3)
    plain = [x for x in rows + odd if x[0] and x[2] is not None and x[3] is not None]
    found: dict = {}
    for r in M.evaluated(df, EXPRESSIONS, STEP).collect():
        found.setdefault(r.name, {})[tuple((g.key, g.value) for g in r.group), r.tick] = r.value
    for name, e in EXPRESSIONS.items():
        expected = by_loops(plain, e)
        got = {k: v for k, v in found[name].items() if k in expected or k[1] <= max(t for _, t in expected)}
        assert got.keys() == expected.keys(), name
        assert all(math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-12) for k, v in expected.items()), name


def test_folded_counts_groups(spark):
    rows = [("gauge", {"job": j, "instance": i}, 1, 1.0) for j, i in (("a", "0"), ("a", "1"), ("b", "0"))]
    values = M.evaluated(spark.createDataFrame(rows, SCHEMA), {"n": M.Expression(M.Selector("gauge"), over="count", by=("job",))}, STEP)
    assert [(r.tick, r.value) for r in M.folded(values, "count").collect()] == [(1, 2.0)]
    assert {(r.group[0].value, r.value) for r in M.folded(values, "max", ["job"]).collect()} == {("a", 2.0), ("b", 1.0)}


def test_every_rule_pends_and_fires(spark):
    def steady(metric, labels, value, until=40):
        return [(metric, labels, t * STEP, float(value(t))) for t in range(1, until + 1)]

    down = lambda a, b: lambda t: 0 if a <= t <= b else 1
    rows = (
        steady("up", {"job": "event-processor", "instance": "x"}, down(5, 11)) + steady("up", {"job": "event-processor", "instance": "y"}, down(5, 10)) + steady("up", {"job": "redis-exporter"}, down(3, 9))
        + steady("up", {"job": "postgres-exporter"}, lambda t: 1) + steady("database_healthy", {}, down(20, 26)) + steady("consumer_lag", {"partition": "0"}, lambda t: 60 if t > 10 else 0)
        + steady("consumer_lag", {"partition": "1"}, lambda t: 50 if t > 12 else 0) + steady("deliveries_total", {"result": "dlq"}, lambda t: t * 2) + steady("deliveries_total", {"result": "processed"}, lambda t: t * 100)
        + steady("outbox_pending", {}, lambda t: 21 if t < 10 else 0) + steady("outbox_oldest_seconds", {}, lambda t: 130 if 9 < t < 20 else 0)
        + steady("publications_total", {"result": "kafka_error"}, lambda t: t >= 8) + steady("publications_total", {"result": "published"}, lambda t: t)
        + [x for le, n in (("1", 1), ("2.5", 18), ("+Inf", 20)) for x in steady("handling_seconds_bucket", {"le": le}, lambda t, n=n: n * t)]
    )
    spans = M.alert_spans(M.rule_states(spark.createDataFrame(rows, SCHEMA), M.RULES, STEP), M.RULES, STEP).collect()
    found = {(r.rule, r.labels): (r.pending_us // STEP, r.firing_us and r.firing_us // STEP, r.last_us // STEP) for r in spans}
    assert found == {
        ("ProcessorDown", "instance=x,job=event-processor"): (5, 11, 11), ("ProcessorDown", "instance=y,job=event-processor"): (5, None, 10), ("RedisUnavailable", "job=redis-exporter"): (3, 9, 9),
        ("DatabaseUnavailable", ""): (20, 26, 26), ("HighConsumerLag", ""): (13, 25, 40), ("HighDLQRate", ""): (17, 23, 40), ("FraudOutboxBacklog", ""): (1, 13, 19), ("OutboxPublicationFailures", ""): (8, 14, 37),
        ("HighProcessingLatency", ""): (2, 14, 40),
    }
    assert {r.severity for r in spans if r.rule.endswith(("Down", "Unavailable"))} == {"critical"}


def test_empty_frames_and_wrong_rules(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert M.alert_spans(M.rule_states(empty, M.RULES, STEP), M.RULES, STEP).count() == 0
    with pytest.raises(ValueError):
        M.Expression(M.Selector("x"), "median")
    with pytest.raises(ValueError):
        M.evaluated(empty, {"x": M.Expression(M.Selector("x"), "rate", 61)}, STEP)
    with pytest.raises(ValueError):
        M.rule_states(empty, [M.RULES[0], M.RULES[0]], STEP)


def test_samples_judge_the_payments_once(spark):
    from cartwarden.plans import monitor_queries

    plan = monitor_queries.samples(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [event_id#") <= 2  # the probes of jobs and of the database; all else is read from tables made once
