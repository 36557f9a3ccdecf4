"""Feature rows as of arrival: batch and stream against a plain loop over all pairs."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest

from cartwarden.operators import arrivals as R
from cartwarden.operators.fraud import FraudConfig

CFG = FraudConfig(newest=7, velocity_seconds=4000, failure_seconds=9000, country_seconds=20_000, history_days=1)


def make(n: int, customers: int, seed: int, late: float = 0.2, spread: int = 100) -> list[tuple]:
    """Rows in arrival order, some of them late or early by up to days, with repeated times."""
    r, rows = random.Random(seed), []
    for seq in range(n):
        at = seq * spread + (r.randint(-3 * 86_400, 86_400) if r.random() < late else 0)
        kind = r.choices(["payment", "view", "session"], [6, 3, 1])[0]
        pay = kind == "payment"
        pick = lambda *x: r.choice([*x, None]) if pay else None
        rows.append((r.randrange(customers), seq, kind, r.randrange(10**6), at // 300 * 300 * R.SECOND, pick("completed", "failed", "completed"), r.randint(1, 10**5) if pay else None, pick("USD", "EUR"), pick("d1", "d2", "d3"), pick("DE", "FR"), "DE", pick("a", "b")))
    return rows


def by_hand(rows: list[tuple], cfg: FraudConfig) -> list[tuple]:
    out = []
    for p in rows:
        if p[2] != "payment":
            continue
        mine = [h for h in rows if h[0] == p[0] and h[1] <= p[1]]
        newest = lambda hs: sorted(hs, key=lambda h: (-h[4], h[3]))[: cfg.newest]
        recent = newest([h for h in mine if h[2] == "payment" and p[4] - cfg.history_days * R.DAY <= h[4] <= p[4]])
        prior = newest([h for h in mine if h[2] == "payment" and h[4] < p[4]])
        within = lambda s: [h for h in recent if h[4] >= p[4] - s * R.SECOND]
        failed, done = [h for h in within(cfg.failure_seconds) if h[5] == "failed"], [h for h in prior if h[5] == "completed"]
        same = [h for h in done if h[7] == p[7] and p[7] is not None]
        session = max((h[4] for h in mine if h[2] == "session" and h[4] <= p[4]), default=None)
        start = p[4] - cfg.history_days * R.DAY if session is None else session
        count = lambda hs, i: len({h[i] for h in hs} - {None})
        out.append((
            p[3], p[0], p[1], p[4], p[5], p[6], *p[7:11], len(within(cfg.velocity_seconds)), len(failed), count(failed, 11), count(within(cfg.velocity_seconds), 8), count(within(cfg.country_seconds), 9), len(done),
            sum(h[5] == "failed" for h in prior), sum(h[6] for h in done) if done else None, len(same), sum(h[6] for h in same) if same else None, sorted({h[8] for h in done} - {None}), sorted({h[9] for h in done} - {None}),
            min(cfg.newest, sum(h[2] == "view" and start <= h[4] <= p[4] for h in mine)), None if session is None else (p[4] - session) // R.SECOND,
        ))
    return out


def key(row):
    return (row[2], row[0], str(row))


def raw(df):
    cents = lambda x: None if x is None else int(x * 100)
    names = [n for n in R.NAMES]
    back = {"cents": "amount", "spend_cents": "spend", "currency_cents": "currency_spend"}
    return sorted((tuple(cents(r[back[n]]) if n in back else r[n] for n in names) for r in df.collect()), key=key)


@pytest.mark.parametrize(("n", "customers", "block", "late"), [(900, 3, 64, 0.2), (900, 1, 32, 0.9), (700, 200, 4096, 0.2), (600, 1, 20, 0.0)])
def test_features_equal_all_pairs(spark, n, customers, block, late):
    rows = make(n, customers, n + block, late)
    df = spark.createDataFrame(rows, R.ARRIVAL).repartition(5)
    assert raw(R.arrival_features(df, CFG, block_rows=block)) == sorted(by_hand(rows, CFG), key=key)


def test_early_clock_and_ties(spark):
    """One payment from the far future arrives first; many rows share one time and one seq."""
    rows = [(1, 0, "payment", 5, 10**15, "completed", 100, "USD", "d", "DE", "DE", None)]
    rows += [(1, 1 + i // 3, "payment", i % 17, (i // 40) * R.SECOND, "completed", i + 1, "USD", f"d{i % 5}", "DE", "DE", None) for i in range(300)]
    rows += [(1, 500, "payment", 9, 10**15 + 1, "failed", 100, "EUR", None, None, None, "x")]
    df = spark.createDataFrame(rows, R.ARRIVAL)
    assert raw(R.arrival_features(df, CFG, block_rows=16)) == sorted(by_hand(rows, CFG), key=key)


def test_awkward_rows(spark):
    nothing = (None,) * 12
    rows = [nothing, (None, 1, "payment", 1, 1, *[None] * 7), (1, None, "payment", 1, 1, *[None] * 7), (1, 1, "payment", None, 1, *[None] * 7), (1, 1, None, 1, 1, *[None] * 7), (1, 1, "payment", 1, None, *[None] * 7)]
    good = [(1, 1, "payment", 1, 1, *[None] * 7), (1, 1, "payment", 1, 1, *[None] * 7), (1, 2, "other", 3, 1, *[None] * 7)]
    found = R.arrival_features(spark.createDataFrame([*rows, *good], R.ARRIVAL), CFG).collect()
    assert [(r.payment_id, r.attempts, r.spend, r.is_new_device, r.checkout_seconds) for r in found] == [(1, 2, None, False, None)] * 2
    assert R.arrival_features(spark.createDataFrame([], R.ARRIVAL), CFG).count() == 0


def test_hot_customer_is_several_tasks(spark):
    """60,000 rows of one customer: no task gets more than a few blocks of them, and late rows don't change that."""
    r, n = random.Random(1), 60_000
    df = spark.range(n).selectExpr(
        "1L as customer_id", "id as seq", "if(id % 7 = 0, 'view', 'payment') as kind", "id", "(id * 10 - if(pmod(xxhash64(id), 50) = 0, 2000000, 0)) * 1000000 as at_us", "'completed' as status", "100L as cents",
        "'USD' as currency", "string(id % 9) as device", "'DE' as country", "'DE' as home", "cast(null as string) as reason",
    )
    cfg = replace(CFG, newest=500)
    found = R.arrival_features(df, cfg)
    rows = found.where("seq between 59000 and 59400 or seq % 10000 = 1").collect()
    everything = sorted((x.at_us, x.id, x.seq) for x in df.where("kind = 'payment'").collect())
    assert found.count() == len(everything)
    for x in r.sample(rows, 40):
        prior = [e for e in everything if e[0] < x.at_us and e[2] <= x.seq]
        assert x.successes == min(500, len(prior)) and x.attempts == sum(e[2] <= x.seq and x.at_us - 4_000 * R.SECOND <= e[0] <= x.at_us for e in everything)


def test_customers_are_no_frames_of_their_own(spark):
    """What blocks need is found in runs of customers: a Python frame a customer cost more than its few cells."""
    from cartwarden.plans import arrival_queries

    plan = arrival_queries.history_features_bounded(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and plan.count("MapInArrow") == 2
