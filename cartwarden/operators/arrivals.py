"""Feature rows as of arrival: a payment sees what had arrived by then, and of that only the newest rows up to its own time.

Two orders rule a customer's history: arrival (seq) and event time. ``History`` holds one customer's rows by event time
while they arrive; the same class works in a stream, where it is a customer's state, and in batch. There a customer of
many rows is cut into blocks along event time, and a block gets, besides its own rows, the few earlier ones that any of
its payments can still see: the newest ``cfg.newest`` among what had arrived. Which blocks hold them is decided on counts
of (time block, arrival block) cells alone, so rows move once and no task holds a hot customer.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from decimal import Decimal
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .fraud import FraudConfig
from .records import SPAN, numbered

#: A customer's rows of all kinds; money in the smallest unit, times in microseconds.
ARRIVAL = "customer_id long, seq long, kind string, id long, at_us long, status string, cents long, currency string, device string, country string, home string, reason string"
FEATURES = (
    "payment_id long, customer_id long, seq long, at_us long, status string, cents long, currency string, device string, country string, home string, attempts long, failures long, failure_reasons int, devices int, countries int, "
    "successes long, prior_failures long, spend_cents long, currency_successes long, currency_cents long, known_devices array<string>, known_countries array<string>, views long, checkout_seconds long"
)
COLUMNS = [c.split()[0] for c in ARRIVAL.split(", ")]
NAMES = [c.split()[0] for c in FEATURES.split(", ")]
SECOND = 1_000_000
DAY = 86_400 * SECOND
_AT = itemgetter(0)


class History:
    """What has arrived of one customer: payments by (time, descending id, descending arrival), views and sessions by time."""

    def __init__(self, cfg: FraudConfig):
        self.cfg, self.payments, self.views, self.sessions, self.added = cfg, [], [], [], 0

    def add(self, row: tuple) -> None:
        _, _, kind, id_, at, status, cents, currency, device, country, _, reason = row
        if kind == "payment":
            self.added += 1
            insort(self.payments, (at, -id_, -self.added, status, cents, currency, device, country, reason), key=lambda r: r[:3])
        elif kind == "view":
            insort(self.views, at)
        elif kind == "session":
            insort(self.sessions, at)

    def features(self, row: tuple) -> tuple:
        """The feature row of a payment that has been added, as of now."""
        cfg = self.cfg
        customer, seq, _, id_, at, status, cents, currency, device, country, home, _ = row
        upto, before = bisect_right(self.payments, at, key=_AT), bisect_left(self.payments, at, key=_AT)
        recent = self.payments[max(bisect_left(self.payments, at - cfg.history_days * DAY, key=_AT), upto - cfg.newest) : upto]
        prior = self.payments[max(0, before - cfg.newest) : before]
        since = lambda seconds: recent[bisect_left(recent, at - seconds * SECOND, key=_AT) :]
        attempts, failed = since(cfg.velocity_seconds), [r for r in since(cfg.failure_seconds) if r[3] == "failed"]
        distinct = lambda rows, i: len({r[i] for r in rows if r[i] is not None})
        done = [r for r in prior if r[3] == "completed"]
        same = [r for r in done if r[5] is not None and r[5] == currency]
        k = bisect_right(self.sessions, at)
        session = self.sessions[k - 1] if k else None
        seen = bisect_right(self.views, at) - bisect_left(self.views, at - cfg.history_days * DAY if session is None else session)
        return (
            id_, customer, seq, at, status, cents, currency, device, country, home, len(attempts), len(failed), distinct(failed, 8), distinct(attempts, 6), distinct(since(cfg.country_seconds), 7),
            len(done), sum(r[3] == "failed" for r in prior), sum(r[4] or 0 for r in done) if done else None, len(same), sum(r[4] or 0 for r in same) if same else None,
            sorted({r[6] for r in done if r[6] is not None}), sorted({r[7] for r in done if r[7] is not None}), min(max(seen, 0), cfg.newest), None if session is None else (at - session) // SECOND,
        )

    def forget(self, before: int) -> None:
        """Drops what no payment at ``before`` or later can see: all but the newest rows below it."""
        for rows, keep, key in ((self.payments, self.cfg.newest, _AT), (self.views, self.cfg.newest, None), (self.sessions, 1, None)):
            del rows[: max(0, bisect_left(rows, before, key=key) - keep)]


def arrived(history: History, rows: list[tuple]) -> Iterator[tuple]:
    """Adds rows that arrive together (equal seq) and yields the features of the payments among them."""
    for row in rows:
        history.add(row)
    for row in rows:
        if row[2] == "payment":
            yield history.features(row)


def finished(features: DataFrame, *more: str) -> DataFrame:
    """Features with money as decimals, and the columns that compare the payment with what is known."""
    money = lambda c, kind: (F.col(c).cast("decimal(26,0)") / F.lit(Decimal(100))).cast(kind)
    return features.select(
        *[c for c in NAMES if "cents" not in c], money("cents", "decimal(18,2)").alias("amount"), money("spend_cents", "decimal(28,2)").alias("spend"), money("currency_cents", "decimal(28,2)").alias("currency_spend"),
        F.coalesce((F.size("known_devices") > 0) & ~F.array_contains("known_devices", F.col("device")), F.lit(False)).alias("is_new_device"),
        F.coalesce(F.col("country") != F.col("home"), F.lit(False)).alias("country_mismatch"), *more,
    )


def _needed(cells: list[tuple[str, int, int, int]], cfg: FraudConfig) -> list[tuple[str, int, int, int]]:
    """Of one customer's cells (kind, time, arrival, n) in order: which cells each time block needs of the blocks before it.

    A payment of arrival block a sees everything of earlier arrival blocks. Walking back over the time blocks that hold
    a kind, it needs them until those rows reach the kind's bound; the rows of its own arrival block come along. The
    result (kind, time, arrival = latest arrival block, block = who needs it) holds the most that any payment needs.
    """
    bounds = {"payment": cfg.newest, "view": cfg.newest, "session": 1}
    blocks: dict[str, dict[int, tuple[list[int], list[int]]]] = {kind: {} for kind in bounds}
    for kind, time, arrival, n in cells:
        if kind in blocks:
            arrivals, counts = blocks[kind].setdefault(time, ([], []))
            arrivals.append(arrival)
            counts.append(n + (counts[-1] if counts else 0))
    out: dict[tuple, int] = {}
    for kind, bound in bounds.items():
        times = list(blocks[kind])
        for time, (own, _) in blocks["payment"].items():
            for a in own:
                found, k = 0, bisect_left(times, time)
                while found < bound and k > 0:
                    k -= 1
                    t = times[k]
                    arrivals, counts = blocks[kind][t]
                    if arrivals[0] <= a:
                        out[kind, t, time] = max(out.get((kind, t, time), -1), a)
                    sure = bisect_left(arrivals, a)
                    found += counts[sure - 1] if sure else 0
    return [(kind, t, a, block) for (kind, t, block), a in out.items()]


def arrival_features(arrivals: DataFrame, cfg: FraudConfig = FraudConfig(), block_rows: int = 4096) -> DataFrame:
    """A feature row (FEATURES) for each payment among ``arrivals`` (ARRIVAL), of what had arrived by its seq.

    recent: rows with time in [at - history_days, at]; prior: time < at; each the newest ``cfg.newest`` by (time desc,
    id, seq), seq not above the payment's. Views count from the last session's start (else history_days back), at most
    ``cfg.newest``. Rows that repeat are rows of their own; equal seqs see each other; rows without customer, seq, id,
    kind or time are no history and get no features. A customer of at most ``block_rows`` rows is one task's sorted run,
    a larger one several; only rows of one and the same time are never parted. An empty table gives no rows.
    """
    whole = F.lit(True)
    for c in ("customer_id", "seq", "kind", "id", "at_us"):
        whole &= F.col(c).isNotNull()
    rows = arrivals.select(*COLUMNS).where(whole)
    hot = rows.groupBy("customer_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block_rows).select("customer_id")
    cold = rows.join(hot, "customer_id", "left_anti").withColumn("block", F.lit(0).cast("long")).withColumn("own", F.lit(True))
    many = rows.join(hot, "customer_id", "left_semi")
    many = numbered(many, "customer_id", ["seq", "id"], F.floor(F.col("seq") / SPAN), "arrival")
    many = numbered(many, "customer_id", ["at_us", "id"], F.floor(F.col("at_us") / DAY), "time")
    first = F.min("time").over(W.partitionBy("customer_id", "at_us"))
    many = many.withColumn("time", F.floor(first / block_rows)).withColumn("arrival", F.floor(F.col("arrival") / block_rows))
    cells = many.groupBy("customer_id", "kind", "time", "arrival").agg(F.count(F.lit(1)).alias("n"))

    def needed(batches):
        # customers are many and their cells few: plain lists from one sorted run, not a frame a customer
        customer, mine = None, []

        def told() -> list[tuple]:
            return [(customer, *r) for r in _needed(mine, cfg)]

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != customer:
                    out += told()
                    customer, mine = row[0], []
                mine.append(row[1:])
            yield _batch(out, _NEED)
        yield _batch(told(), _NEED)

    dealt_cells = cells.repartition("customer_id").sortWithinPartitions("customer_id", "kind", "time", "arrival")
    need = dealt_cells.mapInArrow(needed, "customer_id long, kind string, time long, latest long, block long")
    older = many.join(need, ["customer_id", "kind", "time"]).where(F.col("arrival") <= F.col("latest")).select(*COLUMNS, "block", F.lit(False).alias("own"))
    own = many.select(*COLUMNS, F.col("time").alias("block"), F.lit(True).alias("own"))
    dealt = cold.select(*COLUMNS, "block", "own").unionByName(own).unionByName(older)

    def work(batches):
        known, history, waiting = None, None, []

        def settle() -> list[tuple]:
            owned = {id(r) for r, own in waiting if own}
            rows = [r for r, _ in waiting]
            for r in rows:
                history.add(r)
            return [history.features(r) for r in rows if id(r) in owned and r[2] == "payment"]

        for batch in batches:
            out = []
            for *row, block, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = tuple(row)
                if known != (row[0], block) or (waiting and waiting[0][0][1] != row[1]):
                    if waiting:
                        out += settle()
                    waiting = []
                    if known != (row[0], block):
                        known, history = (row[0], block), History(cfg)
                waiting.append((row, own))
            yield _frame(out)
        if waiting:
            yield _frame(settle())

    sorted_ = dealt.repartition("customer_id", "block").sortWithinPartitions("customer_id", "block", "seq", "id", *[c for c in COLUMNS if c not in ("customer_id", "seq", "id")])
    return finished(sorted_.mapInArrow(work, FEATURES))


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in FEATURES.split(", ")])
_NEED = pa.schema([("customer_id", pa.int64()), ("kind", pa.string()), ("time", pa.int64()), ("latest", pa.int64()), ("block", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(rows, _SCHEMA)
