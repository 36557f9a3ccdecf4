"""State per customer in a stream: feature rows as records arrive, and children that wait for their parents.

Both are processors of transformWithState in event-time mode over the time of *arrival*, which never runs back, so a
record of an old event is no late record. State lives in RocksDB and is checkpointed with the stream: after a restart, or
when a batch is run again, every key goes on from the batch before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import arrivals as R
from ..operators import parking as P
from ..operators.fraud import FraudConfig

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that transformWithState needs; must precede the first stream of the session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _rows(frames) -> list[tuple]:
    """Plain Python values; pandas' NaN and NaT are nulls."""
    out = []
    for frame in frames:
        out += [tuple(None if pd.isna(v) else v for v in row) for row in frame.itertuples(index=False, name=None)]
    return out


class CustomerHistory(StatefulProcessor):
    """A customer's history as map state (kind, time, place of arrival) -> row; its features as payments arrive.

    Payments older than the newest time seen by more than the history and ``lateness_days`` have no exact row: the rows
    below that line are kept up to ``cfg.newest`` of each kind only, and ``exact`` is false. A customer of whom nothing
    arrives for ``idle_days`` is forgotten by a timer.
    """

    def __init__(self, cfg: FraudConfig, lateness_days: int, idle_days: int):
        self.cfg, self.slack, self.idle = cfg, (cfg.history_days + lateness_days) * R.DAY, idle_days * 86_400_000

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("rows", "kind string, at_us long, place long", "seq long, id long, status string, cents long, currency string, device string, country string, reason string")
        self.last = handle.getValueState("last", "newest long, place long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (customer,) = key
        newest, place, timer = self.last.get() if self.last.exists() else (None, 0, None)
        history, held = R.History(self.cfg), {}
        for k, v in sorted(self.kept.iterator(), key=lambda e: e[0][2]) if place else ():
            held[tuple(k)] = True
            history.add((customer, v[0], k[0], v[1], k[1], v[2], v[3], v[4], v[5], v[6], None, v[7]))
        batch = sorted((r for r in _rows(rows) if None not in (r[1], r[2], r[3], r[4])), key=lambda r: (r[1], r[3]))
        out, at = [], 0
        while at < len(batch):
            end = next((i for i in range(at, len(batch)) if batch[i][1] != batch[at][1]), len(batch))
            together = [tuple(int(v) if isinstance(v, float) else v for v in r[: len(R.COLUMNS)]) for r in batch[at:end]]
            floor = None if newest is None else newest - self.slack
            out += [(*f, floor is None or f[3] >= floor) for f in R.arrived(history, together)]
            for r in together:
                newest, place = max(newest or r[4], r[4]), place + 1
                self.kept.updateValue((r[2], r[4], place), (r[1], r[3], r[5], r[6], r[7], r[8], r[9], r[11]))
                held[r[2], r[4], place] = True
            at = end
        if newest is not None:
            self._forget(held, newest - self.slack)
            now = int(timerValues.getCurrentWatermarkInMs()) + self.idle
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now)
            self.last.update((newest, place, now))
        yield pd.DataFrame(out, columns=[*R.NAMES, "exact"])

    def _forget(self, held: dict, below: int) -> None:
        """Rows below the line that the newest below it make unreachable."""
        for kind, keep in (("payment", self.cfg.newest), ("view", self.cfg.newest), ("session", 1)):
            old = sorted(k for k in held if k[0] == kind and k[1] < below)
            for k in old[: max(0, len(old) - keep)]:
                self.kept.removeKey(k)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[2] == expiredTimerInfo.getExpiryTimeInMs():
            self.kept.clear()
            self.last.clear()
        yield pd.DataFrame([], columns=[*R.NAMES, "exact"])

    def close(self) -> None:
        pass


def customer_features(stream: DataFrame, cfg: FraudConfig = FraudConfig(), lateness_days: int = 7, idle_days: int = 400, delay: str = "1 minute") -> DataFrame:
    """A stream of arrivals (ARRIVAL and ``arrived``, a timestamp) -> a feature row for each payment, and ``exact``.

    Where every row is exact the result equals ``arrivals.arrival_features`` over all that has arrived. Rows of one
    customer in a batch are taken in order of seq; a later batch must not bring a smaller seq of a customer. Rows without
    a customer are left out.
    """
    known = stream.where("customer_id is not null").select(*R.COLUMNS, "arrived").withWatermark("arrived", delay)
    processor = CustomerHistory(cfg, lateness_days, idle_days)
    found = known.groupBy("customer_id").transformWithStateInPandas(processor, R.FEATURES + ", exact boolean", "Append", "EventTime")
    return R.finished(found, "exact")


class WaitingChildren(StatefulProcessor):
    """The entities of one journey: those admitted, and those that wait, with a timer for each next attempt."""

    def __init__(self, delays: tuple[int, ...]):
        self.delays = delays

    def init(self, handle) -> None:
        self.handle = handle
        self.admitted = handle.getMapState("admitted", "kind string, id string", "at long")
        self.waiting = handle.getMapState("waiting", "due long, place long", "attempt int, kind string, id string, arrived_ms long, parents array<struct<kind string, id string>>")
        self.place = handle.getValueState("place", "place long")

    def _run(self, key, arrivals: list[tuple], until: int | None) -> Iterator[tuple]:
        """Attempts in order of time, arrivals among them, up to ``until`` (or the last arrival)."""
        place = self.place.get()[0] if self.place.exists() else 0
        known: dict[tuple, int] = {tuple(k): v[0] for k, v in self.admitted.iterator()}
        queue = P.Attempts(self.delays, known)
        before = {tuple(k): v for k, v in self.waiting.iterator()}
        for (due, n), (attempt, kind, id_, arrived, parents) in sorted(before.items()):
            queue.put(due, n, attempt, P.Entity(kind, id_, arrived, tuple((p[0], p[1]) for p in parents)))
        for kind, id_, arrived, parents in arrivals:
            place += 1
            queue.put(arrived, place, 1, P.Entity(kind, id_, arrived, parents))
        before_known = set(known)
        for result in queue.run(until):
            yield (key, *result)
        after = {(due, n): (attempt, e.kind, e.id, e.arrived, [tuple(p) for p in e.parents]) for due, n, attempt, e in queue.left()}
        for k in before.keys() - after.keys():
            self.waiting.removeKey(k)
        for k in after.keys() - before.keys():
            self.waiting.updateValue(k, after[k])
            self.handle.registerTimer(k[0])
        for k in known.keys() - before_known:
            self.admitted.updateValue(k, (known[k],))
        self.place.update((place,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given = []
        for frame in rows:
            for r in frame.itertuples(index=False):
                parents = () if r.parents is None else tuple((p["kind"], p["id"]) for p in r.parents)
                given.append((r.kind, r.id, int(r.arrived_ms), parents))
        given.sort(key=lambda g: (g[2], g[0] or "", g[1] or ""))
        # what is due later than the watermark waits for its timer: rows of that time may still arrive
        yield pd.DataFrame(list(self._run(key[0], given, int(timerValues.getCurrentWatermarkInMs()))), columns=P.NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(list(self._run(key[0], [], int(timerValues.getCurrentWatermarkInMs()))), columns=P.NAMES)

    def close(self) -> None:
        pass


def parked_stream(stream: DataFrame, delays: tuple[int, ...] = P.DELAYS, delay: str = "1 second") -> DataFrame:
    """A stream of entities (journey, kind, id, arrived_ms, parents) -> each with its attempt and outcome once it is known.

    Equal to ``parking.park`` over all that has arrived, whatever the batches, as far as the watermark has come: an
    attempt is made when no row of its time or before can still arrive. Rows later than the watermark are left out.
    """
    timed = stream.where("kind is not null and id is not null and arrived_ms is not null").withColumn("arrived", F.timestamp_millis("arrived_ms")).withWatermark("arrived", delay)
    return timed.groupBy("journey").transformWithStateInPandas(WaitingChildren(delays), P.OUTCOME, "Append", "EventTime")
