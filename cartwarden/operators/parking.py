"""Children that arrive before their parents: judged again after waits, dead letters after the last attempt."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Waits between attempts in milliseconds: three attempts.
DELAYS = (500, 1000)
ENTITY = "journey string, kind string, id string, arrived_ms long, parents array<struct<kind:string,id:string>>"
OUTCOME = "journey string, kind string, id string, arrived_ms long, attempt int, outcome string, decided_ms long, missing string"
NAMES = [c.split()[0] for c in OUTCOME.split(", ")]


class Entity(NamedTuple):
    kind: str
    id: str
    arrived: int
    parents: tuple[tuple[str, str], ...]


class Attempts:
    """Attempts of one journey in order of time. ``known``: (kind, id) -> when it was first admitted; grows."""

    def __init__(self, delays: tuple[int, ...], known: dict[tuple[str, str], int]):
        self.delays, self.known, self.queue = delays, known, []

    def put(self, due: int, place: int, attempt: int, entity: Entity) -> None:
        heapq.heappush(self.queue, (due, place, attempt, entity))

    def left(self) -> list[tuple[int, int, int, Entity]]:
        return self.queue

    def run(self, until: int | None = None) -> Iterator[tuple]:
        """Decides all that is due by ``until``; attempts of one time see each other's admissions, in any order."""
        while self.queue and (until is None or self.queue[0][0] <= until):
            now, together = self.queue[0][0], []
            while self.queue and self.queue[0][0] == now:
                together.append(heapq.heappop(self.queue))
            changed = True
            while changed:
                ready = [a for a in together if all(p in self.known for p in a[3].parents)]
                changed = bool(ready)
                for _, _, attempt, e in ready:
                    self.known.setdefault((e.kind, e.id), now)
                    yield e.kind, e.id, e.arrived, attempt, "admitted", now, None
                together = [a for a in together if a not in ready] if ready else together
            for _, place, attempt, e in together:
                if attempt <= len(self.delays):
                    self.put(now + self.delays[attempt - 1], place, attempt + 1, e)
                else:
                    missing = min(f"{k}:{i}" for k, i in e.parents if (k, i) not in self.known)
                    yield e.kind, e.id, e.arrived, attempt, "dead_letter", now, missing


def park(entities: DataFrame, order: list[str], delays: tuple[int, ...] = DELAYS) -> DataFrame:
    """entities (ENTITY) with attempt, outcome (admitted, dead_letter), decided_ms and missing (the least parent that never came in time).

    ``order`` lists the kinds so that parents stand before their children; it may hold no others. An entity is admitted
    at its first attempt by which all its parents have been admitted (in its journey, at the same time at the latest),
    else it is a dead letter and so never a parent. The first admitted row of an id is its parent row; repeated rows are
    judged each. A null or empty parents list waits for nothing; rows without kind, id or time are left out, a null
    journey is one of its own. Two joins for each kind below the first: lists of parents, each once a journey, with the
    parents' earliest admissions, and rows with their list's times, so a parent of very many children meets them as one
    row against a side that Spark may split.
    """
    if len(set(order)) < len(order):
        raise ValueError("kinds repeat")
    waits = [0]
    for d in delays:
        waits.append(waits[-1] + d)
    # a journey as a struct: equal where both are null, so that one shuffle serves grouping and join
    rows = entities.where("id is not null and arrived_ms is not null").select(F.struct("journey").alias("journey"), "kind", "id", "arrived_ms", F.coalesce("parents", F.array().cast("array<struct<kind:string,id:string>>")).alias("parents"))
    admitted, out = None, None
    for kind in order:
        mine = rows.where(F.col("kind") == kind)
        if admitted is None:
            came = mine.withColumn("__times", F.when(F.size("parents") > 0, F.transform("parents", lambda p: F.struct(F.lit(None).cast("long").alias("at"), F.concat(p["kind"], F.lit(":"), p["id"]).alias("of")))))
        else:
            # children of the same parents are judged by one row of times; rows themselves move once, whatever their parents
            each = mine.select("journey", "parents").distinct().select("journey", "parents", F.explode("parents").alias("p")).alias("c")
            met = each.join(admitted.alias("a"), (F.col("c.p.kind") == F.col("a.kind")) & (F.col("c.p.id") == F.col("a.id")) & (F.col("c.journey") == F.col("a.journey")), "left")
            time = F.struct(F.col("a.decided_ms").alias("at"), F.concat(F.col("c.p.kind"), F.lit(":"), F.col("c.p.id")).alias("of"))
            found = met.groupBy(F.col("c.journey").alias("journey"), F.col("c.parents").alias("parents")).agg(F.collect_set(F.when(F.col("c.p").isNotNull(), time)).alias("__times"))
            came = mine.join(found, ["journey", "parents"], "left")
        times = F.coalesce(F.col("__times"), F.array().cast("array<struct<at:bigint,of:string>>"))
        came = came.withColumn("__times", times)
        # the first attempt by which all parents were there
        tries = [(k + 1, F.col("arrived_ms") + w) for k, w in enumerate(waits)]
        fits = lambda at: F.forall("__times", lambda t: t["at"].isNotNull() & (t["at"] <= at))
        attempt = F.coalesce(*[F.when(fits(at), F.lit(k)) for k, at in tries])
        judged = came.withColumn("__attempt", attempt).select(
            "journey", "kind", "id", "arrived_ms", F.coalesce("__attempt", F.lit(len(waits))).cast("int").alias("attempt"), F.when(F.col("__attempt").isNotNull(), "admitted").otherwise("dead_letter").alias("outcome"),
            F.coalesce(*[F.when(F.col("__attempt") == k, at) for k, at in tries], tries[-1][1]).alias("decided_ms"),
            F.when(F.col("__attempt").isNull(), F.array_min(F.transform(F.filter("__times", lambda t: t["at"].isNull() | (t["at"] > tries[-1][1])), lambda t: t["of"]))).alias("missing"),
        )
        parents = judged.where("outcome = 'admitted'").groupBy("journey", "kind", "id").agg(F.min("decided_ms").alias("decided_ms"))
        admitted = parents if admitted is None else admitted.unionByName(parents)
        out = judged if out is None else out.unionByName(judged)
    return out.withColumn("journey", F.col("journey.journey"))
