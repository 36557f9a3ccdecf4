"""The ledger of admitted events in a stream: known ids and used places are keyed state, looked up row by row.

RocksDB answers a lookup by key through its own Bloom filters, and its changes are what a batch writes, so neither the
reads nor the writes of a batch grow with the ledger. Two keyed steps follow each other: who owns a place (topic,
partition, offset), then which delivery of an event was the first. What they decide is written by batch, and a batch that
is run again starts from the state before it and overwrites its own folders.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators import contract as C

LEDGER = "event_id string, event_type string, content_hash string, body string, topic string, partition int, offset long, outcome string, batch_id long"
#: Neighbouring offsets that share a key of the places' state.
SPAN = 1024
_CARRIED = (
    "topic string, partition int, offset long, timestamp timestamp, key binary, value binary, headers array<struct<key string, value binary>>, category string, message string, event_id_hint string, event_type_hint string, "
    "correlation_id_hint string, anomaly string, event_id string, event_type string, body string, content_hash string, fault string"
)
_OUT = _CARRIED + ", outcome string"
_NAMES = [c.split()[0] for c in _CARRIED.replace("struct<key string, value binary>", "x").split(", ")]


def _row(r: Row, **changes) -> Row:
    """The carried columns in order, some of them changed or added."""
    return Row(**{n: r[n] for n in _NAMES} | changes)


def _order(r: Row) -> tuple:
    return (r.topic or "", r.partition is not None, r.partition or 0, r.offset is not None, r.offset or 0, r.event_id or "", r.content_hash or "")


class PlaceOwners(StatefulProcessor):
    """A place belongs to the event that was there first (of one batch: the least event_id); others there are faults."""

    def init(self, handle) -> None:
        self.owners = handle.getMapState("owners", "offset long", "event_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        by_place: dict = {}
        for r in rows:
            by_place.setdefault(r.offset, []).append(r)
        for offset, there in by_place.items():
            sound = [r.event_id for r in there if r.category is None]
            if offset is None or not sound:
                yield from map(_row, there)
                continue
            known = self.owners.getValue((offset,)) if self.owners.containsKey((offset,)) else None
            owner = known[0] if known else min(sound)
            if not known:
                self.owners.updateValue((offset,), (owner,))
            for r in there:
                yield _row(r) if r.category is not None or r.event_id == owner else _row(r, fault="place of another event")

    def close(self) -> None:
        pass


class FirstDeliveries(StatefulProcessor):
    """The first delivery of an event is processed, later ones of its content are duplicates, others are faults."""

    def init(self, handle) -> None:
        self.first = handle.getValueState("first", "content_hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.first.get()[0] if key[0] is not None and self.first.exists() else None
        before = known
        for r in sorted(rows, key=_order):
            fault = r.fault
            if r.category is not None:
                outcome = None
            elif fault is not None:
                outcome = "dlq"
            elif known is None:
                known, outcome = r.content_hash, "processed"
            elif known == r.content_hash:
                outcome = "duplicate"
            else:
                outcome, fault = "dlq", "event_id of other content"
            yield _row(r, fault=fault, outcome=outcome)
        if known is not None and before is None:
            self.first.update((known,))

    def close(self) -> None:
        pass


def admitted(stream: DataFrame, store: bool = True) -> DataFrame:
    """A stream of raw records -> each with its category (bad ones) or event_id, canonical body, its hash, outcome and fault.

    Bad records keep no state: each is a key of its own. Null places own nothing.
    """
    checked = C.with_canonical(C.classify(stream), store).withColumn("fault", F.lit(None).cast("string"))
    sound = F.col("category").isNull()
    own = F.concat_ws(":", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    rows = checked.select(*_NAMES)
    slot = F.when(sound, F.concat_ws(":", "topic", F.col("partition").cast("string"), F.floor(F.col("offset") / SPAN).cast("string"))).otherwise(own)
    placed = rows.withColumn("slot", slot).groupBy("slot").transformWithState(PlaceOwners(), _CARRIED, "Append", "None")
    event = F.when(sound, F.col("event_id"))
    keyed = placed.withColumn("event", event).withColumn("bad", F.when(event.isNull(), own))
    return keyed.groupBy("event", "bad").transformWithState(FirstDeliveries(), _OUT, "Append", "None")


def ingest(stream: DataFrame, ledger: str, dead: str, checkpoint: str, store: bool = True, group: str = "processor") -> StreamingQuery:
    """Runs what is available: outcomes of sound records to the ledger, bad and conflicting ones to the dead letters.

    A conflict (other content under a known event_id, another event's place) is in both: as outcome dlq, and as a letter
    of category database_integrity_error. The session needs the RocksDB state store (``keyed.with_rocksdb``). With
    ``store`` false the ledger keeps {} in place of the bodies.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        clock = datetime.now(timezone.utc)
        rows = batch.persist()  # else both outputs would run the keyed steps
        try:
            sound = rows.where("category is null").select(*[c.split()[0] for c in LEDGER.split(", ")[:-1]])
            sound.write.mode("overwrite").parquet(f"{ledger}/batch_id={batch_id}")
            conflict = F.col("outcome") == "dlq"
            kept = rows.where(F.col("category").isNotNull() | conflict)
            named = kept.withColumn("message", F.coalesce("message", "fault")).withColumn("category", F.coalesce("category", F.lit("database_integrity_error")))
            letters = C.dead_letters(named, failed_at=F.lit(clock).cast("timestamp"), group=group)
            letters.write.mode("overwrite").parquet(f"{dead}/batch_id={batch_id}")
        finally:
            rows.unpersist()

    return admitted(stream, store).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
