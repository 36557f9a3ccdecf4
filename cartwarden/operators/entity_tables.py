"""The entity tables of admitted events, typed by the contract's field table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import contract as C

#: Which table the events of a type are rows of.
TABLES = {
    "user_registered": "customers", "session_started": "sessions", "product_viewed": "product_views", "added_to_cart": "cart_items", "checkout_started": "checkouts", "order_created": "orders",
    "payment_completed": "payments", "payment_failed": "payments", "refund_requested": "refunds", "fraud_alert_created": "external_alerts",
}
_TYPES = {"money": "decimal(18,4)", "paid": "decimal(18,4)", "score": "decimal(18,4)", "count": "int", "number": "bigint", "time": "timestamp", "texts": "array<string>"}


def names() -> list[str]:
    return sorted(set(TABLES.values()))


def entity_table(admitted: DataFrame, name: str) -> DataFrame:
    """admitted(event_id, event_type, body = canonical JSON, ...) -> source_event_id and the payload's fields of a table's events.

    Payments hold both outcomes, with status and attempted_at. A field that a body lacks, or whose value doesn't fit the
    column, is null; money of more than four decimals doesn't fit. Rows of other types, null bodies included, are left out.
    """
    types = [t for t, table in TABLES.items() if table == name]
    if not types:
        raise ValueError(f"no entity table {name}")
    fields = list(dict.fromkeys(f for t in types for f in C.PAYLOADS[t].split()))

    def value(field: str) -> Column:
        text, kind = F.get_json_object("body", f"$.payload.{field}"), _TYPES.get(C.kind_of(field), "string")
        if kind == "timestamp":
            return F.try_to_timestamp(text)
        if kind == "array<string>":
            return F.from_json(text, kind)
        exact = text.try_cast(kind)
        return F.when(text.try_cast("decimal(38,18)") == exact, exact) if kind.startswith("decimal") else exact

    rows = admitted.where(F.col("event_type").isin(*types) & F.col("body").isNotNull())
    columns = [value(f).alias(f) for f in fields]
    if name == "payments":
        columns += [F.when(F.col("event_type") == "payment_completed", "completed").otherwise("failed").alias("status"), F.coalesce(value("completed_at"), value("failed_at")).alias("attempted_at")]
    return rows.select(F.col("event_id").alias("source_event_id"), *columns)
