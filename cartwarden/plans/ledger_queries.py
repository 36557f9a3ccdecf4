"""Canonical bodies of the records, and redeliveries judged by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import kept
from ..operators import contract as C
from ..operators import entity_tables
from ..operators import records as R
from ..sources import adapters as A
from . import record_queries


def _sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = record_queries.raw_records(spark, sf_dir)
    return C.classify(raw).where("category is null").select(*raw.columns)


def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical JSON of every sound record, and its SHA-256."""
    return C.with_canonical(_sound(spark, sf_dir)).select("partition", "offset", "body", "content_hash")


def redeliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound records, and once more every tenth in another style: spaces, keys in another order, times with +00:00.

    Their offsets are 10^9 higher. Of those whose offset ends in 50 the content differs (produced_at), and those whose
    offset ends in 30 come at the place of the record before them.
    """
    sound = _sound(spark, sf_dir)
    text = F.col("value").cast("string")
    text = F.when(F.col("offset") % 100 == 50, F.regexp_replace(text, '"produced_at":"2', '"produced_at":"3')).otherwise(text)
    text = F.regexp_replace(F.regexp_replace(text, r'^\{(.*),"payload":(\{.*\})\}$', '{ "payload" : $2 ,\n $1 }'), r'(\d\d:\d\d:\d\d)Z"', '$1+00:00"')
    moved = F.when(F.col("offset") % 100 == 30, F.col("offset") - 1).otherwise(F.col("offset") + 1_000_000_000)
    # both deliveries come from one row: records are made and classified once
    first, again = F.struct("offset", "value"), F.struct(moved.alias("offset"), text.cast("binary").alias("value"))
    each = sound.withColumn("delivery", F.explode(F.when(F.col("offset") % 10 == 0, F.array(first, again)).otherwise(F.array(first))))
    return each.withColumns({"offset": F.col("delivery.offset"), "value": F.col("delivery.value")}).drop("delivery")


def redelivery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each delivery when content is the canonical form: style is no difference, places are one event's."""
    known = C.with_canonical(redeliveries(spark, sf_dir), store=False).select("event_id", "content_hash", "topic", "partition", "offset")
    return R.delivery_outcomes(kept(known, "redelivered")).drop("content_hash")  # read three times


def entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity tables that the sound records fill: rows, and the money in each."""
    known = kept(C.with_canonical(_sound(spark, sf_dir)).select("event_id", "event_type", "body"), "admitted", "event_type")  # each table reads its types
    money = {"cart_items": "unit_price", "checkouts": "total_amount", "orders": "total_amount", "payments": "amount", "refunds": "amount", "product_views": "unit_price"}
    out = None
    for name in entity_tables.names():
        table = entity_tables.entity_table(known, name)
        one = table.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.sum(F.col(money[name]) if name in money else F.lit(None).cast("decimal(18,4)")).cast("decimal(28,4)").alias("money"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (canonical_records, redelivery_outcomes, entity_rows)}


def _uid(n: int, number: str) -> str:
    return f"'{n:08x}-0000-4000-8000-' || lpad(CAST({number} AS VARCHAR), 12, '0')"


def _payload_sql(kind: str) -> str:
    """The canonical payload of a type, put together from the events' columns, keys in order."""
    pick = lambda words: "[" + ", ".join(f"'{w}'" for w in words.split()) + f"][k % {len(words.split())} + 1]"
    money = lambda more: f"CAST(CAST(CAST(value AS DECIMAL(18,2)) + {more} AS DECIMAL(18,2)) AS VARCHAR)"
    texts = {
        **{name: _uid(i, "event_id") for i, name in enumerate(("session_id", "cart_id", "order_id", "payment_id", "refund_id", "alert_id", "event_id"), 2)},
        "customer_id": _uid(1, "user_id"), "product_id": _uid(9, "k"), "device_id": _uid(10, "k % 4"), "email_hash": "md5(CAST(user_id AS VARCHAR))", "category": "'books'", "reason": "'damaged'",
        **{name: pick("TR DE US GB FR") for name in ("country_code", "shipping_country_code", "billing_country_code")}, **{name: pick(words) for name, words in C.WORDS.items()},
        "ip_address": "CASE WHEN k % 7 = 0 THEN '2001:db8::' || hex(k) ELSE '10.0.' || (k % 256) || '.' || (user_id % 256) END",
        "unit_price": money(0), "amount": money(1), "subtotal": money(10), "discount_amount": "'10.00'", "total_amount": money(0), "fraud_score": "'55.50'",
        **{name: "stamp" for name in ("registered_at", "started_at", "created_at", "completed_at", "failed_at", "requested_at")},
    }
    plain = {"quantity": "k % 5 + 1", "item_count": "k % 9 + 1", "quantity_available": "k", "reasons": "'[\"HIGH_AMOUNT\"]'"}
    parts = []
    for name in sorted(C.PAYLOADS[kind].split()):
        shown = f"({plain[name]})" if name in plain else f"""'"' || ({texts[name]}) || '"'"""
        if kind == "fraud_alert_created" and name == "customer_id":
            shown = f"CASE WHEN event_id % 41 = 22 THEN 'null' ELSE {shown} END"
        parts.append(f"""'"{name}":' || ({shown})""")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


_TYPE = record_queries._TYPE
_STYLED = f"""{A.ORACLE},
stamped AS (SELECT d.*, e.value, strftime(make_timestamp(d.at_us), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM deliveries d JOIN events e USING (event_id) WHERE copy = 0 AND {record_queries._CATEGORY.replace('event_id', 'd.event_id')} IS NULL),
bodies AS (
  SELECT part, off, event_id, '{{"correlation_id":"' || {_uid(11, 'event_id')} || '","event_id":"' || {_uid(8, 'event_id')} || '","event_time":"' || stamp || '","event_type":"' || {_TYPE} || '","event_version":1,"payload":'
    || CASE event_id % 10 {' '.join(f'WHEN {i} THEN {_payload_sql(t)}' for i, t in enumerate(C.PAYLOADS))} END || ',"produced_at":"' || stamp || '","source":"shop"}}' AS body
  FROM stamped
)"""

_ENTITY = "[" + ", ".join(f"'{entity_tables.TABLES[t]}'" for t in C.PAYLOADS) + "][event_id % 10 + 1]"
_MONEY = "[" + ", ".join({"product_viewed": "0", "added_to_cart": "0", "checkout_started": "0", "order_created": "0", "payment_completed": "1", "payment_failed": "1", "refund_requested": "1"}.get(t, "NULL") for t in C.PAYLOADS) + "][event_id % 10 + 1]"

ORACLE_SQL = {
    "entity_rows": f"WITH {_STYLED} SELECT {_ENTITY} AS table, count(*) AS rows, CAST(sum(CAST(CAST(value AS DECIMAL(18,2)) + {_MONEY} AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS money FROM stamped GROUP BY 1",
    "canonical_records": f"WITH {_STYLED} SELECT part AS partition, off AS offset, body, sha256(body) AS content_hash FROM bodies",
    "redelivery_outcomes": f"""WITH {_STYLED},
given AS (
  SELECT part, off, {_uid(8, 'event_id')} AS event_id, 0 AS changed FROM bodies
  UNION ALL SELECT part, CASE WHEN off % 100 = 30 THEN off - 1 ELSE off + 1000000000 END, {_uid(8, 'event_id')}, CAST(off % 100 = 50 AS INT) FROM bodies WHERE off % 10 = 0
),
owned AS (SELECT *, min(event_id) OVER (PARTITION BY part, off) = event_id AS mine FROM given),
placed AS (SELECT *, CASE WHEN mine THEN row_number() OVER (PARTITION BY event_id, mine ORDER BY part, off) END AS n, min_by(changed, off) FILTER (mine) OVER (PARTITION BY event_id) AS first_changed FROM owned)
SELECT event_id, 'commerce.events' AS topic, CAST(part AS INT) AS partition, off AS offset, CASE WHEN NOT mine THEN 'dlq' WHEN n = 1 THEN 'processed' WHEN changed = first_changed THEN 'duplicate' ELSE 'dlq' END AS outcome FROM placed""",
}
