"""Records: raw records made of the events, their classification, dedup outcomes, commits, lateness, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contract as C
from ..operators import records as R
from ..sources import adapters as A


TYPES = tuple(C.PAYLOADS)
_BAD = {
    "user_registered": ("country_code", "tr"), "session_started": ("ip_address", "300.1.1.1"), "product_viewed": ("quantity_available", -1), "added_to_cart": ("quantity", 0), "checkout_started": ("currency", "XXX"),
    "order_created": ("item_count", 0), "payment_completed": ("amount", "0"), "payment_failed": ("failure_reason", "bored"), "refund_requested": ("reason", "  "), "fraud_alert_created": ("decision", "MAYBE"),
}


def _uid(n: int, number: Column) -> Column:
    return F.concat(F.lit(f"{n:08x}-0000-4000-8000-"), F.lpad(number.cast("string"), 12, "0"))


def _payload_fields(time: Column) -> dict[str, Column]:
    """A value for each payload field, from an event's columns."""
    k, money = F.col("k"), lambda more: (F.col("amount") + more).cast(A.MONEY).cast("string")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words.split())), (k % len(words.split()) + 1).cast("int"))
    ids = {n: _uid(i, F.col("event_id")) for i, n in enumerate(("session_id", "cart_id", "order_id", "payment_id", "refund_id", "alert_id", "event_id"), 2)}
    countries = pick("TR DE US GB FR")
    return {
        **ids, "customer_id": _uid(1, F.col("user_id")), "product_id": _uid(9, k), "device_id": _uid(10, k % 4), "email_hash": F.md5(F.col("user_id").cast("string")), "category": F.lit("books"), "reason": F.lit("damaged"),
        "country_code": countries, "shipping_country_code": countries, "billing_country_code": countries, **{n: pick(w) for n, w in C.WORDS.items()},
        "ip_address": F.when(k % 7 == 0, F.concat(F.lit("2001:db8::"), F.hex(k))).otherwise(F.concat_ws(".", F.lit("10.0"), (k % 256).cast("string"), (F.col("user_id") % 256).cast("string"))),
        "unit_price": money(0), "amount": money(1), "subtotal": money(10), "discount_amount": F.lit("10.00"), "total_amount": F.when(F.col("defect") == 16, money(1)).otherwise(money(0)),
        "quantity": k % 5 + 1, "item_count": k % 9 + 1, "quantity_available": k, "fraud_score": F.lit("55.50"), "reasons": F.array(F.lit("HIGH_AMOUNT")),
        **{n: time for n in ("registered_at", "started_at", "created_at", "completed_at", "failed_at", "requested_at")},
    }


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries rendered as raw records of the ten event types (event_id mod 10); event_id mod 41 says which defect a record has."""
    # rows are small and bodies dear: a stated number of partitions, which adaptive execution doesn't merge by their bytes
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = A.deliveries(spark, sf_dir).where("copy = 0").repartition(spread, "event_id").withColumn("defect", (F.col("event_id") % 41).cast("int")).withColumn("kind", (F.col("event_id") % 10).cast("int"))
    is_ = lambda n: F.col("defect") == n
    stamp = lambda us: F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = _payload_fields(stamp(F.col("at_us")))
    # values are made once, as columns, and the payload of the type that is shown is put together from them
    d = d.withColumns({f"f_{name}": value for name, value in fields.items()}).withColumn("shown", F.when(is_(15), (F.col("kind") + 1) % len(TYPES)).otherwise(F.col("kind")))
    payload = F.lit(None).cast("string")
    for i, name in enumerate(TYPES):
        bad_field, bad = _BAD[name]
        values = {f: F.when(is_(14), F.lit(bad)).otherwise(F.col(f"f_{f}")) if f == bad_field else F.col(f"f_{f}") for f in C.PAYLOADS[name].split()}
        first = next(iter(values))
        values[first] = F.when(~is_(18), values[first])
        if name == "fraud_alert_created":
            values["customer_id"] = F.when(~is_(22), values["customer_id"])
        made = F.to_json(F.struct(*[v.alias(f) for f, v in values.items()]), {"ignoreNullFields": str(name != "fraud_alert_created").lower()})
        payload = F.when(F.col("shown") == i, made).otherwise(payload)
    d = d.withColumn("payload", payload)
    kind = F.when(is_(7), "unknown").otherwise(F.element_at(F.array(*map(F.lit, TYPES)), F.col("kind") + 1))
    version = F.when(is_(8), "2").when(is_(10), "0").otherwise("1")
    own, run = _uid(8, F.col("event_id")), _uid(11, F.col("event_id"))
    produced = stamp(F.when(is_(17), F.col("at_us") - 301_000_000).otherwise(F.col("at_us")))
    body = F.concat(
        F.lit('{"event_id":"'), own, F.lit('","event_type":"'), kind, F.lit('","event_version":'), version, F.lit(',"event_time":"'), stamp(F.col("at_us")), F.lit('","produced_at":"'), produced,
        F.lit('","source":"shop","correlation_id":"'), run, F.lit('","payload":'), F.col("payload"), F.when(is_(9), ',"extra":1}').otherwise("}"),
    )
    body = F.when(is_(1), F.lit(None)).when(is_(6), F.concat(body, F.lit(" x"))).when(is_(20), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    header = lambda name, value: F.struct(F.lit(name).alias("key"), value.cast("binary").alias("value"))
    sound: list[Column] = [
        header("event_id", F.when(is_(11), F.lit("other")).otherwise(own)), header("event_type", kind), header("event_version", version), header("correlation_id", run),
        header("content_type", F.when(is_(5), F.lit("text/plain")).otherwise(F.lit("application/json"))),
    ]
    source = header("source", F.lit("shop"))
    bad_source = F.struct(F.lit("source").alias("key"), F.unhex(F.lit("ff")).alias("value"))
    # the function that drops a header keeps this projection out of whole-stage code, whose one method the JIT would leave out
    headers = (
        F.when(is_(19), F.lit(None)).when(is_(3), F.filter(F.array(*sound, source), lambda h: h["key"] != "source")).when(is_(4), F.array(*sound, source, source)).when(is_(13), F.array(*sound, bad_source))
        .when(is_(21) | is_(16), F.array(*sound, source, header("synthetic_anomaly", F.lit("made")))).otherwise(F.array(*sound, source))
    )
    key = F.when(is_(12), F.lit("someone")).when((F.col("kind") == 9) & is_(22), run).otherwise(_uid(1, F.col("user_id")))
    return d.select(
        F.lit("commerce.events").alias("topic"), "partition", "offset", F.timestamp_micros("at_us").alias("timestamp"), F.when(~is_(2), key).cast("binary").alias("key"), body.cast("binary").alias("value"), headers.alias("headers"),
    )


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classify(raw_records(spark, sf_dir))


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dead_letters(_classified(spark, sf_dir), failed_at=F.col("timestamp"))


def record_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each category and type; sound ones as such."""
    kind = F.when(F.col("event_type_hint").isin(*TYPES), F.col("event_type_hint")).otherwise("none")
    return _classified(spark, sf_dir).groupBy(F.coalesce("category", F.lit("sound")).alias("category"), kind.alias("event_type")).agg(F.count("*").alias("records"))


def record_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each bad record's contract check names: the broken fields, the first bad header, or what else is wrong."""
    return _classified(spark, sf_dir).where("category is not null").select("partition", "offset", "category", F.when(F.col("category") == "contract_validation_failed", F.col("message")).alias("fields"), "event_id_hint", "correlation_id_hint")


def record_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dead letters of all bad records."""
    names = F.concat_ws(",", F.array_sort(F.map_keys("source_headers")))
    return _letters(spark, sf_dir).select(
        "source_partition", "source_offset", "error_category", "source_key_base64", "original_value_truncated", names.alias("header_names"),
        F.element_at("source_headers", "source").alias("source_header"), "original_event_id", "anomaly_type", "processing_attempts",
    )


def anomaly_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the anomaly that their header tells of, sound and bad ones."""
    return _classified(spark, sf_dir).groupBy(F.coalesce("anomaly", F.lit("none")).alias("anomaly")).agg(F.count("*").alias("records"), F.count("category").alias("bad"))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.delivery_outcomes(A.deliveries(spark, sf_dir))


def dedup_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).select("event_id", "copy", "partition", "offset", "outcome")


def dedup_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = lambda o: F.count_if(F.col("outcome") == o)
    return _outcomes(spark, sf_dir).groupBy("event_type").agg(
        F.count("*").alias("deliveries"), F.count_distinct("event_id").alias("ids"), by("processed").alias("processed"), by("duplicate").alias("duplicates"), by("dlq").alias("dead"),
        F.sum(F.when(F.col("outcome") == "processed", F.col("amount"))).cast("decimal(28,2)").alias("amount"),
    )


def commit_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.commit_frontier(A.deliveries(spark, sf_dir).where("k <> 99"))


def commit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.commit_batches(A.deliveries(spark, sf_dir))


def late_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.deliveries(spark, sf_dir).withColumn("at_us", F.when(F.col("k") < 5, F.col("at_us") - 86_400_000_000).otherwise(F.col("at_us")))
    return R.late_records(d).groupBy("user_id").agg(F.count("*").alias("deliveries"), F.count_if("late").alias("late"), F.count_if("repeated").alias("repeated"))


def topic_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.deliveries(spark, sf_dir).groupBy("partition").agg(F.min("offset").alias("low"), (F.max("offset") + 1).alias("high"))


def offset_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of [start, end) of each partition, from a tenth to a half of what the partition holds."""
    d = A.deliveries(spark, sf_dir)
    wanted = topic_offsets(spark, sf_dir).select("partition", F.floor(F.col("high") / 10).alias("start"), F.floor(F.col("high") / 2).alias("end"))
    return d.join(wanted, "partition").where("offset >= start and offset < end").select("partition", "offset", "event_id")


def publish_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest record of each purchase's event_id."""
    wanted = A.events(spark, sf_dir).where("event_type = 'purchase'").select("event_id")
    return A.deliveries(spark, sf_dir).join(wanted, "event_id", "left_semi").groupBy("event_id").agg(F.min("at_us").alias("published_at"), F.count("*").alias("deliveries"))


def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = A.payments(spark, sf_dir).where("status = 'failed'").withColumn("attempt", (F.col("device") + 1) * 2)
    return R.retry_schedule(failed).select("payment_id", "attempt", "delay_seconds")


QUERIES = {
    f.__name__: f
    for f in (
        record_categories, record_messages, record_dead_letters, anomaly_tally, dedup_outcomes, dedup_counters, commit_frontier, commit_batches, late_records, topic_offsets, offset_range, publish_times, retry_schedule,
    )
}

#: The category of an event's record as its defect plans it.
_CATEGORY = """CASE event_id % 41 WHEN 1 THEN 'missing_value' WHEN 2 THEN 'missing_key' WHEN 3 THEN 'missing_header' WHEN 4 THEN 'duplicate_header' WHEN 5 THEN 'invalid_content_type'
 WHEN 6 THEN 'malformed_json' WHEN 7 THEN 'unknown_event_type' WHEN 8 THEN 'unsupported_event_version' WHEN 9 THEN 'contract_validation_failed' WHEN 10 THEN 'contract_validation_failed'
 WHEN 11 THEN 'header_body_mismatch' WHEN 12 THEN 'key_body_mismatch' WHEN 13 THEN 'invalid_header_encoding' WHEN 14 THEN 'contract_validation_failed' WHEN 15 THEN 'contract_validation_failed'
 WHEN 16 THEN CASE WHEN event_id % 10 IN (4, 5) THEN 'contract_validation_failed' END WHEN 17 THEN 'contract_validation_failed' WHEN 18 THEN 'contract_validation_failed' WHEN 19 THEN 'missing_header'
 WHEN 20 THEN 'contract_validation_failed' END"""
_TYPE = "[" + ", ".join(f"'{t}'" for t in TYPES) + "][event_id % 10 + 1]"
_HINTED = "event_id % 41 NOT IN (1, 6, 20)"
_BAD_FIELDS = "[" + ", ".join(f"'{_BAD[t][0]}'" for t in TYPES) + "][event_id % 10 + 1]"
_FIRST_FIELDS = "[" + ", ".join(f"'{C.PAYLOADS[t].split()[0]}'" for t in TYPES) + "][event_id % 10 + 1]"
_OTHER_FIELDS = "[" + ", ".join(
    "'" + ",".join(sorted(set(C.PAYLOADS[t].split()) ^ set(C.PAYLOADS[TYPES[(i + 1) % 10]].split()))) + "'" for i, t in enumerate(TYPES)
) + "][event_id % 10 + 1]"
_OUTCOMES = f"""{A.ORACLE},
placed AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY part, off) AS n, first_value(amount) OVER (PARTITION BY event_id ORDER BY part, off) AS first_amount FROM deliveries),
outcomes AS (SELECT *, CASE WHEN n = 1 THEN 'processed' WHEN amount = first_amount THEN 'duplicate' ELSE 'dlq' END AS outcome FROM placed)"""

ORACLE_SQL = {
    "record_categories": f"""SELECT coalesce({_CATEGORY}, 'sound') AS category, CASE WHEN {_HINTED} AND event_id % 41 <> 7 THEN {_TYPE} ELSE 'none' END AS event_type, count(*) AS records FROM events GROUP BY 1, 2""",
    "record_messages": f"""WITH {A.ORACLE} SELECT part AS partition, off AS offset, {_CATEGORY} AS category,
 CASE event_id % 41 WHEN 9 THEN 'extra' WHEN 10 THEN 'event_version' WHEN 14 THEN {_BAD_FIELDS} WHEN 15 THEN {_OTHER_FIELDS} WHEN 16 THEN CASE WHEN event_id % 10 IN (4, 5) THEN 'totals' END WHEN 17 THEN 'produced_at' WHEN 18 THEN {_FIRST_FIELDS} WHEN 20 THEN 'body is no object' END AS fields,
 CASE WHEN {_HINTED} THEN '00000008-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') END AS event_id_hint,
 CASE WHEN {_HINTED} THEN '0000000b-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') END AS correlation_id_hint
 FROM deliveries WHERE copy = 0 AND {_CATEGORY} IS NOT NULL""",
    "record_dead_letters": f"""WITH {A.ORACLE} SELECT part AS source_partition, off AS source_offset, {_CATEGORY} AS error_category,
 CASE event_id % 41 WHEN 2 THEN NULL WHEN 12 THEN to_base64(encode('someone')) ELSE to_base64(encode('00000001-0000-4000-8000-' || lpad(CAST(user_id AS VARCHAR), 12, '0'))) END AS source_key_base64,
 FALSE AS original_value_truncated,
 CASE event_id % 41 WHEN 19 THEN '' WHEN 3 THEN 'content_type,correlation_id,event_id,event_type,event_version' WHEN 16 THEN 'content_type,correlation_id,event_id,event_type,event_version,source,synthetic_anomaly' ELSE 'content_type,correlation_id,event_id,event_type,event_version,source' END AS header_names,
 CASE event_id % 41 WHEN 19 THEN NULL WHEN 3 THEN NULL WHEN 13 THEN '<invalid-utf8>' ELSE 'shop' END AS source_header,
 CASE WHEN {_HINTED} THEN '00000008-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') END AS original_event_id,
 CASE WHEN event_id % 41 = 16 THEN 'made' END AS anomaly_type, 1 AS processing_attempts
 FROM deliveries WHERE copy = 0 AND {_CATEGORY} IS NOT NULL""",
    "anomaly_tally": f"SELECT CASE WHEN event_id % 41 IN (16, 21) THEN 'made' ELSE 'none' END AS anomaly, count(*) AS records, count({_CATEGORY}) AS bad FROM events GROUP BY 1",
    "dedup_outcomes": f"WITH {_OUTCOMES} SELECT event_id, copy, part AS partition, off AS offset, outcome FROM outcomes",
    "dedup_counters": f"WITH {_OUTCOMES} SELECT event_type, count(*) AS deliveries, count(DISTINCT event_id) AS ids, count(*) FILTER (outcome = 'processed') AS processed, count(*) FILTER (outcome = 'duplicate') AS duplicates, count(*) FILTER (outcome = 'dlq') AS dead, CAST(sum(amount) FILTER (outcome = 'processed') AS DECIMAL(28,2)) AS amount FROM outcomes GROUP BY event_type",
    "commit_frontier": f"WITH {A.ORACLE}, t AS (SELECT part, off, lead(off) OVER (PARTITION BY part ORDER BY off) AS next FROM deliveries WHERE k <> 99) SELECT part AS partition, min(off) FILTER (next IS NULL OR next > off + 1) + 1 AS next_offset, max(off) AS highest FROM t GROUP BY part",
    "commit_batches": f"WITH {A.ORACLE} SELECT part AS partition, CAST(off // 50 AS BIGINT) AS batch, count(*) AS records, min(off) AS first_offset, max(off) AS last_offset FROM deliveries GROUP BY 1, 2",
    "late_records": f"""WITH {A.ORACLE}, t AS (SELECT *, CASE WHEN k < 5 THEN at_us - 86400000000 ELSE at_us END AS moved FROM deliveries),
 l AS (SELECT *, max(moved) OVER (PARTITION BY user_id ORDER BY part, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, row_number() OVER (PARTITION BY event_id ORDER BY part, off) AS n FROM t)
 SELECT user_id, count(*) AS deliveries, count(*) FILTER (moved < top) AS late, count(*) FILTER (n > 1) AS repeated FROM l GROUP BY user_id""",
    "topic_offsets": f"WITH {A.ORACLE} SELECT part AS partition, min(off) AS low, max(off) + 1 AS high FROM deliveries GROUP BY part",
    "offset_range": f"WITH {A.ORACLE} SELECT part AS partition, off AS offset, event_id FROM deliveries JOIN (SELECT part AS p, (max(off) + 1) // 10 AS low, (max(off) + 1) // 2 AS high FROM deliveries GROUP BY 1) r ON p = part WHERE off >= low AND off < high",
    "publish_times": f"WITH {A.ORACLE} SELECT event_id, min(at_us) AS published_at, count(*) AS deliveries FROM deliveries WHERE event_type = 'purchase' GROUP BY event_id",
    "retry_schedule": f"WITH {A.ORACLE} SELECT payment_id, (device + 1) * 2 AS attempt, least(30.0, 0.5 * 2.0 ** ((device + 1) * 2 - 1)) AS delay_seconds FROM payments WHERE status = 'failed'",
}
