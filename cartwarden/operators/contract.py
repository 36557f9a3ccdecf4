"""The closed contract of the ten commerce events as column rules made from one field table.

A body is parsed once, into a variant; its envelope and its payload are read as maps from name to variant, and each
value is checked by the kind of its field. Whatever a name isn't in the table for breaks the contract.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import uuid5

#: Fixed values of the contract: the fields of each event's payload.
PAYLOADS = {
    "user_registered": "customer_id email_hash country_code persona registered_at",
    "session_started": "session_id customer_id device_id device_type ip_address country_code channel started_at",
    "product_viewed": "session_id customer_id product_id category unit_price currency quantity_available",
    "added_to_cart": "session_id customer_id cart_id product_id quantity unit_price currency",
    "checkout_started": "session_id customer_id cart_id item_count subtotal discount_amount total_amount currency",
    "order_created": "order_id customer_id session_id cart_id item_count subtotal discount_amount total_amount currency shipping_country_code billing_country_code created_at",
    "payment_completed": "payment_id order_id customer_id amount currency payment_method device_id ip_address country_code completed_at",
    "payment_failed": "payment_id order_id customer_id amount currency payment_method failure_reason device_id ip_address country_code failed_at",
    "refund_requested": "refund_id payment_id order_id customer_id amount currency reason requested_at",
    "fraud_alert_created": "alert_id event_id customer_id order_id fraud_score decision reasons created_at",
}
#: Fixed values of the contract: closed sets of words.
WORDS = {
    "persona": "normal indecisive discount_hunter suspicious bot account_takeover",
    "currency": "TRY EUR USD GBP",
    "payment_method": "credit_card debit_card bank_transfer digital_wallet",
    "failure_reason": "insufficient_funds declined expired_card invalid_details processor_error fraud_suspected",
    "decision": "APPROVE REVIEW BLOCK",
    "device_type": "desktop mobile tablet bot",
    "channel": "web mobile_app partner api",
}
#: Kinds of fields that aren't closed sets; fields named ``..._id`` are UUIDs and ``..._at`` or event_time are times.
KINDS = {
    "email_hash": "text", "category": "text", "reason": "text", "source": "text", "country_code": "country", "shipping_country_code": "country", "billing_country_code": "country",
    "ip_address": "ip", "unit_price": "money", "subtotal": "money", "discount_amount": "money", "total_amount": "money", "amount": "paid", "fraud_score": "score",
    "quantity": "count", "item_count": "count", "quantity_available": "number", "reasons": "texts", "event_version": "count", "event_type": "text", "event_time": "time", "payload": "object",
}
ENVELOPE = ("correlation_id", "event_id", "event_time", "event_type", "event_version", "payload", "produced_at", "source")
#: The same as producers write them.
SENT = ("event_id", "event_type", "event_version", "event_time", "produced_at", "source", "correlation_id", "payload")
MAY_BE_NULL = {"fraud_alert_created": ("customer_id", "order_id")}
WITH_TOTALS = ("checkout_started", "order_created")
SKEW_SECONDS = 300
#: The headers that a record must have, those that go to the dead letters, and the categories in order.
REQUIRED_HEADERS = ("content_type", "correlation_id", "event_id", "event_type", "event_version", "source")
SAFE_HEADERS = (*REQUIRED_HEADERS, "synthetic_anomaly")
CATEGORIES = (
    "missing_value", "missing_key", "missing_header", "duplicate_header", "invalid_header_encoding", "invalid_content_type", "malformed_json",
    "unknown_event_type", "unsupported_event_version", "contract_validation_failed", "header_body_mismatch", "key_body_mismatch",
)
DEAD_LETTER_FIELDS = (
    "dlq_schema_version", "dlq_record_id", "failed_at", "source_topic", "source_partition", "source_offset", "error_category", "error_message", "error_type", "processing_attempts", "consumer_group",
    "processor_instance_id",
)
DEAD_LETTERS = uuid.UUID("bb8709f1-40b8-4a8f-93ca-96775f4c7d7a")

_UUID = r"(?i)\A(urn:uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?\z"
_TIME = r"\A\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d{1,9})?)?(Z|[+-]\d\d:?\d\d)\z"
_DECIMAL = r"\A[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\z"
_BYTE = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = rf"\A({_BYTE}(\.{_BYTE}){{3}}|(?=[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*:)(?!.*::.*::)(([0-9A-Fa-f]{{1,4}}|):){{1,7}}([0-9A-Fa-f]{{1,4}}|:|{_BYTE}(\.{_BYTE}){{3}}))\z"


#: Texts of values that are sound and already in canonical form, by kind: a part of what the checks let pass.
_WORDY = r'"[A-Za-z0-9][A-Za-z0-9_.:/ -]*"'
_PLAIN = {
    "uuid": '"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"',
    "time": r'"[12]\d{3}-((0[1-9]|1[0-2])-(0[1-9]|1\d|2[0-8])|(0[13-9]|1[0-2])-(29|30)|(0[13578]|1[02])-31)T([01]\d|2[0-3]):[0-5]\d:[0-5]\dZ"',
    "text": _WORDY, "texts": rf"\[{_WORDY}(,{_WORDY})*\]", "country": '"[A-Z]{2}"', "ip": rf'"({_BYTE}(\.{_BYTE}){{3}}|[0-9A-Fa-f]{{1,4}}(:[0-9A-Fa-f]{{1,4}}){{0,5}}::[0-9A-Fa-f]{{1,4}})"',
    "money": r'"\d{1,12}(\.\d{1,8})?"', "paid": r'"(?=[\d.]*[1-9])\d{1,12}(\.\d{1,8})?"', "score": r'"(100|\d{1,2}(\.\d{1,8})?)"', "count": r"[1-9]\d{0,8}", "number": r"(0|[1-9]\d{0,8})",
    **{name: f'"({words.replace(" ", "|")})"' for name, words in WORDS.items()},
}


def kind_of(field: str) -> str:
    return field if field in WORDS else KINDS.get(field) or ("uuid" if field.endswith("_id") else "time")


def _fields(names: dict[str, str]) -> Column:
    return F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])


def sound_value(kind: Column, value: Column) -> Column:
    """Whether a variant is a value of the kind, without coercion: numbers aren't texts, but money may be either."""
    return _sound_text(kind, F.schema_of_variant(value), value.cast("string"))


def _sound_text(kind: Column, is_: Column, text: Column) -> Column:
    """The same of a variant's schema and text. Within higher-order functions nothing is shared, so what is looked up comes as columns."""
    amount = F.when(text.rlike(_DECIMAL), text.try_cast("decimal(38,18)"))
    money = is_.rlike(r"\A(STRING|BIGINT|DECIMAL|DOUBLE|FLOAT)") & amount.isNotNull()
    whole = F.when(is_ == "BIGINT", text.try_cast("bigint"))
    string = is_ == "STRING"
    parts = F.when(is_.isin("ARRAY<STRING>"), F.from_json(text, "array<string>"))
    cases = {
        "uuid": string & text.rlike(_UUID), "time": string & text.rlike(_TIME) & F.try_to_timestamp(text).isNotNull(), "text": string & (F.trim(text) != ""),
        "country": string & text.rlike(r"\A[A-Z]{2}\z"), "ip": string & text.rlike(_IP), "money": money & (amount >= 0), "paid": money & (amount > 0), "score": money & amount.between(0, 100),
        "count": whole > 0, "number": whole >= 0, "texts": (F.size(parts) > 0) & ~F.exists(parts, lambda p: F.trim(p) == ""), "object": is_.startswith("OBJECT"),
        **{name: string & text.isin(*words.split()) for name, words in WORDS.items()},
    }
    found = F.lit(False)
    for name, test in reversed(cases.items()):  # the frequent kinds are asked first
        found = F.when(kind == name, test).otherwise(found)
    return F.coalesce(found, F.lit(False))


def parsed(records: DataFrame) -> DataFrame:
    """records with __body (the envelope's values by name; null unless the body is one JSON object), __payload and __json.

    Spark's parser lets text after an object pass, so the body is also parsed inside an object whose second key is the
    body's own hash. Repeated keys and NaN count as malformed.
    """
    text, keys = F.col("value").cast("string"), F.map_keys("__outer")
    wrapped = F.try_parse_json(F.concat(F.lit('{"b":'), text, F.lit(',"'), F.col("__digest"), F.lit('":1}')))
    outer = F.try_variant_get("__wrapped", "$", "map<string,variant>")
    whole = F.coalesce((F.size(keys) == 2) & F.array_contains(keys, "b") & F.array_contains(keys, F.col("__digest")), F.lit(False))
    return (
        records.withColumn("__digest", F.sha2(F.col("value"), 256)).withColumn("__wrapped", wrapped).withColumn("__outer", outer)
        .withColumn("__json", F.when(whole, F.element_at("__outer", "b")))
        .withColumn("__body", F.try_variant_get("__json", "$", "map<string,variant>"))
        .withColumn("__payload", F.try_variant_get(F.element_at("__body", "payload"), "$", "map<string,variant>"))
        .drop("__wrapped", "__outer", "__digest")
    )


def text_of(values: str, name: str) -> Column:
    """A value of a map of variants if it is a text, else null."""
    value = F.element_at(values, name)
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))


def _pattern(envelope: tuple[str, ...], payload: Callable[[str], list[str]]) -> str:
    """A pattern of whole bodies that are sound in every field, with the keys in the given orders and nothing between them."""
    at = envelope.index("event_type")
    types = []
    for name, fields in PAYLOADS.items():
        free = MAY_BE_NULL.get(name, ())
        value = lambda f: f"(null|{_PLAIN[kind_of(f)]})" if f in free else _PLAIN[kind_of(f)]  # noqa: B023, E731
        inside = r"\{" + ",".join(f'"{f}":{value(f)}' for f in payload(fields)) + r"\}"
        types.append(",".join([f'"{name}"', *(f'"{f}":{inside if f == "payload" else _PLAIN[kind_of(f)]}' for f in envelope[at + 1 :])]))
    whole = r"\A\{" + "".join(f'"{f}":{_PLAIN[kind_of(f)]},' for f in envelope[:at]) + f'"event_type":({"|".join(types)})' + r"\}\z"
    return re.sub(r"\((?!\?)", "(?:", whole)


def plain(text: Column) -> Column:
    """Whether the JSON text of a body's variant is, as it stands, sound in every field and in canonical form.

    A variant's text has its keys in order and nothing between them, so one pattern, made from the field table with an
    alternative a type, says it of most bodies at once. What doesn't match may be sound all the same and is looked at
    field by field.
    """
    return F.coalesce(text.rlike(_pattern(ENVELOPE, lambda fields: sorted(fields.split()))), F.lit(False))


def as_listed(text: Column) -> Column:
    """The same of a body as it was sent, with its keys as the field table lists them: most need no text made of their variant."""
    return F.coalesce(text.rlike(_pattern(SENT, str.split)), F.lit(False))


def broken_fields() -> Column:
    """Names of the fields of envelope and payload that break the contract, in order; missing and unknown ones included."""
    kind = text_of("__body", "event_type")
    kinds = _fields({f: kind_of(f) for f in sorted({*ENVELOPE, *" ".join(PAYLOADS.values()).split()})})
    expected = F.element_at(F.create_map(*[x for k, v in PAYLOADS.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(v.split()))))]), kind)
    nullable = F.coalesce(*[F.when(kind == k, F.array(*map(F.lit, v))) for k, v in MAY_BE_NULL.items()], F.array().cast("array<string>"))

    def bad(values: str, wanted: Column, free: Column) -> Column:
        keys = F.map_keys(values)
        told = F.transform(F.map_entries(values), lambda e: F.struct(e["key"].alias("key"), F.element_at(kinds, e["key"]).alias("kind"), F.schema_of_variant(e["value"]).alias("is"), e["value"].alias("value")))
        told = F.transform(told, lambda e: F.struct(e["key"].alias("key"), e["kind"].alias("kind"), e["is"].alias("is"), F.when(~e["is"].startswith("OBJECT"), e["value"].cast("string")).alias("text")))
        unsound = F.filter(told, lambda e: ~_sound_text(e["kind"], e["is"], e["text"]) & ~(F.array_contains(free, e["key"]) & (e["is"] == "VOID")))
        wrong = F.transform(unsound, lambda e: e["key"])
        return F.array_union(F.array_union(F.array_except(wanted, keys), F.array_except(keys, wanted)), wrong)

    none = F.array().cast("array<string>")
    listed = F.array_sort(F.array_union(bad("__body", F.array(*map(F.lit, ENVELOPE)), none), F.coalesce(bad("__payload", expected, nullable), F.array(F.lit("payload")))))
    return F.when(as_listed(F.col("value").cast("string")) | plain(F.col("__json").cast("string")), none).otherwise(listed)


def broken_totals() -> Column:
    """Whether a checkout's or an order's discount exceeds its subtotal or its total isn't the difference, exactly."""
    money = lambda name: F.element_at("__payload", name).cast("string").try_cast("decimal(28,8)")
    sound = (money("discount_amount") <= money("subtotal")) & (money("total_amount") == money("subtotal") - money("discount_amount"))
    return text_of("__body", "event_type").isin(*WITH_TOTALS) & ~F.coalesce(sound, F.lit(False))


def skewed_clock() -> Column:
    """Whether a record says that it was produced over five minutes before its event."""
    at = lambda name: F.try_to_timestamp(text_of("__body", name))
    return ~text_of("__body", "produced_at").eqNullSafe(text_of("__body", "event_time")) & F.coalesce(F.unix_micros(at("produced_at")) < F.unix_micros(at("event_time")) - SKEW_SECONDS * 1_000_000, F.lit(False))


def _header(name: str) -> Column:
    """The first of the name, as text; null if there is none."""
    return F.get(F.col("__values"), F.array_position("__names", name) - 1).cast("string")


def classify(records: DataFrame) -> DataFrame:
    """records(key binary, value binary, headers array<struct<key, value binary>>, ...) with category and message, null if sound, and hints.

    The first failing check wins, in the order of CATEGORIES; null headers are none. Hints are the event_id,
    event_type and correlation_id of a body that is an object (ids only where they are UUIDs).
    """
    required = F.array(*map(F.lit, REQUIRED_HEADERS))
    names = F.col("__names")
    missing = F.array_except(required, names)
    # headers are read without higher-order functions, which run interpreted, but for one in a message that is seldom made:
    # it keeps these checks out of whole-stage code, whose single method would be too long for the JIT
    first_missing = F.array_min(F.filter(required, lambda n: ~F.array_contains(names, n)))
    header = lambda n: F.col(f"__header_{n}")
    body = lambda n: F.col(f"__body_{n}")
    repeated = F.coalesce(*[F.when(F.size(F.array_remove(names, n)) < F.size(names) - 1, F.lit(n)) for n in sorted(REQUIRED_HEADERS)])
    unreadable = F.coalesce(*[F.when(header(n).isNull() | ~F.is_valid_utf8(header(n)), F.lit(n)) for n in sorted(REQUIRED_HEADERS)])  # asked where each is there once
    number = F.element_at("__body", "event_version")
    version = F.when(F.schema_of_variant(number) == "BIGINT", body("event_version").try_cast("bigint"))
    is_object = F.col("__body").isNotNull()
    in_body = ("event_id", "event_type", "event_version", "correlation_id", "source")
    differs = F.coalesce(*[F.when(~header(n).eqNullSafe(body(n)), F.lit(n)) for n in in_body])
    ordering_key = F.coalesce(text_of("__payload", "customer_id"), text_of("__body", "correlation_id"))
    kind, version_ = F.col("__kind"), F.col("__version")
    checks = [
        (F.col("value").isNull(), "missing_value", F.lit("no value")),
        (F.col("key").isNull(), "missing_key", F.lit("no key")),
        (F.size(missing) > 0, "missing_header", first_missing),
        (repeated.isNotNull(), "duplicate_header", repeated),
        (unreadable.isNotNull(), "invalid_header_encoding", unreadable),
        (header("content_type") != "application/json", "invalid_content_type", header("content_type")),
        (F.col("__json").isNull(), "malformed_json", F.lit("body is not JSON")),
        (is_object & ~F.coalesce(kind.isin(*PAYLOADS), F.lit(False)), "unknown_event_type", kind),
        (F.coalesce(version_ > 1, F.lit(False)), "unsupported_event_version", version_.cast("string")),
        (~is_object, "contract_validation_failed", F.lit("body is no object")),
        (F.size("__broken") > 0, "contract_validation_failed", F.concat_ws(",", "__broken")),
        (broken_totals(), "contract_validation_failed", F.lit("totals")),
        (skewed_clock(), "contract_validation_failed", F.lit("produced_at")),
        (~F.coalesce(version_ == 1, F.lit(False)), "unsupported_event_version", version_.cast("string")),
        (differs.isNotNull(), "header_body_mismatch", differs),
        (~F.lower(F.col("key").cast("string")).eqNullSafe(F.lower(ordering_key)), "key_body_mismatch", F.lit("key")),
    ]
    uuid_hint = lambda name: F.when(text_of("__body", name).rlike(_UUID), F.lower(text_of("__body", name)))
    # what several checks read is made once, as columns
    ready = parsed(records).withColumn("__headers", F.coalesce("headers", F.array().cast("array<struct<key:string,value:binary>>"))).withColumn("__broken", broken_fields())
    ready = ready.withColumns({"__names": F.col("__headers.key"), "__values": F.col("__headers.value")})
    ready = ready.withColumns({f"__header_{n}": _header(n) for n in SAFE_HEADERS} | {f"__body_{n}": F.element_at("__body", n).cast("string") for n in in_body} | {"__kind": text_of("__body", "event_type")}).withColumn("__version", version)
    found = F.coalesce(*[F.when(bad, F.struct(F.lit(name).alias("category"), F.coalesce(message, F.lit("")).alias("message"))) for bad, name, message in checks])
    anomaly = header("synthetic_anomaly")
    told = {
        "category": F.col("__found.category"), "message": F.left(F.col("__found.message"), F.lit(512)), "event_id_hint": uuid_hint("event_id"), "event_type_hint": kind,
        "correlation_id_hint": uuid_hint("correlation_id"), "anomaly": F.when(F.is_valid_utf8(anomaly), anomaly),
    }
    judged = ready.withColumn("__found", found).select(*records.columns, F.struct(*[c.alias(n) for n, c in told.items()]).alias("__told"))
    # exploded, so that a filter on what is found isn't pushed below it, where all checks would be computed once more;
    # it is made before, since a generator's own expressions run interpreted
    return judged.select(*records.columns, F.explode(F.array("__told")).alias("__told")).select(*records.columns, *[F.col(f"__told.{n}").alias(n) for n in told])


def safe_headers() -> Column:
    """A map of the allowed headers: the first of each name that has a value, cut to 256 characters, or a mark where it isn't UTF-8."""
    none = F.array().cast("array<struct<key:string,value:string>>")
    seen = F.filter(F.coalesce(F.col("headers"), F.array().cast("array<struct<key:string,value:binary>>")), lambda h: h["key"].isin(*SAFE_HEADERS) & h["value"].isNotNull())
    readable = F.transform(seen, lambda h: F.struct(h["key"].alias("key"), F.when(F.is_valid_utf8(h["value"].cast("string")), F.left(h["value"].cast("string"), F.lit(256))).otherwise("<invalid-utf8>").alias("value")))
    first = F.aggregate(readable, none, lambda acc, h: F.when(F.exists(acc, lambda a: a["key"] == h["key"]), acc).otherwise(F.concat(acc, F.array(h))))
    return F.map_from_entries(first)


def dead_letters(classified: DataFrame, failed_at: Column, attempts: int = 1, group: str = "processor", instance: str = "processor-1", most_bytes: int = 65_536) -> DataFrame:
    """The 21 columns of a dead letter for each record with a category; failed_at is the caller's clock."""
    bad = classified.where(F.col("category").isNotNull())
    identity = F.concat_ws(":", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"), "category")
    return bad.select(
        F.lit(1).alias("dlq_schema_version"), uuid5(DEAD_LETTERS, identity).alias("dlq_record_id"), failed_at.alias("failed_at"), F.col("topic").alias("source_topic"), F.col("partition").alias("source_partition"),
        F.col("offset").alias("source_offset"), F.col("timestamp").alias("source_timestamp"), F.base64("key").alias("source_key_base64"), safe_headers().alias("source_headers"),
        F.base64(F.substring("value", 1, most_bytes)).alias("original_value_base64"), F.coalesce(F.octet_length("value") > most_bytes, F.lit(False)).alias("original_value_truncated"),
        F.col("category").alias("error_category"), F.left("message", F.lit(512)).alias("error_message"), F.lit("ValidationError").alias("error_type"), F.lit(attempts).alias("processing_attempts"),
        F.lit(group).alias("consumer_group"), F.lit(instance).alias("processor_instance_id"), F.col("event_id_hint").alias("original_event_id"), F.col("event_type_hint").alias("original_event_type"),
        F.col("correlation_id_hint").alias("original_correlation_id"), F.col("anomaly").alias("anomaly_type"),
    )


def incomplete_letters(letters: DataFrame) -> DataFrame:
    """letters with missing: the required fields that are null or absent; a letter is complete if there are none."""
    known = [f for f in DEAD_LETTER_FIELDS if f in letters.columns]
    absent = F.array(*[F.lit(f) for f in DEAD_LETTER_FIELDS if f not in known]).cast("array<string>")
    return letters.withColumn("missing", F.concat(absent, F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in known]))))


def message_headers(event: dict[str, Column]) -> Column:
    """The six required headers of an event whose envelope fields are given."""
    values = {**{n: event[n].cast("string") for n in ("event_id", "event_type", "event_version", "correlation_id", "source")}, "content_type": F.lit("application/json")}
    return F.array(*[F.struct(F.lit(n).alias("key"), F.encode(v, "UTF-8").alias("value")) for n, v in values.items()])


def _canonical_value(kind: Column, value: Column, text: Column, time: Column) -> Column:
    """A value's JSON text in one form: ids in lower case with hyphens, times in UTC, money as text, others as they are parsed."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    bare = F.regexp_replace(F.lower(text), "urn:uuid:|[{}-]", "")
    shown = F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.unix_micros(time) % 1_000_000 != 0, F.date_format(time, ".SSSSSS")).otherwise(""), F.lit("Z"))
    special = (
        F.when(kind == "uuid", quoted(F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")))
        .when(kind == "time", quoted(shown)).when(kind.isin("money", "paid", "score"), quoted(text))
    )
    return F.when(F.is_variant_null(value), "null").otherwise(F.coalesce(special, F.to_json(value)))


def canonical(body: str = "__body", payload: str = "__payload") -> Column:
    """The canonical JSON of a parsed record: keys sorted at every level, nothing between, one form for each kind of value.

    Two texts of one event, whatever their spacing, order of keys, offsets of times or case of ids, give the same; null
    where the body or its payload is no object. Keys that the contract doesn't know keep their parsed value, whose own
    keys a variant holds in order.
    """
    kinds = _fields({f: kind_of(f) for f in sorted({*ENVELOPE, *" ".join(PAYLOADS.values()).split()} - {"payload"})})

    def listed(values: str, special: Column | None = None) -> Column:
        # a key's kind, text and time are looked up once, as columns of its entry
        known = F.transform(F.array_sort(F.map_keys(values)), lambda key: F.struct(key.alias("key"), F.coalesce(F.element_at(kinds, key), F.lit("other")).alias("kind"), F.element_at(values, key).alias("value")))
        timed = F.transform(known, lambda e: F.struct(
            e["key"].alias("key"), e["kind"].alias("kind"), e["value"].alias("value"), F.when(e["kind"] != "other", e["value"].cast("string")).alias("text"),
            F.when(e["kind"] == "time", F.to_utc_timestamp(F.try_to_timestamp(e["value"].cast("string")), F.current_timezone())).alias("time"),
        ))

        def entry(e: Column) -> Column:
            key = F.when(e["kind"] != "other", F.concat(F.lit('"'), e["key"], F.lit('"'))).otherwise(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2))
            shown = _canonical_value(e["kind"], e["value"], e["text"], e["time"])
            return F.concat(key, F.lit(":"), shown if special is None else F.when(e["key"] == "payload", special).otherwise(shown))

        return F.concat(F.lit("{"), F.array_join(F.transform(timed, entry), ","), F.lit("}"))

    return F.when(F.col(body).isNotNull() & F.col(payload).isNotNull(), listed(body, listed(payload)))


def with_canonical(records: DataFrame, store: bool = True) -> DataFrame:
    """records with event_id and event_type (in canonical form), body (canonical JSON, or {} where it isn't stored) and content_hash."""
    text = F.col("__json").cast("string")
    ready = parsed(records).withColumn("__canonical", F.when(plain(text), text).otherwise(canonical()))
    # exploded, so that what is computed here isn't computed again in every later use
    held = ready.select(*records.columns, F.explode(F.array(F.struct(F.col("__canonical").alias("c")))).alias("__c"))
    return held.select(
        *records.columns, F.get_json_object("__c.c", "$.event_id").alias("event_id"), F.get_json_object("__c.c", "$.event_type").alias("event_type"),
        (F.col("__c.c") if store else F.when(F.col("__c.c").isNotNull(), F.lit("{}"))).alias("body"), F.sha2("__c.c", 256).alias("content_hash"),
    )
