"""Fraud: as-of history features, ten rules, score, decision and severity, as window and struct expressions."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@dataclass(frozen=True)
class FraudConfig:
    """Thresholds of rules; windows in seconds. 0 <= review < block <= 100."""

    high_amount: int = 5000
    deviation: int = 3
    velocity_seconds: int = 120
    velocity_count: int = 3
    failure_seconds: int = 300
    failure_count: int = 3
    country_seconds: int = 600
    known_successes: int = 2
    rapid_seconds: int = 15
    takeover_signals: int = 4
    bot_views: int = 12
    refund_count: int = 3
    refund_days: int = 30
    rapid_refund_seconds: int = 600
    rapid_refund_count: int = 2
    history_days: int = 30
    newest: int = 500
    review: int = 30
    block: int = 60

    def __post_init__(self) -> None:
        if not 0 <= self.review < self.block <= 100:
            raise ValueError("thresholds must satisfy 0 <= review < block <= 100")
        if any(getattr(self, f.name) < 0 for f in fields(self)):
            raise ValueError("thresholds and windows are not negative")


#: For the given events, whose customers act about every seven hours.
EVENTS_CONFIG = FraudConfig(high_amount=150, velocity_seconds=86_400, failure_seconds=86_400, country_seconds=172_800, rapid_seconds=86_400, bot_views=2, refund_days=180, rapid_refund_seconds=2_592_000)


def payment_features(payments: DataFrame, events: DataFrame, cfg: FraudConfig = FraudConfig()) -> DataFrame:
    """A feature row for each payment, its history being all of the customer's rows up to its own event time.

    payments(payment_id, customer_id, status, amount, device, country, home, failure_reason, at_us); events(event_id,
    user_id, event_type, at_us) gives sessions (signup) and views. A payment counts itself in windows but not in its
    prior history. One shuffle by customer serves every window.
    """
    second = 1_000_000
    history = payments.select("*", F.lit("payment").alias("kind")).unionByName(
        events.where(F.col("event_type").isin("signup", "view")).select(
            F.col("event_id").alias("payment_id"), F.col("user_id").alias("customer_id"), "at_us", F.when(F.col("event_type") == "signup", "session").otherwise("view").alias("kind")
        ),
        allowMissingColumns=True,
    )
    last = lambda seconds: W.partitionBy("customer_id").orderBy("at_us").rangeBetween(-seconds * second, 0)
    so_far = W.partitionBy("customer_id").orderBy("at_us").rangeBetween(W.unboundedPreceding, 0)
    prior = W.partitionBy("customer_id").orderBy("at_us").rangeBetween(W.unboundedPreceding, -1)
    paid, failed, done = F.col("kind") == "payment", F.col("status") == "failed", F.col("status") == "completed"
    with_views = history.withColumn("views_so_far", F.count(F.when(F.col("kind") == "view", 1)).over(so_far))
    session = F.when(F.col("kind") == "session", F.struct("at_us", "views_so_far"))
    out = with_views.select(
        "*",
        F.max(session).over(so_far).alias("session"),
        F.count(F.when(paid, 1)).over(last(cfg.velocity_seconds)).alias("attempts"),
        F.count(F.when(failed, 1)).over(last(cfg.failure_seconds)).alias("failures"),
        F.size(F.collect_set(F.when(failed, F.col("failure_reason"))).over(last(cfg.failure_seconds))).alias("failure_reasons"),
        F.size(F.collect_set(F.when(paid, F.col("device"))).over(last(cfg.velocity_seconds))).alias("devices"),
        F.size(F.collect_set(F.when(paid, F.col("country"))).over(last(cfg.country_seconds))).alias("countries"),
        F.count(F.when(done, 1)).over(prior).alias("successes"),
        F.count(F.when(failed, 1)).over(prior).alias("prior_failures"),
        F.sum(F.when(done, F.col("amount"))).over(prior).cast("decimal(28,2)").alias("spend"),
        F.array_sort(F.collect_set(F.when(done, F.col("device"))).over(prior)).alias("known_devices"),
    ).where(paid)
    return out.select(
        "payment_id", "customer_id", "status", "amount", "device", "country", "home", "at_us", "attempts", "failures", "failure_reasons", "devices", "countries",
        "successes", "prior_failures", "spend", "known_devices",
        (F.col("views_so_far") - F.coalesce("session.views_so_far", F.lit(0))).alias("views"),
        F.greatest(F.lit(0), F.floor((F.col("at_us") - F.col("session.at_us")) / second)).cast("long").alias("checkout_seconds"),
        F.coalesce((F.size("known_devices") > 0) & ~F.array_contains("known_devices", F.col("device")), F.lit(False)).alias("is_new_device"),
        F.coalesce(F.col("country") != F.col("home"), F.lit(False)).alias("country_mismatch"),
    )


def _rule(rule_id: str, reason: str, matched: Column, score: Column | int, severity: Column | str) -> Column:
    hit = F.coalesce(matched, F.lit(False))
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(rule_id).alias("rule_id"), F.lit(reason).alias("reason_code"), hit.alias("matched"),
        F.when(hit, as_column(score)).otherwise(0).cast("int").alias("score"), F.when(hit, as_column(severity)).otherwise("LOW").alias("severity"),
    )


def payment_rules(cfg: FraudConfig) -> dict[str, Column]:
    """The rules that apply to payments, in registry order; each is a struct over a feature row. Null inputs never match."""
    c = F.col
    large, deviates = c("amount") >= cfg.high_amount, (c("spend") > 0) & (c("amount") * c("successes") >= cfg.deviation * c("spend"))
    yes = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    rapid, many = c("checkout_seconds") <= cfg.rapid_seconds, c("countries") > 1
    signals = yes(c("successes") > 0) + yes(c("is_new_device")) + yes(c("country_mismatch")) + yes(rapid) + yes(deviates)
    return {
        "high_amount": _rule("high_amount", "HIGH_AMOUNT", yes(large) + yes(deviates) > 0, F.least(F.lit(100), 25 * yes(large) + 20 * yes(deviates)), F.when(deviates, "HIGH").otherwise("MEDIUM")),
        "payment_velocity": _rule("payment_velocity", "PAYMENT_VELOCITY", c("attempts") >= cfg.velocity_count, 20, "MEDIUM"),
        "failed_payment_burst": _rule("failed_payment_burst", "FAILED_PAYMENT_BURST", c("failures") >= cfg.failure_count, 25, "HIGH"),
        "new_device": _rule("new_device", "NEW_DEVICE", (c("successes") >= cfg.known_successes) & c("is_new_device"), 15, "MEDIUM"),
        "country_mismatch": _rule("country_mismatch", "COUNTRY_MISMATCH", c("country_mismatch") | many, 10 * yes(c("country_mismatch")) + 10 * yes(many), F.when(many, "HIGH").otherwise("MEDIUM")),
        "rapid_checkout": _rule("rapid_checkout", "RAPID_CHECKOUT", rapid, 15, "MEDIUM"),
        "account_takeover_composite": _rule("account_takeover_composite", "ACCOUNT_TAKEOVER_PATTERN", signals >= cfg.takeover_signals, 60, "CRITICAL"),
        "bot_checkout": _rule("bot_checkout", "BOT_CHECKOUT_PATTERN", (c("views") >= cfg.bot_views) & rapid, 30, "MEDIUM"),
    }


def refund_features(refunds: DataFrame, orders: DataFrame, cfg: FraudConfig = FraudConfig()) -> DataFrame:
    """A feature row for each refund: refunds(order_id, seq, amount, requested_at), orders(order_id, customer_id, paid, paid_at).

    refundable is what was paid less all refunds of the order so far, this one included; recent counts the customer's
    refunds of the last refund_days up to this one's time. A refund without an order matches it (there is nothing to
    differ from), has no refundable amount and no customer, so no recent refunds.
    """
    money = "decimal(28,2)"
    so_far = F.sum("amount").over(W.partitionBy("order_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    placed = refunds.withColumn("refunded", so_far).join(orders, "order_id", "left").withColumn("at_s", F.unix_seconds(F.col("requested_at").cast("timestamp")))
    # orphans have no customer: by their order they make no group of their own that all of them share
    own = W.partitionBy("customer_id", F.when(F.col("customer_id").isNull(), F.col("order_id"))).orderBy("at_s").rangeBetween(-cfg.refund_days * 86_400, 0)
    recent = F.when(F.col("customer_id").isNotNull(), F.count("*").over(own)).otherwise(0)
    return placed.select(
        "order_id", "seq", "customer_id", "amount", (F.col("paid") - F.col("refunded")).cast(money).alias("refundable"),
        F.when(F.col("paid_at").isNotNull(), F.greatest(F.lit(0), F.col("at_s") - F.unix_seconds(F.col("paid_at").cast("timestamp")))).alias("since_payment"),
        recent.alias("recent_refunds"), F.coalesce(F.col("amount") == F.col("paid"), F.lit(True)).alias("amount_matches_order"),
    )


def refund_rules(cfg: FraudConfig) -> dict[str, Column]:
    """The rules that only refunds have features for, in registry order; each is a struct over a refund's feature row."""
    c = F.col
    near_full = (c("refundable") > 0) & (c("amount") * 10 >= c("refundable") * 9)
    rapid = (c("since_payment") <= cfg.rapid_refund_seconds) & near_full & (c("recent_refunds") >= cfg.rapid_refund_count)
    return {
        "refund_abuse": _rule("refund_abuse", "REFUND_ABUSE_PATTERN", (c("recent_refunds") >= cfg.refund_count) | F.coalesce(rapid, F.lit(False)), 35, "HIGH"),
        "payment_amount_mismatch": _rule("payment_amount_mismatch", "PAYMENT_AMOUNT_MISMATCH", ~c("amount_matches_order"), 100, "CRITICAL"),
    }


#: The event types of each rule, and the most it may score.
PAYMENTS = ("payment_completed", "payment_failed")
PURCHASES = ("checkout_started", "order_created", *PAYMENTS)
RULES = {
    "high_amount": ((*PURCHASES, "refund_requested"), 100), "payment_velocity": (PAYMENTS, 20), "failed_payment_burst": (PAYMENTS, 25), "new_device": (PAYMENTS, 15),
    "country_mismatch": (("order_created", *PAYMENTS), 20), "rapid_checkout": (PURCHASES, 15), "account_takeover_composite": (PURCHASES, 60), "bot_checkout": (PURCHASES, 30),
    "refund_abuse": (("refund_requested",), 35), "payment_amount_mismatch": ((*PURCHASES, "refund_requested"), 100),
}


def gated(rules: dict[str, Column]) -> dict[str, Column]:
    """The rules, each null (absent from the results) where event_type is none of its types."""
    return {name: F.when(F.col("event_type").isin(*RULES[name][0]), rule) for name, rule in rules.items()}


def over_limit(evaluations: DataFrame) -> DataFrame:
    """(rule_id, n): results that score more than their rule may, a fault of its configuration; no rows if all is well."""
    limit = F.create_map(*(F.lit(x) for name, (_, most) in RULES.items() for x in (name, most)))
    found = evaluations.select(F.explode("results").alias("r")).where(F.col("r.score") > F.element_at(limit, F.col("r.rule_id")))
    return found.groupBy("r.rule_id").agg(F.count("*").alias("n"))


def evaluation_conflicts(stored: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """Evaluations of one source event that differ in score, decision, severity or results: (key, stored_decision, decision).

    Equal ones are no conflict; events that only one side has aren't compared.
    """
    content = lambda side: F.struct(*(F.col(f"{side}.{c}") for c in ("score", "decision", "severity", "results")))
    both = stored.alias("a").join(again.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"))
    return both.where(~content("a").eqNullSafe(content("b"))).select(F.col(f"a.{key}").alias(key), F.col("a.decision").alias("stored_decision"), F.col("b.decision").alias("decision"))


#: Severities in ascending order.
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def evaluate(features: DataFrame, rules: dict[str, Column], cfg: FraudConfig, enabled: list[str] | None = None) -> DataFrame:
    """features with results (array of rule structs), score, decision, severity, matched_rules and reason_codes.

    enabled names the rules to run, in registry order; unknown and repeated names are errors.
    """
    names = list(rules) if enabled is None else enabled
    if len(set(names)) < len(names) or set(names) - set(rules):
        raise ValueError(f"unknown or repeated rule in {names}")
    order = F.array(*map(F.lit, SEVERITIES))
    scored = features.withColumn("results", F.array_compact(F.array(*(r for n, r in rules.items() if n in names)))).withColumn(
        "score", F.least(F.lit(100), F.aggregate("results", F.lit(0), lambda a, r: a + r["score"]))
    )
    decided = scored.withColumn("decision", F.when(F.col("score") >= cfg.block, "BLOCK").when(F.col("score") >= cfg.review, "REVIEW").otherwise("APPROVE"))
    hits = F.filter("results", lambda r: r["matched"])
    floor = F.when(F.col("decision") == "BLOCK", 3).when(F.col("decision") == "REVIEW", 2).otherwise(1)
    worst = F.aggregate(hits, F.lit(1), lambda a, r: F.greatest(a, F.array_position(order, r["severity"]).cast("int")))
    return decided.withColumn("severity", F.element_at(order, F.greatest(worst, floor))).withColumn("matched_rules", F.size(hits)).withColumn(
        "reason_codes", F.concat_ws(",", F.transform(hits, lambda r: r["reason_code"]))
    )


def alerts(evaluations: DataFrame) -> DataFrame:
    """One OPEN alert for each evaluation that isn't approved."""
    return evaluations.where("decision <> 'APPROVE'").select("payment_id", "customer_id", "score", "decision", "severity", "reason_codes", F.lit("OPEN").alias("status"))
