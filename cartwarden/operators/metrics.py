"""Labelled time series: selectors, values at evaluation times, aggregation by labels, alert rules with pending and firing spans.

Samples are rows (metric string, labels map<string,string>, at_us long, value double) at uneven times. Everything is
evaluated at ticks: multiples of a step in microseconds; tick n sees samples up to and including n * step. Rows are
reduced to one a series and tick before anything is spread over ticks, so that what follows grows with series and time,
not with samples. Rows without a metric, time or value are left out, null labels are no labels, repeated samples count
once, and an empty frame gives no rows.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Ticks that a window over one series spans; what the chunk before ended with is joined.
CHUNK = 4096
COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne}


@dataclass(frozen=True)
class Selector:
    """Samples of a metric whose labels equal, differ from, match or don't match (whole value); an absent label is empty."""

    metric: str
    equal: Mapping[str, str] = field(default_factory=dict)
    unequal: Mapping[str, str] = field(default_factory=dict)
    like: Mapping[str, str] = field(default_factory=dict)
    unlike: Mapping[str, str] = field(default_factory=dict)

    def condition(self) -> Column:
        label = lambda name: F.coalesce(F.element_at("labels", F.lit(name)), F.lit(""))
        found = F.col("metric") == self.metric
        for name, value in self.equal.items():
            found &= label(name) == value
        for name, value in self.unequal.items():
            found &= label(name) != value
        for name, pattern in self.like.items():
            found &= label(name).rlike(f"^(?:{pattern})$")
        for name, pattern in self.unlike.items():
            found &= ~label(name).rlike(f"^(?:{pattern})$")
        return F.coalesce(found, F.lit(False))


@dataclass(frozen=True)
class Expression:
    """A value for each group of labels and tick.

    take: ``last`` (newest sample within the lookback), ``rate`` (increase a second over ``window_s``; a fall is a reset,
    a series' first sample its base, nothing is extrapolated) or ``quantile`` (``level`` of a histogram's rates by ``le``).
    over: sum, max, min, avg or count of the series of a group; None keeps each series. by: the labels of a group.
    """

    selector: Selector
    take: str = "last"
    window_s: int = 300
    over: str | None = "sum"
    by: tuple[str, ...] = ()
    level: float = 0.95

    def __post_init__(self) -> None:
        if self.take not in ("last", "rate", "quantile") or self.over not in ("sum", "max", "min", "avg", "count", None):
            raise ValueError(f"unknown form: {self.take}, {self.over}")


def shown(labels: Column) -> Column:
    """Sorted label entries as text: ``a=1,b=2``."""
    return F.array_join(F.transform(labels, lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


def _with_increase(samples: DataFrame) -> DataFrame:
    """Samples with grown: the increase since the series' sample before, across chunks of ticks."""
    series, order = ["metric", "series", "chunk"], F.struct("at_us", "value")
    ends = samples.groupBy(*series).agg(F.max_by("value", order).alias("last"))
    carried = ends.withColumn("carried", F.lag("last").over(W.partitionBy("metric", "series").orderBy("chunk"))).drop("last")
    placed = samples.withColumn("before", F.lag("value").over(W.partitionBy(*series).orderBy("at_us", "value"))).join(carried, series)
    before = F.coalesce("before", "carried")
    return placed.withColumn("grown", F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before))


def _over(kind: Column, value: str) -> Column:
    """The named aggregate of a group's values."""
    return F.when(F.first(kind) == "max", F.max(value)).when(F.first(kind) == "min", F.min(value)).when(F.first(kind) == "avg", F.avg(value)).when(F.first(kind) == "count", F.count(value)).otherwise(F.sum(value))


def _quantile(level: Column, buckets: Column) -> Column:
    """Linear within the bucket (le, count up to le) that holds the rank; beyond the last bound, the last bound; null without counts."""
    n = F.size(buckets)
    rank = level * F.get(buckets, n - 1)["total"]
    i = F.size(F.filter(buckets, lambda b: b["total"] < rank))
    low, below = F.when(i == 0, 0.0).otherwise(F.get(buckets, i - 1)["le"]), F.when(i == 0, 0.0).otherwise(F.get(buckets, i - 1)["total"])
    high = F.get(buckets, i)
    inside = F.when((i == 0) & (high["le"] <= 0), high["le"]).otherwise(low + (high["le"] - low) * (rank - below) / (high["total"] - below))
    return F.when(~(rank > 0), None).when(high["le"] == float("inf"), F.when(i == 0, None).otherwise(low)).otherwise(inside)


def evaluated(samples: DataFrame, expressions: Mapping[str, Expression], step_us: int, lookback_us: int = 300_000_000) -> DataFrame:
    """(name, group, tick, value) of each named expression at every tick up to the newest selected sample's; group: sorted entries.

    The lookback and every window are multiples of the step. Ticks at which a group has no sample have no row.
    """
    wanted = []
    for name, e in expressions.items():
        span = lookback_us if e.take == "last" else e.window_s * 1_000_000
        if span % step_us:
            raise ValueError(f"{name}: {span} is no multiple of the step")
        form = F.struct(
            F.lit(name).alias("name"), F.lit(e.take).alias("take"), F.lit(span // step_us).cast("long").alias("ticks"), F.lit(float(e.window_s)).alias("window_s"), F.lit(e.over or "each").alias("over"),
            F.array(*map(F.lit, e.by)).cast("array<string>").alias("by"), F.lit(e.level).alias("level"),
        )
        wanted.append(F.when(e.selector.condition(), form))
    named = F.col("metric").isin(*sorted({e.selector.metric for e in expressions.values()}))  # sources of other metrics are pruned
    sound = samples.where("metric IS NOT NULL AND at_us IS NOT NULL AND value IS NOT NULL").withColumn("labels", F.coalesce("labels", F.create_map().cast("map<string,string>")))
    cell = F.ceil(F.col("at_us") / step_us)
    rows = sound.select("metric", F.array_sort(F.map_entries("labels")).alias("series"), F.filter(F.array(*wanted), lambda f: f.isNotNull()).alias("forms"), "at_us", "value", cell.alias("cell")).where(named & (F.size("forms") > 0))
    end = rows.agg(F.max("cell").alias("end"))  # one row
    if any(e.take != "last" for e in expressions.values()):
        rows = _with_increase(rows.withColumn("chunk", F.floor(F.col("cell") / CHUNK)))
    else:
        rows = rows.withColumn("grown", F.lit(0.0))
    cells = rows.groupBy("metric", "series", "forms", "cell").agg(F.max_by("value", F.struct("at_us", "value")).alias("value"), F.sum("grown").alias("grown"))
    spread = cells.select("metric", "series", F.explode("forms").alias("f"), "cell", "value", "grown").join(F.broadcast(end)).select(
        "metric", "series", "f", "cell", "value", "grown", F.explode(F.sequence(F.col("cell"), F.least(F.col("cell") + F.col("f.ticks") - 1, F.col("end")))).alias("tick")
    )
    at_tick = spread.groupBy("metric", "series", "f", "tick").agg(F.max_by("value", "cell").alias("last"), F.sum("grown").alias("grown"))
    series = at_tick.select("f", "tick", "series", F.when(F.col("f.take") == "last", F.col("last")).otherwise(F.col("grown")).alias("value"))
    is_quantile = F.col("f.take") == "quantile"
    group = F.when(F.col("f.over") == "each", F.filter("series", lambda e: ~is_quantile | (e["key"] != "le"))).otherwise(F.filter("series", lambda e: F.array_contains("f.by", e["key"])))
    le = F.when(is_quantile, F.regexp_replace(F.get(F.filter("series", lambda e: e["key"] == "le"), 0)["value"], r"^\+Inf$", "Infinity").try_cast("double"))
    grouped = series.select("f", "tick", group.alias("group"), le.alias("le"), "value").where(~is_quantile | F.col("le").isNotNull())
    by_bound = grouped.groupBy("f", "group", "tick", "le").agg(F.when(F.first(F.col("f.take")) == "quantile", F.sum("value")).otherwise(_over(F.col("f.over"), "value")).alias("value"))
    buckets = F.array_sort(F.collect_list(F.struct("le", F.col("value").alias("total"))))  # as many as a histogram has bounds
    done = by_bound.groupBy("f", "group", "tick").agg(buckets.alias("buckets"))
    only, is_rate = F.get("buckets", 0)["total"], (F.col("f.take") == "rate") & (F.col("f.over") != "count")
    # increases are divided by the seconds last: whole numbers stay exact in any order of adding
    value = F.when(is_quantile, _quantile(F.col("f.level"), F.col("buckets"))).when(is_rate, only / F.col("f.window_s")).otherwise(only)
    return done.select(F.col("f.name").alias("name"), "group", "tick", value.alias("value")).where("value IS NOT NULL")


def folded(values: DataFrame, over: str, by: Sequence[str] = ()) -> DataFrame:
    """Evaluated values aggregated once more by fewer labels: the number of groups of groups, say."""
    group = F.filter("group", lambda e: e["key"].isin(*by) if by else F.lit(False))
    return values.select("name", group.alias("group"), "tick", "value").groupBy("name", "group", "tick").agg(_over(F.lit(over), "value").cast("double").alias("value"))


@dataclass(frozen=True)
class Condition:
    """An expression against a threshold."""

    expression: Expression
    compare: str
    threshold: float


@dataclass(frozen=True)
class AlertRule:
    """Fires for a group of labels once any of its conditions has held at every tick for ``hold_s`` seconds."""

    name: str
    severity: str
    hold_s: int
    any_of: tuple[Condition, ...]


def _up(job: str) -> Condition:
    return Condition(Expression(Selector("up", {"job": job}), over=None), "==", 0)


#: The eight rules with their thresholds and times.
RULES = (
    AlertRule("ProcessorDown", "critical", 60, (_up("event-processor"),)),
    AlertRule("HighConsumerLag", "warning", 120, (Condition(Expression(Selector("consumer_lag")), ">", 100),)),
    AlertRule("HighDLQRate", "warning", 60, (Condition(Expression(Selector("deliveries_total", {"result": "dlq"}), "rate"), ">", 0.1),)),
    AlertRule("DatabaseUnavailable", "critical", 60, (_up("postgres-exporter"), Condition(Expression(Selector("database_healthy"), over=None), "==", 0))),
    AlertRule("RedisUnavailable", "critical", 60, (_up("redis-exporter"),)),
    AlertRule("FraudOutboxBacklog", "warning", 120, (Condition(Expression(Selector("outbox_pending")), ">", 20), Condition(Expression(Selector("outbox_oldest_seconds"), over="max"), ">", 120))),
    AlertRule("OutboxPublicationFailures", "warning", 60, (Condition(Expression(Selector("publications_total", like={"result": "failed|kafka_error|database_error"}), "rate"), ">", 0),)),
    AlertRule("HighProcessingLatency", "warning", 120, (Condition(Expression(Selector("handling_seconds_bucket"), "quantile", level=0.95), ">", 2),)),
)


def rule_states(samples: DataFrame, rules: Sequence[AlertRule], step_us: int, lookback_us: int = 300_000_000) -> DataFrame:
    """(rule, group, tick, value) where a condition holds; of several conditions the first one's value is shown."""
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("two rules have one name")
    parts = [(f"{i}.{j}", r, c, j) for i, r in enumerate(rules) for j, c in enumerate(r.any_of)]
    values = evaluated(samples, {key: c.expression for key, _, c, _ in parts}, step_us, lookback_us)
    holds = F.coalesce(*[F.when((F.col("name") == key) & COMPARE[c.compare](F.col("value"), F.lit(float(c.threshold))), F.struct(F.lit(r.name).alias("rule"), F.lit(j).alias("place"))) for key, r, c, j in parts])
    true = values.withColumn("held", holds).where("held IS NOT NULL")
    return true.groupBy(F.col("held.rule").alias("rule"), "group", "tick").agg(F.min_by("value", "held.place").alias("value"))


def alert_spans(states: DataFrame, rules: Sequence[AlertRule], step_us: int) -> DataFrame:
    """Spans of consecutive ticks at which a rule holds for a group: pending from the first, firing once held long enough.

    (rule, severity, labels, pending_us, firing_us, last_us, ticks, peak); firing_us is null where the span ended first.
    """
    known = F.create_map(*(F.lit(x) for r in rules for x in (r.name, r.hold_s * 1_000_000)))
    severity = F.create_map(*(F.lit(x) for r in rules for x in (r.name, r.severity)))
    # a row a tick: bounded by time, whatever the number of samples
    island = F.col("tick") - F.row_number().over(W.partitionBy("rule", "group").orderBy("tick"))
    spans = states.withColumn("island", island).groupBy("rule", "group", "island").agg(F.min("tick").alias("a"), F.max("tick").alias("b"), F.count("*").alias("ticks"), F.max("value").alias("peak"))
    fires = F.col("a") + F.ceil(F.element_at(known, F.col("rule")) / step_us)
    return spans.select(
        "rule", F.element_at(severity, F.col("rule")).alias("severity"), shown(F.col("group")).alias("labels"), (F.col("a") * step_us).alias("pending_us"), F.when(fires <= F.col("b"), fires * step_us).alias("firing_us"),
        (F.col("b") * step_us).alias("last_us"), "ticks", "peak",
    )
