"""Summaries of sampled series: gauges, maps of counts, rates from first to last, recovery after a peak, phases of a transaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The stages of a transaction that write, and the others that are told by themselves.
WRITES = ("processed_events_insert", "business_persistence", "fraud_persistence")
SINGLE = {"read_phase_ms": "fraud_context", "commit_ms": "commit", "pool_acquire_ms": "pool_acquire", "connection_release_ms": "connection_release"}


def series_summary(samples: DataFrame, key: str, order: Sequence[str], seconds: str, active: str, gauges: Sequence[str], totals: Sequence[str] = (), peaks: Sequence[str] = (), counters: Sequence[str] = ()) -> DataFrame:
    """One row a key over the samples with active > 0.

    sample_count (all samples), considered_count, <gauge>_avg and <gauge>_max, <map>_totals and <map>_peaks (entries
    summed or at their most, as an array of (n, name) from the greatest down, equal ones by name), and per_second: the
    counters' growth from the first to the last considered sample along ``order``, over the growth of ``seconds``; null
    for fewer than two samples or no time. A null activity isn't considered; null maps, names and counts add nothing; a
    key without considered samples has nulls and empty arrays. Maps are spread and summed by name before they are put
    together, so that a row grows with distinct names, not with samples.
    """
    used = F.coalesce(F.col(active) > 0, F.lit(False))
    when = lambda c: F.when(used, F.col(c))
    at = F.when(used, F.struct(*order, F.struct(F.col(seconds).alias("s"), *counters).alias("__at")))
    base = samples.groupBy(key).agg(
        F.count("*").alias("sample_count"), F.count_if(used).alias("considered_count"), *[f(when(g)).alias(f"{g}_{n}") for g in gauges for f, n in ((F.avg, "avg"), (F.max, "max"))],
        F.min(at).alias("__first"), F.max(at).alias("__last"),
    )
    grown = sum((F.col(f"__last.__at.{c}") - F.col(f"__first.__at.{c}") for c in counters), F.lit(0)) if counters else F.lit(None).cast("double")
    passed = F.col("__last.__at.s") - F.col("__first.__at.s")
    found = base.withColumn("per_second", F.when((F.col("considered_count") >= 2) & (passed > 0), grown / passed)).drop("__first", "__last")
    wanted = [(c, "totals") for c in totals] + [(c, "peaks") for c in peaks]
    if not wanted:
        return found
    entry = lambda family: lambda e: F.struct(F.lit(family).alias("family"), e["key"].cast("string").alias("name"), e["value"].cast("long").alias("n"))
    entries = F.concat(*[F.coalesce(F.transform(F.map_entries(c), entry(f"{c}_{kind}")), F.array()) for c, kind in wanted])
    spread = samples.where(used).select(F.col(key).alias("__key"), F.explode(entries).alias("e")).where("e.n IS NOT NULL AND e.name IS NOT NULL")
    spread = spread.groupBy("__key", "e.family", "e.name").agg(F.sum("e.n").alias("total"), F.max("e.n").alias("peak"))
    n = F.when(F.col("family").endswith("_totals"), F.col("total")).otherwise(F.col("peak"))
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-n).alias("m"), "name"))), lambda x: F.struct((-x["m"]).alias("n"), x["name"].alias("name")))
    lists = spread.groupBy("__key", "family").agg(ranked.alias("list"))
    wide = lists.groupBy("__key").agg(*[F.max(F.when(F.col("family") == f"{c}_{kind}", F.col("list"))).alias(f"{c}_{kind}") for c, kind in wanted])
    joined = found.join(wide, found[key].eqNullSafe(wide["__key"]), "left").drop("__key")
    return joined.withColumns({f"{c}_{kind}": F.coalesce(f"{c}_{kind}", F.array()) for c, kind in wanted})


def recovery(samples: DataFrame, key: str, at: str, value: str, tolerance: float = 2) -> DataFrame:
    """(key, baseline, peak, peak_at, recovered_at, drain_rate): how a lag came back after its first peak.

    baseline: the first sample's value; recovered_at: the first later time at which the value is within the tolerance of
    it; drain_rate: (peak - baseline) per unit of time until then; both null where the lag stays up. Null values are no
    samples; of equal times the least value counts first. Three aggregates, no window over a key.
    """
    rows = samples.where(F.col(value).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias(key), F.col(at).alias("at"), F.col(value).alias("value"))
    ends = rows.groupBy(key).agg(F.min(F.struct("at", "value"))["value"].alias("baseline"), F.max(F.struct("value", (-F.col("at")).alias("back"))).alias("top"))
    tops = ends.select(F.col(key).alias("of"), "baseline", F.col("top.value").alias("peak"), (-F.col("top.back")).alias("peak_at"))
    back = (F.col("at") > F.col("peak_at")) & (F.col("value") <= F.col("baseline") + tolerance)
    found = rows.join(tops, F.col(key).eqNullSafe(F.col("of"))).groupBy(key, "baseline", "peak", "peak_at").agg(F.min(F.when(back, F.col("at"))).alias("recovered_at"))
    return found.withColumn("drain_rate", (F.col("peak") - F.col("baseline")) / (F.col("recovered_at") - F.col("peak_at")))


def phase_groups(averages: DataFrame, key: str) -> DataFrame:
    """averages(key, stage, avg_ms), one a stage -> read, write and commit phases, and what no phase accounts for.

    The write phase sums the writing stages that are there. unattributed_ms: the transaction's total less the known
    phases; null without a total or any phase. Of repeated stages the greatest average counts.
    """
    stage = lambda s: F.max(F.when(F.col("stage") == s, F.col("avg_ms")))
    wide = averages.groupBy(key).agg(*[stage(s).alias(n) for n, s in SINGLE.items()], *[stage(s).alias(f"__{s}") for s in WRITES], stage("transaction_total").alias("transaction_total_ms"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    writes = F.when(F.coalesce(*[f"__{s}" for s in WRITES]).isNotNull(), sum((zero(f"__{s}") for s in WRITES), F.lit(0.0)))
    told = wide.withColumn("write_phase_ms", writes)
    known = [*SINGLE, "write_phase_ms"]
    rest = F.when(F.coalesce(*known).isNotNull(), F.col("transaction_total_ms") - sum((zero(c) for c in known), F.lit(0.0)))
    return told.withColumn("unattributed_ms", rest).select(key, "read_phase_ms", "write_phase_ms", "commit_ms", "pool_acquire_ms", "connection_release_ms", "transaction_total_ms", "unattributed_ms")
