"""Exact percentiles of very large groups: ranges of values are counted, and only the range that holds a rank is looked at again.

No window, percentile state or sort ever sees a whole group. A pass counts, for each open interval, the rows in ``BUCKETS``
parts of it, or by magnitude (summed in the tasks first), and the part that holds the rank becomes the next interval, with its own
least and greatest value as ends. When an interval has at most ``few`` rows, or one value, its rows are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.shared import kept

#: Parts of an interval: rows of the small tables for each open interval and pass.
BUCKETS = 2048


def values_at(rows: DataFrame, wanted: DataFrame, few: int = 100_000) -> DataFrame:
    """rows(key, value double), wanted(key, rank from 0) -> (key, rank, value): the value at each rank of its key.

    Nulls and NaN are no values; null keys are a key of their own; ranks outside a key's rows give no row. Equal values
    take neighbouring ranks. The tables between passes have a row for each wanted rank.
    """
    values = rows.where(F.col("value").isNotNull() & ~F.isnan("value")).select("key", F.col("value").cast("double").alias("value"))
    ends = values.groupBy("key").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("size")).withColumn("before", F.lit(0).cast("long"))
    state = wanted.select("key", F.col("rank").cast("long").alias("rank")).distinct().alias("w").join(ends.alias("e"), F.col("w.key").eqNullSafe(F.col("e.key"))).where("rank >= 0 and rank < size")
    state = kept(state.select("w.key", "rank", "low", "high", "size", "before"), "ranks")
    opened = (F.col("size") > few) & (F.col("low") < F.col("high"))
    while state.where(opened).limit(1).count():
        intervals = state.where(opened).select(F.col("key").alias("of"), "low", "high").distinct()
        met = values.join(intervals, F.col("key").eqNullSafe(F.col("of")) & F.col("value").between(F.col("low"), F.col("high")))
        # an interval of several magnitudes is parted by sign and binary exponent, one of a single magnitude evenly (a
        # double's 52 digits take five such passes); by halves where the difference overflows; rounding keeps the order
        small, large = F.least(F.abs("low"), F.abs("high")), F.greatest(F.abs("low"), F.abs("high"))
        apart = ((F.col("low") <= 0) & (F.col("high") >= 0)) | (large / 4 > small)
        magnitude = F.when(F.col("value") == 0, F.lit(0)).otherwise(F.signum("value") * (F.floor(F.log2(F.abs("value"))) + 1100)).cast("long")
        width, half = F.col("high") - F.col("low"), lambda c: F.col(c) / 2
        share = F.when(width < F.lit(float("inf")), (F.col("value") - F.col("low")) / width).otherwise((half("value") - half("low")) / (half("high") - half("low")))
        part = F.when(apart, magnitude).otherwise(F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS)))
        parts = met.groupBy("of", "low", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"))
        before = F.sum("n").over(W.partitionBy("of", "low").orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # some thousand rows
        parts = parts.withColumn("less", F.coalesce(before, F.lit(0))).select("of", F.col("low").alias("from"), "n", "least", "greatest", "less")
        found = state.where(opened).join(parts, F.col("key").eqNullSafe(F.col("of")) & (F.col("low") == F.col("from"))).where(
            (F.col("rank") >= F.col("before") + F.col("less")) & (F.col("rank") < F.col("before") + F.col("less") + F.col("n"))
        )
        smaller = found.select("key", "rank", F.col("least").alias("low"), F.col("greatest").alias("high"), F.col("n").alias("size"), (F.col("before") + F.col("less")).alias("before"))
        state = kept(state.where(~opened).unionByName(smaller), "ranks")
    known = state.where("low = high").select("key", "rank", F.col("low").alias("value"))
    rest = state.where("low < high")
    intervals = rest.select(F.col("key").alias("of"), "low", "high", "before").distinct()
    near = values.join(intervals, F.col("key").eqNullSafe(F.col("of")) & F.col("value").between(F.col("low"), F.col("high")))
    place = F.row_number().over(W.partitionBy("of", "low").orderBy("value")) - 1  # at most ``few`` rows
    ranked = near.select("of", F.col("low").alias("from"), "value", (F.col("before") + place).alias("place"))
    looked = rest.join(ranked, F.col("key").eqNullSafe(F.col("of")) & (F.col("low") == F.col("from")) & (F.col("rank") == F.col("place")))
    return known.unionByName(looked.select("key", "rank", "value"))


def percentiles(rows: DataFrame, levels: dict[str, float], nearest: bool = False, few: int = 100_000) -> DataFrame:
    """rows(key, value) -> key, n and a column for each level: interpolated, or at the nearest rank (halves to even).

    Interpolated: at position level (n - 1), between its two neighbours. A key without values gives no row.
    """
    values = rows.where(F.col("value").isNotNull() & ~F.isnan("value"))
    sizes = kept(values.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "sizes")
    position = {name: F.lit(float(level)) * (F.col("n") - 1) for name, level in levels.items()}
    ranks: list[Column] = [r.cast("long") for p in position.values() for r in ([F.bround(p)] if nearest else [F.floor(p), F.ceil(p)])]
    found = values_at(rows, sizes.select("key", F.explode(F.array(*ranks)).alias("rank")), few)
    by_rank = found.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))  # a few ranks a key
    joined = sizes.alias("s").join(by_rank.alias("f"), F.col("s.key").eqNullSafe(F.col("f.key"))).select("s.key", "n", "at")

    def level(p: Column) -> Column:
        if nearest:
            return F.element_at("at", F.bround(p).cast("long"))
        low, high = F.element_at("at", F.floor(p).cast("long")), F.element_at("at", F.ceil(p).cast("long"))
        return low + (high - low) * (p - F.floor(p))

    return joined.select("key", "n", *[level(p).alias(name) for name, p in position.items()])
