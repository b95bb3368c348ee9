"""Exact quantiles of groups by distributed selection.

Every wanted rank of a group has an interval of values that holds it. A round counts the values of each interval in bins
and goes on with the bin that holds the rank, cut to its least and greatest value, until those are equal. Bins are of
equal width in one round and of equal width in logarithms in the next, so neither dense nor far-flung values take many
rounds. The state is BINS rows a rank, whatever the number of values; nothing is sorted and no group meets in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonarm.storage import stored

BINS = 1_024


def _place(v, lo, hi, by_log: bool):
    """The bin of v between lo and hi; halves, so that no difference is beyond a double."""
    f = (lambda x: F.signum(x) * F.log1p(F.abs(x))) if by_log else (lambda x: x / 2)
    share = (f(v) - f(lo)) / (f(hi) - f(lo))
    return F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * BINS))).cast("int")


def exact_quantiles(df: DataFrame, value: str, probabilities: dict[str, float], by: str | None = None) -> DataFrame:
    """Rows (by, n, and a column for each of probabilities by name): linear between the values around p * (n - 1).

    Values that are null, NaN or infinite do not count; a group of none has no row, a null group is one. No group: one row, or none.
    """
    v = F.col(value).cast("double")
    rows = df.select((F.col(by) if by else F.lit(0)).alias("g"), v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    rows = stored(rows, "values")
    base = stored(rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "extremes")
    places = [F.lit(p) * (F.col("n") - 1) for p in probabilities.values()]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in places for f in (F.floor, F.ceil)]))
    state = base.select("g", F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"))
    by_log = False
    while True:
        state = stored(state, "ranks")
        open_ = state.where("lo < hi").select(F.col("g").alias("_g"), "rank", "lo", "hi", "below")
        if open_.isEmpty():
            break
        met = rows.join(open_, F.col("g").eqNullSafe(F.col("_g")) & F.col("v").between(F.col("lo"), F.col("hi")))
        bins = met.groupBy("g", "rank", "below", _place(F.col("v"), F.col("lo"), F.col("hi"), by_log).alias("bin"))
        bins = bins.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("g", "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = bins.withColumn("below", F.col("below") + before).where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n")))
        state = state.where("lo = hi").select("g", "rank", "lo", "hi", "below").union(bins.select("g", "rank", "lo", "hi", "below"))
        by_log = not by_log
    found = state.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("at"))  # two ranks a probability
    met = base.join(found.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g"))).select("g", "n", "at")

    def between(x):
        low, high = (F.element_at("at", f(x).cast("long")) for f in (F.floor, F.ceil))
        return low + (high - low) * (x - F.floor(x))

    return met.select(*([F.col("g").alias(by)] if by else []), "n", *[between(x).alias(name) for name, x in zip(probabilities, places, strict=True)])
