"""Scalings, weights, smoothing and histograms of value columns.

Nulls are left out; groups without a spread keep the value each docstring names; windows are by group or over bins, never
over a whole table on one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tabulon.operators.robust import median_by
from tabulon.sources.adapter import running

NNET = 1.7182818284590453  # fixed value: e - 1


def robust_z(df: DataFrame, which: str, by: str) -> DataFrame:
    """(x - median) / (1.4826 median deviation) in each group; 0 where the deviation is 0."""
    med = median_by(df, which, [by])
    dev = df.join(med, by).withColumn("_d", F.abs(F.col(which) - F.col("med")))
    mad = median_by(dev, "_d", [by]).withColumnRenamed("med", "_mad")
    return dev.join(mad, by).withColumn("robust_z", F.when(F.col("_mad") > 0, (F.col(which) - F.col("med")) / (1.4826 * F.col("_mad"))).otherwise(0.0)).drop("_d", "_mad", "med")


def at_ranks(df: DataFrame, which: str, by: str, places: dict[str, Column]) -> DataFrame:
    """by, n and the values at 1-based places (of the group's size `n`) of each group's ascending order."""
    g = df.groupBy(by, F.col(which).alias("_x")).agg(F.count("*").alias("_n"))
    c = running(g, [by, "_x"], ["_n"])
    total = c.groupBy(by).agg(F.max("cum__n").alias("_end"), F.sum("_n").alias("n"))
    rows = c.join(total, by).withColumn("_place", F.col("cum__n") - (F.col("_end") - F.col("n")))
    return rows.groupBy(by, "n").agg(*(F.min(F.when(F.col("_place") >= p, F.col("_x"))).alias(k) for k, p in places.items()))


def robust_scaled(df: DataFrame, which: str, by: str) -> DataFrame:
    """(x - median) / (third quartile - first), quartiles by place; groups of fewer than four, or without a spread, keep their values."""
    q = at_ranks(df, which, by, {"_q1": F.ceil(F.col("n") / 4), "_q3": F.ceil(3 * F.col("n") / 4)})
    rows = df.join(q, by).join(median_by(df, which, [by]), by)
    spread = F.col("_q3") - F.col("_q1")
    return rows.withColumn("scaled", F.when((F.col("n") >= 4) & (spread > 0), (F.col(which) - F.col("med")) / spread).otherwise(F.col(which))).drop("_q1", "_q3", "n", "med")


def sigmoid_share(share: Column) -> Column:
    """A share in [0, 1] on an exponential scale."""
    return (F.exp(share) - 1) / NNET


def centroid_weight(n: Column, r: Column) -> Column:
    """The rank-order centroid: (1 / n) times the sum of 1 / k for k from r to n."""
    return F.aggregate(F.sequence(r, n), F.lit(0.0), lambda a, k: a + 1.0 / k) / n


def standard_difference(df: DataFrame, which: str, second: Column) -> DataFrame:
    """The difference of two samples' means over the root of their mean variance."""
    s = df.agg(*(f(F.when(c, F.col(which))).alias(a + b) for b, c in (("1", ~second), ("2", second)) for a, f in (("m", F.avg), ("s", F.stddev_samp))))
    return s.select(F.round(F.abs(F.col("m1") - F.col("m2")) / F.sqrt(0.5 * (F.col("s1") ** 2 + F.col("s2") ** 2)), 6).alias("smd"))


def histogram_moments(hist: DataFrame, centre: Column) -> DataFrame:
    """Mean, variance and skewness of a histogram by bin centres, and its mode (the centre of the first fullest bin)."""
    rows = hist.select(centre.alias("c"), "cnt")
    m = rows.agg(F.sum("cnt").alias("n"), (F.sum(F.col("c") * F.col("cnt")) / F.sum("cnt")).alias("mean"), F.min_by("c", F.struct(-F.col("cnt"), F.col("c"))).alias("hmode"))
    d = F.col("c") - F.col("mean")
    both = rows.join(F.broadcast(m)).groupBy("n", "mean", "hmode").agg((F.sum(d * d * F.col("cnt")) / F.first("n")).alias("var"), (F.sum(d * d * d * F.col("cnt")) / F.first("n")).alias("third"))
    return both.select("n", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"), F.round(F.when(F.col("var") > 0, F.col("third") / F.pow("var", F.lit(1.5))).otherwise(0.0), 5).alias("skew"), F.round("hmode", 6).alias("hmode"))


def merged_histograms(many: list[DataFrame]) -> DataFrame:
    """Counts of histograms over the same bins, added."""
    out = many[0].select("bin", "cnt")
    for h in many[1:]:
        out = out.unionByName(h.select("bin", "cnt"))
    return out.groupBy("bin").agg(F.sum("cnt").alias("cnt"))


def centred_bins(df: DataFrame, which: str, centres: list[float]) -> DataFrame:
    """Counts by the nearest of some centres (ties: the lower)."""
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(which) - c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres, 1))))
    return df.groupBy(best["i"].alias("bin")).agg(F.count("*").alias("cnt"))


def quantized(df: DataFrame, which: str, levels: int) -> DataFrame:
    """Each value's level (0 .. levels - 1), the nearest of equally spaced ones between least and largest, and each level's mean value."""
    lim = F.broadcast(df.agg(F.min(which).alias("_lo"), F.max(which).alias("_hi")))
    share = F.when(F.col("_hi") > F.col("_lo"), (F.col(which) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return df.join(lim).groupBy(F.round(share * (levels - 1)).cast("int").alias("level")).agg(F.count("*").alias("cnt"), F.round(F.avg(which), 6).alias("mean"))


def smoothed(hist: DataFrame, weight: float) -> DataFrame:
    """Bins smoothed by their neighbours (weight, 1, weight), 0 beyond the ends, scaled to the same total: a window over bins."""
    w = W.Window.orderBy("bin")
    v = (F.col("cnt") + weight * (F.coalesce(F.lag("cnt").over(w), F.lit(0)) + F.coalesce(F.lead("cnt").over(w), F.lit(0)))) / (1 + 2 * weight)
    rows = hist.select("bin", "cnt", v.alias("_v"))
    total = F.broadcast(rows.agg(F.sum("cnt").alias("_n"), F.sum("_v").alias("_s")))
    return rows.join(total).select("bin", F.round(F.col("_v") * F.col("_n") / F.col("_s"), 6).alias("cnt"))


def savitzky_golay(df: DataFrame, which: str, by: str, order: list[str]) -> DataFrame:
    """Quadratic smoothing over five values (-3, 12, 17, 12, -3) / 35 of each series; the two values at either end stay."""
    w = W.Window.partitionBy(by).orderBy(*order)
    at = lambda k: F.lag(which, -k).over(w)
    v = (-3 * at(-2) + 12 * at(-1) + 17 * F.col(which) + 12 * at(1) - 3 * at(2)) / 35
    return df.withColumn("smooth", F.coalesce(v, F.col(which)))


def nearest_of(c: Column, sorted_values: list[float]) -> Column:
    """The 1-based place of the nearest of ascending values (ties: the lower), and of the last that isn't above (0: none)."""
    near = F.array_min(F.array(*(F.struct(F.abs(c - v).alias("d"), F.lit(i).alias("i")) for i, v in enumerate(sorted_values, 1))))["i"]
    below = sum((F.when(c >= v, 1).otherwise(0) for v in sorted_values), F.lit(0))
    return F.struct(near.alias("near"), below.alias("below"))


def mode_of(df: DataFrame, which: str, bins: int) -> DataFrame:
    """The centre of the fullest of equal bins by nearest integer (the first of ties); the top value belongs to the last bin."""
    lim = F.broadcast(df.agg(F.min(which).alias("_lo"), F.max(which).alias("_hi")))
    b = F.least(F.lit(bins - 1), F.round((F.col(which) - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo")))).cast("int")
    h = df.join(lim).groupBy(b.alias("b"), "_lo", "_hi").agg(F.count("*").alias("n"))
    return h.agg(F.round(F.min_by(F.col("_lo") + F.col("b") * (F.col("_hi") - F.col("_lo")) / bins, F.struct(-F.col("n"), F.col("b"))), 6).alias("mode"))
