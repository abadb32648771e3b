"""Order statistics, thresholds and tests on one column. Values are counted first, so ordered windows see distinct values only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tabulon.sources.adapter import running

UPTO = W.Window.unboundedPreceding, W.Window.currentRow


def _cumulative(df: DataFrame, which: str, weight: Column) -> DataFrame:
    g = df.groupBy(F.col(which).alias("x")).agg(F.sum(weight).alias("w"))
    return running(g, ["x"], ["w"]).withColumnRenamed("cum_w", "cum")


def median_by(df: DataFrame, which: str, by: list[str]) -> DataFrame:
    """(by, med): exact medians of groups of any size, the mean of the two middle values, from counts of values in order; nulls don't count."""
    g = df.where(F.col(which).isNotNull()).groupBy(*by, F.col(which).alias("_x")).agg(F.count("*").alias("_n"))
    c = running(g, [*by, "_x"], ["_n"])
    total = c.groupBy(*by).agg(F.max("cum__n").alias("_end"), F.sum("_n").alias("_all"))
    place = F.col("cum__n") - (F.col("_end") - F.col("_all"))
    inside = (c.join(total, by) if by else c.join(F.broadcast(total))).withColumn("_place", place)
    middle = lambda p: F.min(F.when(F.col("_place") >= p, F.col("_x")))
    return inside.groupBy(*by).agg(((middle(F.floor((F.col("_all") + 1) / 2)) + middle(F.floor((F.col("_all") + 2) / 2))) / 2).alias("med"))


def at_place(df: DataFrame, which: str, place: Column) -> DataFrame:
    """The value at a 1-based place (of the total `n`) of the ascending order."""
    c = _cumulative(df, which, F.lit(1))
    n = F.broadcast(c.agg(F.max("cum").alias("n")))
    return c.join(n).where(F.col("cum") >= place).agg(F.coalesce(F.min("x"), F.lit(0.0)).alias(which))


def percentile_at(df: DataFrame, which: str, q: float) -> DataFrame:
    """The element 1 + floor(q * (n - 1)) of the ascending order."""
    return at_place(df, which, 1 + F.floor(q * (F.col("n") - 1)))


def percentile_weighted(df: DataFrame, which: str, weight: str, q: float) -> DataFrame:
    """The least value whose cumulative positive weight reaches q of all."""
    c = _cumulative(df, which, F.greatest(F.col(weight), F.lit(0.0)))
    return c.join(F.broadcast(c.agg(F.max("cum").alias("_t")))).where(F.col("cum") >= q * F.col("_t") - 1e-12).agg(F.min("x").alias(which))


def mean_of_smallest(df: DataFrame, which: str, fraction: float) -> DataFrame:
    """The mean of the ceil(n * fraction) smallest values."""
    c = _cumulative(df, which, F.lit(1))
    k = F.broadcast(c.agg(F.ceil(F.max("cum") * fraction).alias("_k")))
    take = F.greatest(F.lit(0), F.least(F.col("w"), F.col("_k") - (F.col("cum") - F.col("w"))))
    return c.join(k).agg(F.round(F.sum(F.col("x") * take) / F.max("_k"), 6).alias("avg"))


def two_sample_distance(df: DataFrame, which: str, second: Column) -> DataFrame:
    """The Kolmogorov-Smirnov statistic of the rows of both samples, and its significance by the asymptotic series."""
    g = df.groupBy(which).agg(F.count_if(~second).alias("a"), F.count_if(second).alias("b"))
    c = running(g, [which], ["a", "b"])
    n = F.broadcast(g.agg(F.sum("a").alias("na"), F.sum("b").alias("nb")))
    both = c.join(n).agg(F.max(F.abs(F.col("cum_a") / F.col("na") - F.col("cum_b") / F.col("nb"))).alias("d"), F.max(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))).alias("en"))
    lam = (F.sqrt("en") + 0.12 + 0.11 / F.sqrt("en")) * F.col("d")
    series = sum((2.0 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 101)), F.lit(0.0))
    return both.select(F.round("d", 6).alias("d"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)), 6).alias("prob"))


def otsu(df: DataFrame, which: str) -> DataFrame:
    """The threshold of the least within-class variance: values scaled to 0..255 fall to the nearest of 256 bins (of width 256/256 from the least), the first cut is never taken, and the cut is scaled back; 256 rows are windowed, however many there are."""
    lim = F.broadcast(df.agg(F.min(which).alias("_lo"), F.max(which).alias("_hi")))
    b = F.least(F.lit(255), F.round((F.col(which) - F.col("_lo")) * 255 / (F.col("_hi") - F.col("_lo")))).cast("int")
    h = df.join(lim).groupBy(b.alias("b"), "_lo", "_hi").agg(F.count("*").cast("double").alias("n"))
    every = lim.select(F.explode(F.sequence(F.lit(0), F.lit(255))).alias("b"), "_lo", "_hi").join(h.select("b", "n"), "b", "left").fillna(0.0, ["n"])
    w = W.Window.orderBy("b").rowsBetween(*UPTO)
    whole = W.Window.partitionBy("_lo")
    terms = ("n", "n * b", "n * b * b")
    n1, s1, q1 = (F.sum(F.expr(t)).over(w) for t in terms)
    n, s, q = (F.sum(F.expr(t)).over(whole) for t in terms)
    within = (q1 - s1 * s1 / n1) + F.when(n > n1, (q - q1) - (s - s1) * (s - s1) / (n - n1)).otherwise(0.0)
    cut = every.select("b", "_lo", "_hi", F.round(within, 4).alias("v")).where("b between 1 and 254").agg(F.min_by(F.col("_lo") + F.col("b") * (F.col("_hi") - F.col("_lo")) / 255, F.struct("v", "b")).alias("t"))
    return cut.select(F.round("t", 6).alias("threshold"))


def weighted_moments(df: DataFrame, which: str, weight: str, by: str) -> DataFrame:
    """Weighted mean, and the variance sum(w (x - mean)^2) / sum(w) * n / (n - 1), from sums that merge."""
    x, w = F.col(which), F.col(weight)
    g = df.where(w > 0).groupBy(by).agg(F.count("*").alias("n"), F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * x * x).alias("sxx"))
    mean = F.col("sx") / F.col("sw")
    return g.select(by, F.round(mean, 6).alias("mean"), F.round(F.when(F.col("n") > 1, (F.col("sxx") / F.col("sw") - mean * mean) * F.col("n") / (F.col("n") - 1)).otherwise(0.0), 6).alias("var"))


def nearest_bins(df: DataFrame, which: str, bins: int) -> DataFrame:
    """Counts in bins of width (max + 1 - min) / bins by nearest integer; what lies above goes to the last."""
    lim = F.broadcast(df.agg(F.min(which).alias("_lo"), F.max(which).alias("_hi")))
    b = F.least(F.lit(bins), F.round((F.col(which) - F.col("_lo")) / ((F.col("_hi") + 1 - F.col("_lo")) / bins)) + 1).cast("int")
    return df.join(lim).groupBy(b.alias("bin")).agg(F.count("*").alias("cnt"))


def balanced_ranges(df: DataFrame, parts: int, cells: int = 4096) -> DataFrame:
    """Contiguous ranges of pind with about ceil(n / parts) active rows each: cells are counted first, and the running sum is over the cells."""
    n = df.agg(F.count("*").alias("_n"))
    c = df.join(F.broadcast(n)).groupBy(F.floor((F.col("pind") - 1) * cells / F.col("_n")).alias("cell"), "_n").agg(F.min("pind").alias("lo"), F.max("pind").alias("hi"), F.count_if(F.col("state") > 0).alias("a"))
    before = F.sum("a").over(W.Window.orderBy("cell").rowsBetween(*UPTO)) - F.col("a")
    part = F.least(F.lit(parts), F.floor(before / F.ceil(F.col("_n") / parts)) + 1).cast("int")
    return c.select("lo", "hi", "a", part.alias("part")).groupBy("part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("a").alias("active"))
