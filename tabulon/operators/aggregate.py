"""Counts, sums, robust statistics, histograms, agreement measures. All are partial aggregates of Spark; medians are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import NAN_AS_ZERO
from tabulon.operators.robust import median_by
from tabulon.sources.adapter import running

ACTIVE = "state <> 0"


def largest_label(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.greatest(F.lit(1), F.coalesce(F.max(label), F.lit(1))).cast("long").alias("n"))


def populations(df: DataFrame, label: str, most: int) -> DataFrame:
    """Active rows of each label 1..most, with 0 for empty ones."""
    every = df.sparkSession.range(1, most + 1).select(F.col("id").alias(label))
    return every.join(df.where(ACTIVE).groupBy(label).agg(F.count("*").alias("pop")), label, "left").select(label, F.coalesce("pop", F.lit(0)).alias("pop"))


def total(df: DataFrame, which: str, where: Column | None = None) -> DataFrame:
    """Sum, count and average of active rows; NaN counts as 0; the average of nothing is null."""
    rows = df.where(ACTIVE) if where is None else df.where(ACTIVE).where(where)
    s = F.coalesce(F.sum(NAN_AS_ZERO(F.col(which))), F.lit(0.0))
    return rows.agg(F.round(s, 6).alias("total"), F.count("*").alias("cnt"), F.round(F.when(F.count("*") > 0, s / F.count("*")), 6).alias("avg"))


def moments(c: str) -> list[Column]:
    """n, mean, sample deviation and variance, bias-corrected skewness, and the kurtosis with G2 coefficients over the population's second moment."""
    n, mean = F.count(c), F.avg(c)
    g1, k = F.skewness(c), F.kurtosis(c) + 3
    skew = F.when(n < 3, 0.0).otherwise(g1 * F.sqrt(n * (n - 1.0)) / (n - 2.0))
    kurt = F.when(n < 4, 0.0).otherwise((n + 1.0) * n / ((n - 1.0) * (n - 2.0) * (n - 3.0)) * n * k - 3.0 * (n - 1.0) * (n - 1.0) / ((n - 2.0) * (n - 3.0)))
    return [n.alias("n"), F.round(mean, 6).alias("ave"), F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 6).alias("sdev"), F.round(F.coalesce(F.var_samp(c), F.lit(0.0)), 6).alias("var"), F.round(skew, 5).alias("skew"), F.round(kurt, 4).alias("kurt")]


def robust(df: DataFrame, which: str, nsig: float, by: list[str] | None = None) -> DataFrame:
    """Median, median absolute deviation, its Gaussian scale, and the threshold median + nsig * deviation, of groups (or of all)."""
    by = by or []
    med = median_by(df, which, by)
    dev = df.join(F.broadcast(med) if not by else med, by or None).withColumn("_d", F.abs(F.col(which) - F.col("med"))).withColumnRenamed("med", "_med")
    out = median_by(dev, "_d", [*by, "_med"]).withColumnRenamed("med", "mad").withColumnRenamed("_med", "med")
    return out.select(*by, F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"), F.round(F.col("mad") * 1.4826, 6).alias("mad_gau"), F.round(F.col("med") + nsig * F.col("mad"), 6).alias("thres"))


def histogram(df: DataFrame, which: str, bins: int) -> DataFrame:
    """Equal-width, right-closed bins from least to largest (10 % wider if flat): bin, lower edge, count; empty bins have no row."""
    lim = df.agg(F.min(which).alias("_lo"), F.max(which).alias("_hi"))
    lim = lim.select(F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") * 0.9).otherwise(F.col("_lo")).alias("_lo"), F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") * 1.1).otherwise(F.col("_hi")).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((F.col(which) - F.col("_lo")) / width))).cast("int")
    return df.join(F.broadcast(lim)).select(b.alias("bin"), "_lo", width.alias("_w")).groupBy("bin", "_lo", "_w").agg(F.count("*").alias("cnt")).select("bin", F.round(F.col("_lo") + (F.col("bin") - 1) * F.col("_w"), 6).alias("edge"), "cnt")


def entropy(hist: DataFrame, bins: int) -> DataFrame:
    """-sum p ln p of a histogram, and its share of ln(bins)."""
    p = F.col("cnt") / F.col("_n")
    return hist.join(F.broadcast(hist.agg(F.sum("cnt").alias("_n")))).agg(F.round(-F.sum(p * F.ln(p)), 6).alias("entropy"), F.round(-F.sum(p * F.ln(p)) / F.ln(F.lit(float(bins))), 6).alias("bounded"))


def divergences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Total variation, Kullback-Leibler (bins with a zero skipped), Jensen-Shannon and Hellinger distance of two histograms over the same bins."""
    x, y = (h.join(F.broadcast(h.agg(F.sum("cnt").alias("_n")))).select("bin", (F.col("cnt") / F.col("_n")).alias(n)) for h, n in ((a, "p"), (b, "q")))
    both = x.join(y, "bin", "full").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    kl = lambda s, t: F.sum(F.when((s > 0) & (t > 0), s * F.ln(s / t)).otherwise(0.0))
    p, q = F.col("p"), F.col("q")
    return both.agg(F.round(F.sum(F.abs(p - q)) / 2, 6).alias("tvd"), F.round(kl(p, q), 6).alias("kld"), F.round(F.greatest(F.lit(0.0), (kl(p, m) + kl(q, m)) / 2), 6).alias("jsd"), F.round(F.sqrt(F.sum((F.sqrt(p) - F.sqrt(q)) ** 2) / 2), 6).alias("hd"))


def confusion(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, tn, fn and the measures drawn from them, 0 where undefined."""
    n = lambda c: F.count_if(c)
    c = df.agg(n(predicted & actual).alias("tp"), n(predicted & ~actual).alias("fp"), n(~predicted & ~actual).alias("tn"), n(~predicted & actual).alias("fn"))
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    pr, re, sp = safe(tp, tp + fp), safe(tp, tp + fn), safe(tn, tn + fp)
    return c.select("tp", "fp", "tn", "fn", F.round(pr, 6).alias("precision"), F.round(re, 6).alias("recall"), F.round(sp, 6).alias("specificity"), F.round(safe(2 * pr * re, pr + re), 6).alias("f1"), F.round((re + sp) / 2, 6).alias("balacc"), F.round(safe(tp + tn, tp + fp + tn + fn), 6).alias("accuracy"))


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """ROC area by wins of pairs, ties a half; counts of equal scores first, so the ordered window sees distinct scores only."""
    g = df.groupBy(score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    wins = running(g, [score], ["n"]).select("p", "n", (F.col("cum_n") - F.col("n")).alias("b")).agg(F.sum(F.col("p") * (F.col("b") + F.col("n") / 2)).alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return wins.select(F.round(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n"))).otherwise(0.5), 6).alias("auc"))


def update_fractions(df: DataFrame, by: list[str]) -> DataFrame:
    """Of active rows ever updated, the share in the latest sample generation."""
    latest = F.broadcast(df.agg(F.max("sampled").alias("_latest")))
    rows = df.where("state > 0 and updatecnt > 0").join(latest)
    return rows.groupBy(*by).agg(F.round(F.count_if(F.col("sampled") == F.col("_latest")) / F.count("*"), 6).alias("frac"))


def group_order(df: DataFrame, by: str) -> DataFrame:
    """For each group its members by corr, best first, ties by pind."""
    return df.where(ACTIVE).groupBy(by).agg(F.count("*").alias("pop"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("corr")).alias("c"), F.col("pind").alias("pind")))), lambda x: x["pind"]).alias("pinds"))
