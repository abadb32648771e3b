"""Clusterings of vectors as DataFrames: quality indices from centroids, first-neighbour links, one-dimensional means.

Centroids are aggregates (a row for each cluster); distances to them are built-in array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators.join import connected


def square_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def centroids(rows: DataFrame, label: str) -> DataFrame:
    """label, n and the mean vector v of each cluster of rows (label, v): means by place, put together again."""
    each = rows.select(label, F.posexplode("v").alias("p", "x"))
    means = each.groupBy(label, "p").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return means.groupBy(label).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("c"))


def davies_bouldin(rows: DataFrame, label: str) -> DataFrame:
    """The mean over clusters of the largest (s_i + s_k) / distance of centroids, s: the root mean square distance to the centroid."""
    c = centroids(rows, label)
    s = rows.join(c, label).groupBy(label).agg(F.sqrt(F.avg(square_distance(F.col("v").cast("array<double>"), F.col("c")))).alias("s"))
    k = c.join(s, label).select(F.col(label).alias("k"), "c", "s")
    if k.count() > 2000:
        raise ValueError("more than 2000 clusters")
    other = k.select(F.col("k").alias("k2"), F.col("c").alias("c2"), F.col("s").alias("s2"))
    worst = k.join(F.broadcast(other), F.col("k") != F.col("k2")).groupBy("k").agg(F.max((F.col("s") + F.col("s2")) / F.sqrt(square_distance(F.col("c"), F.col("c2")))).alias("r"))
    return worst.agg(F.round(F.avg("r"), 6).alias("dbindex"))


def first_neighbour_partition(neighbours: DataFrame, vectors: DataFrame) -> DataFrame:
    """id, label of one level of first-neighbour clustering: every vector is linked to its nearest one (src, dst), and components (named by their least id) are the clusters."""
    return connected(neighbours.select("src", "dst"))


def sorted_means(df: DataFrame, which: str, k: int, rounds: int = 50) -> DataFrame:
    """(label, mean, cnt) of one-dimensional k-means that starts at every (n / k)-th sorted value: values are counted first, and a round is an aggregate over distinct values; k means travel."""
    from tabulon.sources.adapter import running
    from tabulon.session import written

    g = written(running(df.groupBy(F.col(which).cast("double").alias("x")).agg(F.count("*").alias("n")), ["x"], ["n"]), "means")
    total = int(g.agg(F.sum("n")).first()[0] or 0)
    places = [max(1, (2 * i + 1) * total // (2 * k)) for i in range(k)]
    means = list(g.agg(*(F.min(F.when(F.col("cum_n") >= p, F.col("x"))).alias(f"m{i}") for i, p in enumerate(places))).first()) if total else []
    found = None
    for _ in range(rounds if total else 0):
        best = F.array_min(F.array(*(F.struct(F.abs(F.col("x") - m).alias("d"), F.lit(i).alias("i")) for i, m in enumerate(means))))["i"]
        found = sorted(tuple(r) for r in g.groupBy(best.alias("label")).agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("m"), F.sum("n")).collect())
        new = list(means)
        for i, m, _n in found:
            new[i] = m
        if new == means:
            break
        means = new
    return df.sparkSession.createDataFrame([(i + 1, m, n) for i, m, n in found or []], "label int, mean double, cnt long")
