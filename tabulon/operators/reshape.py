"""Unions with new keys, pruning, replication, repair of stack ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both tables' rows; columns that one lacks are null there."""
    return a.unionByName(b, allowMissingColumns=True)


def merge_projects(projects: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Stacks (istk, fromp, top, ogid) and particles (pind, stkind, ...) of several projects as one: stkind, fromp, top, pind and ogid move by the sizes (and the largest ogid) of the projects before; clustering columns go."""
    stacks, ptcls, rows, groups, parts = [], [], 0, 0, 0
    for stk, ptcl in projects:
        n, most = stk.agg(F.count("*"), F.coalesce(F.max("ogid"), F.lit(0))).first()
        p = ptcl.count()
        stacks.append(stk.withColumns({"istk": F.col("istk") + rows, "fromp": F.col("fromp") + parts, "top": F.col("top") + parts, "ogid": F.col("ogid") + groups}))
        ptcls.append(ptcl.withColumns({"pind": F.col("pind") + parts, "stkind": F.col("stkind") + rows}).drop("class", "corr"))
        rows, groups, parts = rows + n, groups + most, parts + p
    union = lambda x, y: x.unionByName(y, allowMissingColumns=True)
    return reduce(union, stacks), reduce(union, ptcls)


def prune(ptcls: DataFrame) -> DataFrame:
    """Physical deletion of state 0: kept particles with their old stack, their place in it, and the stack's new size. Stacks without particles vanish."""
    w = W.Window.partitionBy("okey")
    return ptcls.where("state > 0").select("okey", F.col("pind").alias("was"), F.row_number().over(w.orderBy("pind")).alias("indstk"), F.count("*").over(w).alias("nptcls"))


def stack_ranges(sizes: DataFrame, order: str, size: str) -> DataFrame:
    """Contiguous ranges (fromp, top) from stack sizes: a running sum over the stacks, a row each."""
    top = F.sum(size).over(W.Window.orderBy(order).rowsBetween(W.Window.unboundedPreceding, 0))
    return sizes.withColumn("top", top).withColumn("fromp", F.col("top") - F.col(size) + 1)


def symmetrize(df: DataFrame, n: int) -> DataFrame:
    """Each row n times: copy 1..n."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))


def overlap(a: DataFrame, b: DataFrame, which: str) -> DataFrame:
    """Common values over the smaller set's size."""
    x, y = a.select(which).distinct(), b.select(which).distinct()
    both = x.withColumn("a", F.lit(1)).join(y.withColumn("b", F.lit(1)), which, "full")
    return both.agg(F.round(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.least(F.count("a"), F.count("b")), 6).alias("overlap"))


def scaled(df: DataFrame, columns: list[str], factor: float) -> DataFrame:
    return df.withColumns({c: F.col(c) * factor for c in columns})
