"""Projections, filters and column updates on particle tables. Row ids are the column pind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def between(df: DataFrame, fromto: tuple[int, int] | None) -> DataFrame:
    return df if fromto is None else df.where(F.col("pind").between(*fromto))


def get_all(df: DataFrame, key: str, fromto: tuple[int, int] | None = None, nonzero: bool = False) -> DataFrame:
    rows = between(df, fromto)
    return (rows.where("state > 0") if nonzero else rows).select("pind", key)


def get_all_asint(df: DataFrame, key: str, fromto: tuple[int, int] | None = None) -> DataFrame:
    return between(df, fromto).select("pind", F.round(key).cast("long").alias(key))


def get_arr(df: DataFrame, which: str, cls: int | None = None, state: int | None = None) -> DataFrame:
    """A class's active rows, or a state's rows, or all."""
    rows = df.where((F.col("class") == cls) & (F.col("state") > 0)) if cls is not None else df.where(F.col("state") == state) if state is not None else df
    return rows.select("pind", which)


def latest_sampled(df: DataFrame, state: int | None = None) -> DataFrame:
    """Rows of the latest sample generation: a scalar maximum joins as one row."""
    rows = df if state is None else df.where(F.col("state") == state)
    return rows.join(F.broadcast(rows.agg(F.max("sampled").alias("_latest"))), F.col("sampled") > F.col("_latest") - 0.5).drop("_latest")


def label_rows(df: DataFrame, label: str, value: int, updated: bool = False) -> DataFrame:
    rows = df.where((F.col(label) == value) & (F.col("state") != 0))
    return (rows.where("updatecnt <> 0") if updated else rows).select("pind")


def label_values(df: DataFrame, label: str) -> DataFrame:
    return df.where((F.col("state") != 0) & (F.col(label) >= 1)).select(label).distinct()


def best_fraction(df: DataFrame, label: str, value: int, fraction: float) -> DataFrame:
    """pind and mask: rows of the label in the top fraction by corr."""
    n = F.broadcast(df.where(F.col(label) == value).agg(F.percentile("corr", F.lit(1 - fraction)).alias("_cut")))
    return df.join(n).select("pind", ((F.col(label) == value) & (F.col("corr") >= F.col("_cut"))).alias("mask"))


def gather(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the ids (place, pind), with their place."""
    return df.join(ids, "pind")


def drop_row(df: DataFrame, pind: int) -> DataFrame:
    """Without one row; later rows move up."""
    return df.where(F.col("pind") != pind).withColumn("pind", F.when(F.col("pind") > pind, F.col("pind") - 1).otherwise(F.col("pind")))


def reset(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.lit(0.0) for c in columns})


def set_where(df: DataFrame, field: str, value: int, which: str, to) -> DataFrame:
    return df.withColumn(which, F.when(F.col(field) == value, to).otherwise(F.col(which)))


def selection(df: DataFrame, least_corr: float | None = None, most_df: float | None = None, states: list[int] | None = None) -> DataFrame:
    """The selection verb: state 0 for rows beyond a threshold or outside the states, else 1."""
    bad = F.lit(False)
    if least_corr is not None:
        bad = bad | (F.col("corr") < least_corr)
    if most_df is not None:
        bad = bad | (F.col("dfx") > most_df)
    if states is not None:
        bad = bad | ~F.col("state").isin(states)
    return df.withColumn("state", F.when(bad | (F.col("state") == 0), 0).otherwise(1))
