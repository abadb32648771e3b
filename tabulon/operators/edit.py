"""Column edits of particle tables: each is a projection, and columns that don't change are passed on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def masked(df: DataFrame, mask: DataFrame) -> DataFrame:
    """The rows whose mask (pind, mask) is true."""
    return df.join(mask.where("mask").select("pind"), "pind", "left_semi")


def without_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def set_column(df: DataFrame, which: str, values: DataFrame) -> DataFrame:
    """The column from a table (pind, value); rows without a value keep theirs."""
    new = values.select("pind", F.col("value").alias("_new"))
    return df.join(new, "pind", "left").withColumn(which, F.coalesce("_new", which)).drop("_new")


def set_constant(df: DataFrame, which: str, value) -> DataFrame:
    return df.withColumn(which, F.lit(value))


def scaled_shifts(df: DataFrame, factor: float) -> DataFrame:
    return df.withColumns({"x": F.col("x") * factor, "y": F.col("y") * factor})


def rounded_shifts(df: DataFrame) -> DataFrame:
    return df.withColumns({"x": F.round("x"), "y": F.round("y")})


def turned_inplane(df: DataFrame) -> DataFrame:
    """e3 counted the other way."""
    return df.withColumn("e3", 360 - F.col("e3"))


def swapped_angles(df: DataFrame) -> DataFrame:
    return df.withColumns({"e1": F.col("e3"), "e3": F.col("e1")})


def copied(df: DataFrame, source: str, target: str) -> DataFrame:
    return df.withColumn(target, F.col(source))


def rejected(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the ids (pind) get state 0 and no correlation."""
    bad = ids.select("pind").distinct().withColumn("_bad", F.lit(True))
    return df.join(bad, "pind", "left").withColumns({"state": F.when(F.col("_bad"), 0).otherwise(F.col("state")), "corr": F.when(F.col("_bad"), 0.0).otherwise(F.col("corr"))}).drop("_bad")


def has_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: whether any row has a value other than 0 in the columns (a table without is virgin), whether active rows all have a direction, and which columns are there."""
    any_value = F.coalesce(F.bool_or(F.greatest(*(F.abs(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in columns)) > 0), F.lit(False))
    valid = F.coalesce(F.bool_and(F.when(F.col("state") > 0, F.col("e1").isNotNull() & F.col("e2").isNotNull()).otherwise(True)), F.lit(False))
    return df.agg((~any_value).alias("virgin"), valid.alias("valid"), F.lit(all(c in df.columns for c in columns)).alias("isthere"))
