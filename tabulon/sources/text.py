"""Text formats: key=value lines, blank-separated number tables, STAR loops."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: External column, internal column, factor from the external to the internal unit.
STAR_COLUMNS = {
    "rlnMicrographName": ("mic", None),
    "rlnImageName": ("image", None),
    "rlnDefocusU": ("dfx", 1e-4),
    "rlnDefocusV": ("dfy", 1e-4),
    "rlnDefocusAngle": ("angast", 1.0),
    "rlnPhaseShift": ("phshift", 0.017453292519943295),
    "rlnVoltage": ("kv", 1.0),
    "rlnSphericalAberration": ("cs", 1.0),
    "rlnAmplitudeContrast": ("fraca", 1.0),
    "rlnCoordinateX": ("xpos", 1.0),
    "rlnCoordinateY": ("ypos", 1.0),
    "rlnOpticsGroup": ("ogid", 1.0),
    "rlnClassNumber": ("class", 1.0),
}


def to_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as text lines k=v k=v; null columns are left out."""
    return df.select(F.concat_ws(" ", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in columns)).alias("value"))


def from_lines(lines: DataFrame, types: dict[str, str]) -> DataFrame:
    """The named keys of k=v lines as typed columns; missing keys are null, values that don't parse too."""
    m = lines.where("trim(value) <> '' AND NOT startswith(trim(value), '#')").select(F.expr("str_to_map(trim(value), '[ \\t]+', '=')").alias("m"))
    return m.select(*(F.expr(f"try_cast(m['{k}'] AS {t})").alias(k) for k, t in types.items()))


def number_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A blank-separated table of numbers; comment and blank lines are skipped."""
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(trim(value), '#')")
    parts = F.split(F.trim("value"), r"\s+")
    return lines.select(*(F.get(parts, F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns)))


def star_loop(spark: SparkSession, path: str, block: str) -> tuple[list[str], DataFrame]:
    """Column names (without the underscore) of a data block's loop, and its rows as arrays of strings.

    Lines carry their file and place; blocks start at `data_` lines, of which a file has few, wherever they stand: those
    lines and the names of columns (`_` lines) are collected, and a row belongs to the block that starts last before it.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("value"))
    heads = lines.where("startswith(value, 'data_') or startswith(value, '_')").orderBy("file", "at").collect()
    names: list[str] = []
    starts, ends = [], []
    inside = None
    for r in heads:
        if r.value.startswith("data_"):
            if inside is not None:
                ends.append(r.at)
            inside = r.at if r.value == f"data_{block}" else None
            if inside is not None:
                starts.append(inside)
        elif inside is not None and len(starts) == 1:
            names.append(re.split(r"\s+", r.value)[0][1:])
    if not starts:
        return [], lines.where("false").select(F.split("value", " ").alias("f"))
    ends += [1 << 62] * (len(starts) - len(ends))
    own = F.lit(False)
    for s, e in zip(starts, ends, strict=True):
        own = own | ((F.col("at") > s) & (F.col("at") < e))
    parts = F.split("value", r"\s+")
    rows = lines.where(own).where("NOT rlike(value, '^(_|#|data_|loop_|$)')").select(parts.alias("f")).where(F.size("f") == len(names))
    return names, rows


def import_star(spark: SparkSession, path: str, block: str = "particles") -> DataFrame:
    """A STAR block with internal names and units; image names `index@stack` become indstk and stk."""
    names, rows = star_loop(spark, path, block)
    out: list[Column] = []
    for i, n in enumerate(names):
        name, factor = STAR_COLUMNS.get(n, (n, None))
        f = F.get("f", F.lit(i))
        if name == "image":
            out += [F.substring_index(f, "@", 1).cast("long").alias("indstk"), F.substring_index(f, "@", -1).alias("stk")]
        else:
            out.append(f.alias(name) if factor is None else (f.cast("double") * factor).alias(name))
    return rows.select(*out)


def export_star(df: DataFrame, path: str, columns: dict[str, str], block: str = "particles", order: str = "pind") -> None:
    """Active rows as one STAR loop, in order: a range-sorted text part for each task, the head before the first. columns: external name to internal column."""
    units = {v[0]: v[1] for v in STAR_COLUMNS.values()}
    cells = [F.format_string("%.6f", F.col(c) / F.lit(units[c])) if units.get(c) and dict(df.dtypes)[c] == "double" else F.col(c).cast("string") for c in columns.values()]
    spark = df.sparkSession
    head = ["", f"data_{block}", "", "loop_", *(f"_{n} #{i}" for i, n in enumerate(columns, 1))]
    lines = spark.createDataFrame([(-1, i, x) for i, x in enumerate(head)], "k long, i int, value string")
    rows = df.where("state > 0").select(F.col(order).cast("long").alias("k"), F.lit(0).alias("i"), F.concat_ws(" ", *cells).alias("value"))
    lines.unionByName(rows).repartitionByRange("k").sortWithinPartitions("k", "i").select("value").write.mode("overwrite").text(path)


def stack_map(df: DataFrame, order: str = "pind") -> DataFrame:
    """Stacks numbered by their first row, with the largest place in each: stk, stkind, most."""
    from tabulon.sources.adapter import positions

    first = df.groupBy("stk").agg(F.min(order).alias("_first"), F.max("indstk").alias("most"))
    return positions(first, ["_first"], "stkind").select("stk", "stkind", "most")
