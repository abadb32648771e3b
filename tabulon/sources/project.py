"""A project: a folder of segments (mic, stk, ptcl2D, ptcl3D, cls2D, cls3D, optics, out, ...), each a Parquet table with its row number.

Segments keep their rows in order with ranges of the number in every row group, so a range of rows reads a part of the
files. A segment is written under a new name and then put in the place of the old one; a failed write leaves the old one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The segments of a project, in order.
SEGMENTS = ("mic", "stk", "ptcl2D", "cls2D", "cls3D", "ptcl3D", "out", "optics")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_segment(df: DataFrame, project: str, segment: str, number: str = "pind") -> None:
    """The segment anew, range-sorted by its number."""
    if segment not in SEGMENTS:
        raise ValueError(f"no segment {segment}")
    spark = df.sparkSession
    new, old = f"{project}/_new-{segment}-{uuid.uuid4().hex}", f"{project}/{segment}"
    df.repartitionByRange(F.col(number)).sortWithinPartitions(number).write.parquet(new)
    fs, p = _fs(spark, old)
    fs.delete(p, True)
    fs.rename(_fs(spark, new)[1], p)


def has_segment(spark: SparkSession, project: str, segment: str) -> bool:
    fs, p = _fs(spark, f"{project}/{segment}")
    return fs.exists(p)


def read_segment(spark: SparkSession, project: str, segment: str, fromto: tuple[int, int] | None = None, columns: list[str] | None = None, number: str = "pind") -> DataFrame:
    """A segment's rows, all or a range of numbers; the range and the columns reach the scan."""
    df = spark.read.parquet(f"{project}/{segment}")
    df = df if fromto is None else df.where(F.col(number).between(*fromto))
    return df if columns is None else df.select(*columns)


def read_record(spark: SparkSession, project: str, segment: str, place: int, number: str = "pind") -> DataFrame:
    return read_segment(spark, project, segment, (place, place), number=number)


def replace_rows(df: DataFrame, project: str, segment: str, number: str = "pind") -> None:
    """Rows of the segment that df has anew; the others stay."""
    old = read_segment(df.sparkSession, project, segment)
    write_segment(old.join(df.select(number), number, "left_anti").unionByName(df), project, segment, number)


def segments_info(spark: SparkSession, project: str, numbers: dict[str, str] | None = None) -> DataFrame:
    """segment, n, first, last and fields of the segments that are there; numbers: the number's column where it isn't pind."""
    out = None
    for s in SEGMENTS:
        if has_segment(spark, project, s):
            df, number = spark.read.parquet(f"{project}/{s}"), (numbers or {}).get(s, "pind")
            row = df.agg(F.lit(s).alias("segment"), F.count("*").alias("n"), F.min(number).alias("first"), F.max(number).alias("last"), F.lit(len(df.columns)).alias("fields"))
            out = row if out is None else out.unionByName(row)
    return spark.createDataFrame([], "segment string, n long, first long, last long, fields int") if out is None else out


def problems(spark: SparkSession, project: str) -> DataFrame:
    """(segment, problem, n): stacks whose range and size disagree, particles outside their stack's range, states that ptcl2D and ptcl3D don't share."""
    stk, p2 = (read_segment(spark, project, s) for s in ("stk", "ptcl2D"))
    bad = stk.where("top - fromp + 1 <> nptcls").agg(F.lit("stk").alias("segment"), F.lit("range").alias("problem"), F.count("*").alias("n"))
    out = p2.join(stk.select("okey", "fromp", "top"), "okey", "left").where("fromp is null or pind < fromp or pind > top")
    rows = bad.unionByName(out.agg(F.lit("ptcl2D").alias("segment"), F.lit("stack").alias("problem"), F.count("*").alias("n")))
    if has_segment(spark, project, "ptcl3D"):
        p3 = read_segment(spark, project, "ptcl3D").select("pind", F.col("state").alias("s3"))
        both = p2.select("pind", "state").join(p3, "pind", "full").where("not (state <=> s3)")
        rows = rows.unionByName(both.agg(F.lit("ptcl3D").alias("segment"), F.lit("state").alias("problem"), F.count("*").alias("n")))
    return rows.where("n > 0")


def repaired(ptcls: DataFrame, stacks: DataFrame) -> DataFrame:
    """Stacks with the ranges and sizes that their particles have."""
    own = ptcls.groupBy("okey").agg(F.min("pind").alias("fromp"), F.max("pind").alias("top"), F.count("*").alias("nptcls"))
    return stacks.drop("fromp", "top", "nptcls").join(own, "okey")


def remapped(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Paths under one folder moved to another."""
    c = F.col(column)
    return df.withColumn(column, F.when(c.startswith(old.rstrip("/") + "/"), F.concat(F.lit(new.rstrip("/")), F.substring(c, len(old.rstrip("/")) + 1, 1 << 20))).otherwise(c))


def subproject(spark: SparkSession, project: str, out: str, chosen: DataFrame) -> None:
    """A project of the chosen particles (pind) alone: particles keep their order and get new numbers, stacks the new ranges."""
    from tabulon.sources.adapter import positions

    p = read_segment(spark, project, "ptcl2D").join(chosen.select("pind").distinct(), "pind", "left_semi")
    p = positions(p.withColumnRenamed("pind", "was"), ["was"]).drop("was")
    write_segment(p, out, "ptcl2D")
    write_segment(repaired(p, read_segment(spark, project, "stk")), out, "stk", "okey")


def merged(spark: SparkSession, projects: list[str], out: str) -> None:
    """Several projects as one: numbers of particles and stacks move by the sizes of the projects before; clustering goes."""
    from tabulon.operators.reshape import merge_projects

    many = []
    for p in projects:
        stk, ptcl = read_segment(spark, p, "stk"), read_segment(spark, p, "ptcl2D")
        many.append((stk, ptcl))
    stk, ptcl = merge_projects(many)
    write_segment(stk, out, "stk", "istk")
    write_segment(ptcl, out, "ptcl2D")
