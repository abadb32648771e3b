"""The particle-project tables over the driver's star schema: particles, micrographs, stacks, classes, optics groups.

A particle's index is its place in a total order. `positions` numbers rows of any size without a single-partition
window: range partitions are sorted and written, their counts (a row for each partition) give the offsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tabulon.session import passing, shuffle_partitions, table, written

PARTICLE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def positions(df: DataFrame, order: list | tuple, name: str = "pind") -> DataFrame:
    """df with its 1-based place in the order (columns that order totally)."""
    spark = df.sparkSession
    low = (1 << 33) - 1
    ranged = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    sorted_ = written(ranged.withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND(F.lit(low))).drop("_id"), "positions")
    base, offsets = 0, []
    for part, n in sorted(tuple(r) for r in sorted_.groupBy("_part").count().collect()):
        offsets.append((part, base))
        base += n
    places = spark.createDataFrame(offsets, "_part long, _base long")
    return sorted_.join(F.broadcast(places), "_part").withColumn(name, F.col("_base") + F.col("_row") + 1).drop("_part", "_row", "_base")


_kept: dict[tuple[str, str, str], DataFrame] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table of a dataset, built once a session and stored with its columns' ranges, so that filters on its numbers and keys reach the scan."""
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _kept:
        with passing(spark) as stay:
            _kept[key] = written(make(), name)
            stay.append(_kept[key])
    return _kept[key]


def running(df: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """df (with columns that order totally) and the running sums cum_<column> in that order: range partitions, their totals (a row for each on the driver), and windows within partitions."""
    spark = df.sparkSession
    ranged = written(df.repartitionByRange(shuffle_partitions(spark), *order).withColumn("_part", F.spark_partition_id()), "running")
    base, offsets = [0] * len(sums), []
    for part, *n in sorted(tuple(r) for r in ranged.groupBy("_part").agg(*(F.sum(c) for c in sums)).collect()):
        offsets.append((part, *map(float, base)))
        base = [b + (x or 0) for b, x in zip(base, n, strict=True)]
    places = spark.createDataFrame(offsets, "_part int" + "".join(f", _base_{c} double" for c in sums))
    w = W.Window.partitionBy("_part").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    return ranged.join(F.broadcast(places), "_part").select(*df.columns, *((F.col(f"_base_{c}") + F.sum(c).over(w)).alias(f"cum_{c}") for c in sums))


def particles(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """pind (if numbered), okey, class, state, corr, eo, updatecnt, sampled, dfx, dfy."""
    if numbered:
        return kept(spark, sf_dir, "particles", lambda: positions(_rows(spark, sf_dir), PARTICLE_ORDER).drop(*PARTICLE_ORDER))
    return _rows(spark, sf_dir).drop(*PARTICLE_ORDER)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        *PARTICLE_ORDER,
        F.col("l_orderkey").alias("okey"),
        (F.col("l_suppkey") + 1).alias("class"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(0).alias("state"),
        F.col("l_discount").alias("corr"),
        (F.col("l_linenumber") % 2).alias("eo"),
        (F.col("l_quantity").cast("int") % 5).alias("updatecnt"),
        F.col("l_linenumber").alias("sampled"),
        F.col("l_extendedprice").alias("dfx"),
        F.col("l_tax").alias("dfy"),
    )


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """icls, cls_state."""
    return table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1).alias("icls"), F.when(F.col("s_acctbal") < 2000, 0).otherwise(1).alias("cls_state"))


def micrographs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """imic, okey, mic_state, ogid, nptcls: an order is a micrograph, its customer's nation the optics group; built once."""

    def make() -> DataFrame:
        n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("okey")).agg(F.count("*").alias("nptcls"))
        c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") + 1).alias("ogid"))
        o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("okey"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("mic_state"))
        rows = o.join(c, "o_custkey").join(n, "okey", "left").select("okey", "mic_state", "ogid", F.coalesce("nptcls", F.lit(0)).alias("nptcls"))
        return positions(rows, ["okey"], "imic")

    return kept(spark, sf_dir, "micrographs", make)


def poses(ptcls: DataFrame) -> DataFrame:
    """Particles with Euler angles e1, e2, e3 in degrees and shifts x, y."""
    return ptcls.withColumns({"e1": F.col("corr") * 3600, "e2": F.col("dfy") * 1000, "e3": F.col("dfx") % 360, "x": F.col("dfy") * 50, "y": F.col("corr") * 30 - 1})


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """iproj, e1, e2, e3: a reference direction for each nation."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select((k + 1).alias("iproj"), (k * 14.4).cast("double").alias("e1"), (k * 37 % 80).cast("double").alias("e2"), F.lit(0.0).alias("e3"))


def stacks(ptcls: DataFrame) -> DataFrame:
    """okey, fromp, top, nptcls of numbered particles: a stack is an order with particles."""
    return ptcls.groupBy("okey").agg(F.min("pind").alias("fromp"), F.max("pind").alias("top"), F.count("*").alias("nptcls"))


#: The same tables in SQL, for oracles.
SQL = """ptcl AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pind, l_orderkey AS okey,
    l_suppkey + 1 AS class, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 0 END AS state, l_discount AS corr, l_linenumber % 2 AS eo,
    CAST(l_quantity AS INT) % 5 AS updatecnt, l_linenumber AS sampled, l_extendedprice AS dfx, l_tax AS dfy FROM lineitem),
cls AS (SELECT s_suppkey + 1 AS icls, CASE WHEN s_acctbal < 2000 THEN 0 ELSE 1 END AS cls_state FROM supplier),
stk AS (SELECT okey, min(pind) AS fromp, max(pind) AS top, count(*) AS nptcls FROM ptcl GROUP BY okey),
mic AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS imic, o_orderkey AS okey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS mic_state, c_nationkey + 1 AS ogid, coalesce(n, 0) AS nptcls
    FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) q ON q.l_orderkey = o_orderkey),
pose AS (SELECT *, corr * 3600 AS e1, dfy * 1000 AS e2, dfx % 360 AS e3, dfy * 50 AS x, corr * 30 - 1 AS y FROM ptcl),
dir AS (SELECT n_nationkey + 1 AS iproj, n_nationkey * 14.4::DOUBLE AS e1, (n_nationkey * 37 % 80)::DOUBLE AS e2 FROM nation)"""
