"""Joins of particles with classes, stacks and micrographs, state propagation, nearest neighbours.

Class and stack tables are joined by key; Spark broadcasts them where their statistics allow and shuffles otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.session import written


def class_state_to_particles(ptcls: DataFrame, cls: DataFrame) -> DataFrame:
    """Particles take their class's state; unclassified ones and those of unknown classes get 0."""
    return ptcls.join(cls.withColumnRenamed("icls", "class"), "class", "left").withColumn("state", F.coalesce("cls_state", F.lit(0))).drop("cls_state")


def class_flag_to_particles(ptcls: DataFrame, cls: DataFrame, flag: str) -> DataFrame:
    """Particles take a column of their class; a class of state 0 switches its particles off."""
    c = cls.select(F.col("icls").alias("class"), "cls_state", F.col(flag).alias("_flag"))
    return ptcls.join(c, "class", "left").withColumn("state", F.when(F.col("cls_state") == 0, 0).otherwise(F.col("state"))).withColumn(flag + "_of_class", F.col("_flag")).drop("cls_state", "_flag")


def particle_state_to_classes(ptcls: DataFrame, cls: DataFrame) -> DataFrame:
    """A class's population less its members whose state isn't 1; empty classes get state 0."""
    p = ptcls.groupBy("class").agg(F.count("*").alias("_all"), F.count_if(F.col("state") != 1).alias("_off"))
    pop = F.coalesce(F.col("_all") - F.col("_off"), F.lit(0))
    return cls.join(p.withColumnRenamed("class", "icls"), "icls", "left").select("icls", pop.alias("pop"), F.when(pop > 0, F.col("cls_state")).otherwise(0).alias("state"))


def stack_positions(ptcls: DataFrame, stk: DataFrame) -> DataFrame:
    """Each particle's place in its stack, by the stack's key; rows outside the stack's range have none."""
    return ptcls.join(stk, "okey").where(F.col("pind").between(F.col("fromp"), F.col("top"))).select("pind", "okey", (F.col("pind") - F.col("fromp") + 1).alias("indstk"))


def by_range(ptcls: DataFrame, stk: DataFrame, width: int = 1024) -> DataFrame:
    """The stack whose range holds the particle, without a common key: ranges are dealt into cells of `width` rows, and particles meet those of their cell."""
    cells = stk.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("fromp") / width), F.floor(F.col("top") / width))))
    return ptcls.withColumn("_cell", F.floor(F.col("pind") / width)).join(cells.withColumnRenamed("okey", "stack"), "_cell").where(F.col("pind").between(F.col("fromp"), F.col("top"))).drop("_cell")


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left_anti")


def vote(edges: DataFrame, item: str, label: str, weight: str) -> DataFrame:
    """The label of the largest weight for each item; ties go to the lower label."""
    s = edges.groupBy(item, label).agg(F.sum(weight).alias("_w"))
    return s.groupBy(item).agg(F.min_by(label, F.struct(-F.col("_w"), F.col(label))).alias(label), F.max("_w").alias("weight"))


def _nearest(batches: Iterator[pa.RecordBatch], ids: np.ndarray, base: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    norm = (base**2).sum(axis=1)
    for b in batches:
        own = b.column(0).to_numpy()
        x = b.column(1).flatten().to_numpy().astype(np.float64).reshape(len(own), -1)
        d = (x**2).sum(axis=1)[:, None] + norm - 2 * x @ base.T
        d[own[:, None] == ids] = np.inf
        last = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        # all that the k-th distance may tie with, by exact distance and id
        q, j = np.nonzero((d <= last[:, None] + 1e-9 * (1 + np.abs(last[:, None]))) & np.isfinite(d))
        exact = ((x[q] - base[j]) ** 2).sum(axis=1)
        order = np.lexsort((ids[j], exact, q))
        q, j, exact = q[order], j[order], exact[order]
        rank = np.arange(1, len(q) + 1) - np.searchsorted(q, q)
        keep = rank <= k
        yield pa.record_batch([pa.array(own[q[keep]]), pa.array(ids[j[keep]]), pa.array(rank[keep]), pa.array(exact[keep])], names=["src", "dst", "rank", "d2"])


def nearest(queries: DataFrame, base: DataFrame, k: int, block: int = 20_000) -> DataFrame:
    """The k nearest base vectors (id, v) of each query, without itself, by squared distance then id: the base is taken in blocks of bounded size, each broadcast in turn, and the blocks' best meet in a partial aggregate."""
    n = base.count()
    parts = max(1, -(-n // block))
    found = None
    for i in range(parts):
        rows = base.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i).orderBy("id").collect()
        ids, vectors = np.array([r.id for r in rows], np.int64), np.array([r.v for r in rows], np.float64)
        if len(ids):
            part = queries.select("id", "v").mapInArrow(partial(_nearest, ids=ids, base=vectors, k=k), "src long, dst long, rank long, d2 double")
            found = part if found is None else found.unionByName(part)
    if found is None:  # no base vectors, no neighbours
        return queries.sparkSession.createDataFrame([], "src long, dst long, rank long, d2 double")
    if parts == 1:
        return found
    best = found.groupBy("src").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "dst"))), 1, k).alias("n"))
    return best.select("src", F.posexplode("n").alias("p", "x")).select("src", F.col("x.dst").alias("dst"), (F.col("p") + 1).cast("long").alias("rank"), F.col("x.d2").alias("d2"))


def connected(edges: DataFrame) -> DataFrame:
    """(id, label) by least labels of neighbours and labels of labels, until nothing changes."""
    both = written(edges.select("src", "dst").unionAll(edges.select("dst", "src")).distinct(), "graph-edges")
    labels = written(both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")), "graph-labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(F.min("label").alias("near"))
        step = written(labels.join(near, labels.id == near.src).select("id", F.col("label").alias("was"), F.least("label", "near").alias("label")), "graph-step")
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("to"))
        new = written(step.join(jump, "label").select("id", "was", F.col("to").alias("label")), "graph-labels")
        labels = new.select("id", "label")
        if not new.where("was <> label").limit(1).count():
            return labels
