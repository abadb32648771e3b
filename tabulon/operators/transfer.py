"""Transfers between the tables of a project: states, poses and labels by class, stack and micrograph, and nearest directions.

Class, stack and micrograph tables meet particles by key. Tables of reference directions are bounded by their angular
step; they are counted, and refused above MOST_DIRECTIONS, before they travel as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions import angles as A

MOST_DIRECTIONS = 20_000
EULER = ("e1", "e2", "e3")


def class_poses(ptcls: DataFrame, cls: DataFrame) -> DataFrame:
    """Particles with the pose of their class (icls, e1, e2, e3, corr, state) composed with their own in-plane angle; those of unknown classes get state 0 and keep their pose."""
    c = cls.select(F.col("icls").alias("class"), *(F.col(x).alias(f"_{x}") for x in (*EULER, "corr", "state")))
    rows = ptcls.join(c, "class", "left")
    zero = F.lit(0.0)
    new = A.composed((F.col("_e1"), F.col("_e2"), F.col("_e3")), (zero, zero, F.col("e3")))
    there = F.col("_state").isNotNull()
    return rows.withColumns({**{e: F.when(there, v).otherwise(F.col(e)) for e, v in zip(EULER, new, strict=True)}, "corr": F.coalesce("_corr", "corr"), "state": F.coalesce("_state", F.lit(0))}).drop(*(f"_{x}" for x in (*EULER, "corr", "state")))


def class_selection(tables: list[DataFrame], cls: DataFrame, key: str = "class") -> list[DataFrame]:
    """Every table with the state of its class (icls, cls_state); other classes are off."""
    c = cls.select(F.col("icls").alias(key), F.col("cls_state").alias("_s"))
    return [t.join(c, key, "left").withColumn("state", F.coalesce("_s", F.lit(0))).drop("_s") for t in tables]


def copied_by_row(target: DataFrame, source: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of the row with the same pind; rows without one keep theirs."""
    s = source.select("pind", F.lit(True).alias("_there"), *(F.col(c).alias(f"_{c}") for c in columns))
    rows = target.join(s, "pind", "left")
    return rows.withColumns({c: F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop("_there", *(f"_{c}" for c in columns))


def micrograph_stacks(mics: DataFrame, stacks: DataFrame) -> DataFrame:
    """imic, istk: the k-th micrograph with particles belongs to the k-th stack (both have the order's key)."""
    return mics.where("nptcls > 0").select("imic", "okey").join(stacks.select("istk", "okey"), "okey").select("imic", "istk")


def micrograph_of(ptcls: DataFrame, stacks: DataFrame, mics: DataFrame, name: Column) -> DataFrame:
    """pind, stack, place in it and the micrograph's name: particle to stack to micrograph."""
    s = stacks.select("okey", "istk", "fromp")
    return ptcls.select("pind", "okey").join(s, "okey").join(mics.select("okey", name.alias("micname")), "okey").select("pind", "istk", (F.col("pind") - F.col("fromp") + 1).alias("indstk"), "micname")


def state_down(ptcls: DataFrame, parents: DataFrame, state: str) -> DataFrame:
    """Particles take their parent's state (okey, state) where it is 0; others keep theirs."""
    p = parents.select("okey", F.col(state).alias("_s"))
    return ptcls.join(p, "okey", "left").withColumn("state", F.when(F.coalesce("_s", F.lit(0)) == 0, 0).otherwise(F.col("state"))).drop("_s")


def optics_parameters(ptcls: DataFrame, mics: DataFrame, columns: list[str]) -> DataFrame:
    """The particle's own value of each column where it has one, else its micrograph's."""
    m = mics.select("okey", *(F.col(c).alias(f"_{c}") for c in columns))
    return ptcls.join(m, "okey", "left").select("pind", *(F.coalesce(c, f"_{c}").alias(c) for c in columns))


def _packed(refs: DataFrame) -> DataFrame:
    if refs.count() > MOST_DIRECTIONS:
        raise ValueError(f"more than {MOST_DIRECTIONS} reference directions")
    x, y, z = A.normal(tuple(F.col(e) for e in EULER))
    return F.broadcast(refs.agg(F.array_sort(F.collect_list(F.struct("iproj", x.alias("x"), y.alias("y"), z.alias("z")))).alias("_refs")))


def _ranked() -> Column:
    """The references as (closeness, -iproj), the closest last."""
    x, y, z = A.normal(tuple(F.col(e) for e in EULER))
    return F.transform("_refs", lambda r: F.struct(F.round(r["x"] * x + r["y"] * y + r["z"] * z, 9).alias("d"), (-r["iproj"]).alias("i")))


def closest_direction(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """rows with proj, the reference (iproj, e1, e2, e3) of the least angle (ties: the lower), and that angle in radians."""
    best = F.array_max(_ranked())
    return rows.join(_packed(refs)).withColumn("_b", best).drop("_refs").withColumns({"proj": -F.col("_b.i"), "angle": A.clamped_acos(F.col("_b.d"))}).drop("_b")


def near_directions(rows: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """rows with near, the k closest references in order (a reference that is the row itself is one of them)."""
    by = F.transform(F.slice(F.reverse(F.array_sort(_ranked())), 1, k), lambda r: -r["i"])
    return rows.join(_packed(refs)).withColumn("near", by).drop("_refs")


def directions_within(rows: DataFrame, refs: DataFrame, degrees: float) -> DataFrame:
    """rows with near, the references at most so many degrees away, by number."""
    by = F.filter(_ranked(), lambda r: F.degrees(A.clamped_acos(r["d"])) <= degrees)
    return rows.join(_packed(refs)).withColumn("near", F.array_sort(F.transform(by, lambda r: -r["i"]))).drop("_refs")


def replaced_by_closest(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """rows with the angles of their closest reference."""
    r = refs.select(F.col("iproj").alias("proj"), *(F.col(e).alias(f"_{e}") for e in EULER))
    return closest_direction(rows, refs).join(r, "proj").withColumns({e: F.col(f"_{e}") for e in EULER}).drop(*(f"_{e}" for e in EULER), "angle")


def new_files(found: DataFrame, history: DataFrame, path: str = "path") -> DataFrame:
    """Files whose base name isn't in the history."""
    base = F.substring_index(path, "/", -1)
    return found.withColumn("_base", base).join(history.select(base.alias("_base")).distinct(), "_base", "left_anti").drop("_base")


def pair_parts(n: int, parts: int, spark) -> DataFrame:
    """(i, j, part) of all pairs i < j of 1..n in contiguous parts of even sizes, by arithmetic on the pair's number."""
    total = n * (n - 1) // 2
    size, rest = divmod(total, parts)
    k = F.col("id")
    # of pairs in rows i = 1.., the row of pair k
    i = n - F.floor((F.sqrt(8.0 * (total - 1 - k) + 1) + 1) / 2)
    cut = rest * (size + 1)
    part = F.when(k < cut, F.floor(k / (size + 1))).otherwise(rest + F.floor((k - cut) / max(1, size))) + 1
    rows = spark.range(total).withColumn("i", i.cast("long"))
    first = (F.col("i") - 1) * n - F.col("i") * (F.col("i") - 1) / 2
    return rows.select("i", (F.col("i") + 1 + k - first).cast("long").alias("j"), part.cast("int").alias("part"))


def state_votes(runs: list[DataFrame], states: int) -> DataFrame:
    """pind, state, agreement: several labellings (pind, state) of the same rows. Each run's labels are matched to the first run's by the permutation with the largest agreement (a states x states table on the driver); the majority wins, ties go to the lower state."""
    from itertools import permutations

    aligned = [runs[0].select("pind", "state")]
    for r in runs[1:]:
        table = {(a, b): n for a, b, n in runs[0].join(r.select("pind", F.col("state").alias("other")), "pind").groupBy("state", "other").count().collect()}
        best = max(permutations(range(1, states + 1)), key=lambda p: (sum(table.get((p[b - 1], b), 0) for b in range(1, states + 1)), [-x for x in p]))
        to = F.create_map(*(F.lit(x) for b in range(1, states + 1) for x in (b, best[b - 1])))
        aligned.append(r.select("pind", F.coalesce(F.try_element_at(to, F.col("state")), F.col("state")).alias("state")))
    votes = aligned[0]
    for a in aligned[1:]:
        votes = votes.unionByName(a)
    n = votes.groupBy("pind", "state").agg(F.count("*").alias("n"))
    return n.groupBy("pind").agg(F.min_by("state", F.struct(-F.col("n"), F.col("state"))).alias("state"), (F.max("n") / len(runs)).alias("agreement"))
