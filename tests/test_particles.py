"""Samplers on small fixtures, rotations, projects, STAR files with several blocks, and odd tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions import angles as G
from tabulon.operators import clusters, robust, sampling, transfer
from tabulon.operators.cluster import threshold_groups
from tabulon.operators.join import nearest
from tabulon.sources import project, text
from tabulon.sources.adapter import particles, running
from tests.conftest import SF

ROWS = "pind long, class long, state int, corr double, updatecnt int, sampled int"


def two_classes(spark, fresh, cohort=()):
    return spark.createDataFrame([(i, 1 + (i > 5), 1, float(6 - ((i - 1) % 5 + 1)), 0 if i in fresh else (1 if cohort else 2), int(i in cohort)) for i in range(1, 11)], ROWS)


def ids(df):
    return sorted(r.pind for r in df.select("pind").collect())


def test_class_sampler_takes_the_least_updated(spark):
    df = two_classes(spark, {4, 5, 9, 10})
    assert ids(sampling.by_class(df, 4, tiers=True)) == [4, 5, 9, 10]


def test_cohort_sampler_is_exact(spark):
    cohort = {1, 4, 5, 6, 9, 10}
    got = ids(sampling.by_class(two_classes(spark, set(range(1, 11)), cohort), 3, cohort=True, tiers=True))
    assert len(got) == 3 and {*got} <= cohort
    with pytest.raises(ValueError):
        sampling.by_class(two_classes(spark, set(), {1}), 4, cohort=True)


def test_tiered_sampler_at_size(spark):
    n, frac = 500_001, 0.005
    few = int(0.9 * frac * n)
    df = spark.range(1, n + 1).select(F.col("id").alias("pind"), F.lit(1).alias("state"), F.when(F.col("id") % (n // few) == 0, 0).otherwise(1).alias("updatecnt"))
    zero = df.where("updatecnt = 0").count()
    got = sampling.fill_in(df, frac)
    assert got.count() == int(frac * n + 0.5) and got.where("updatecnt = 0").count() == min(zero, int(frac * n + 0.5))


def test_samplers_on_odd_tables(spark):
    none = two_classes(spark, set()).where("false")
    off = two_classes(spark, set()).withColumn("state", F.lit(0))
    null = two_classes(spark, set()).withColumn("state", F.lit(None).cast("int"))
    for df in (none, off, null):
        assert ids(sampling.for_reconstruction(df)) == ids(sampling.random_part(df, 0.5)) == ids(sampling.fill_in(df, 0.5)) == ids(sampling.by_class(df, 3)) == []
    one = two_classes(spark, {4})
    after = {r.pind: (r.updatecnt, r.sampled) for r in sampling.marked(one, one.where("pind = 4")).collect()}
    assert after[4] == (1, 1) and after[5] == (2, 0)


def rotation(a, b, c):
    a, b, c = (math.radians(x) for x in (a, b, c))
    z = lambda t: np.array([[math.cos(t), math.sin(t), 0], [-math.sin(t), math.cos(t), 0], [0, 0, 1]])
    y = np.array([[math.cos(b), 0, -math.sin(b)], [0, 1, 0], [math.sin(b), 0, math.cos(b)]])
    return z(c) @ y @ z(a)


def test_rotations(spark):
    rng = np.random.default_rng(1)
    many = [(float(a), float(b), float(c)) for a, b, c in rng.uniform(0, 180, (30, 3)) * [2, 1, 2]] + [(10.0, 0.0, 20.0), (10.0, 180.0, 20.0)]
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(many)], "id int, e1 double, e2 double, e3 double")
    e = tuple(F.col(c) for c in ("e1", "e2", "e3"))
    o = tuple(F.lit(x) for x in (30.0, 40.0, 50.0))
    rows = df.select("id", F.array(*G.matrix(e)).alias("m"), F.array(*G.angles(G.matrix(e))).alias("back"), F.array(*G.composed(e, o)).alias("both"), F.array(*G.mirrored(e)).alias("mirror"), G.rotation_angle(e, o).alias("turn")).orderBy("id").collect()
    for r, x in zip(rows, many, strict=True):
        m = rotation(*x)
        assert np.allclose(np.reshape(r.m, (3, 3)), m, atol=1e-6) and np.allclose(rotation(*r.back), m, atol=1e-4)
        assert np.allclose(rotation(*r.both), rotation(30, 40, 50) @ m, atol=1e-4)
        assert abs(r.turn - math.acos(max(-1, min(1, (np.trace(m @ rotation(30, 40, 50).T) - 1) / 2)))) < 1e-4
    twice = spark.createDataFrame([(r.id, *r.mirror) for r in rows], "id int, e1 double, e2 double, e3 double").select("id", F.array(*G.mirrored(e)).alias("m")).orderBy("id").collect()
    assert all(np.allclose(rotation(*r.m), rotation(*x), atol=1e-3) for r, x in zip(twice, many, strict=True))


def test_threshold_groups_are_not_single_linkage():
    chain = np.array([[0.0], [1.0], [2.0], [3.0], [4.0], [5.0]])
    assert len(set(threshold_groups(chain, 1.2))) == 3


def test_nearest_ties_and_empty_base(spark):
    v = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(40)], "id long, v array<double>")
    q = spark.createDataFrame([(100, [0.0, 0.0])], "id long, v array<double>")
    assert sorted((r["rank"], r.dst) for r in nearest(q, v, 3).collect()) == [(1, 0), (2, 1), (3, 2)]
    assert nearest(q, v.where("false"), 3).count() == 0


def test_medians_and_running_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), float(x)) for k, x in zip(rng.integers(0, 4, 501), rng.integers(0, 60, 501), strict=True)] + [(9, None)]
    df = spark.createDataFrame(rows, "k long, x double")
    got = {r.k: r.med for r in robust.median_by(df, "x", ["k"]).collect()}
    assert got == {k: float(np.median([x for j, x in rows if j == k])) for k in range(4)}
    assert robust.median_by(df, "x", []).first().med == float(np.median([x for _, x in rows if x is not None]))
    g = spark.createDataFrame([(i, float(i % 7)) for i in range(1000)], "i long, w double")
    assert [r.cum_w for r in running(g, ["i"], ["w"]).orderBy("i").collect()] == list(np.cumsum([i % 7 for i in range(1000)]))


def test_pairs(spark):
    for n, parts in ((7, 3), (40, 6)):
        got = sorted(tuple(r) for r in transfer.pair_parts(n, parts, spark).collect())
        assert [g[:2] for g in got] == [(i, j) for i in range(1, n + 1) for j in range(i + 1, n + 1)]
        sizes = [sum(p == k for *_, p in got) for k in range(1, parts + 1)]
        assert max(sizes) - min(sizes) <= 1 and [p for *_, p in got] == sorted(p for *_, p in got)


def test_sorted_means(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 1, 2, 10, 11, 12, 50, 51)], "x double")
    assert [(r.label, round(r.mean, 3), r.cnt) for r in clusters.sorted_means(df, "x", 3).orderBy("label").collect()] == [(1, 1.333, 3), (2, 11.0, 3), (3, 50.5, 2)]
    assert clusters.sorted_means(df.where("false"), "x", 3).count() == 0


def test_star_blocks(spark, tmp_path):
    lines = ["# note", *("filler" for _ in range(3000)), "data_optics", "", "loop_", "_rlnOpticsGroup #1", "_rlnVoltage #2", "1 300", "2 200", "", "data_particles", "loop_", "_rlnImageName #1", "_rlnDefocusU #2", "3@a.mrc 15000", "4@b.mrc 16000", "5@b.mrc 17000"]
    (tmp_path / "x.star").write_text("\n".join(lines))
    names, rows = text.star_loop(spark, str(tmp_path / "x.star"), "particles")
    assert names == ["rlnImageName", "rlnDefocusU"] and rows.count() == 3
    names, rows = text.star_loop(spark, str(tmp_path / "x.star"), "optics")
    assert names == ["rlnOpticsGroup", "rlnVoltage"] and sorted(r.f[1] for r in rows.collect()) == ["200", "300"]
    assert text.star_loop(spark, str(tmp_path / "x.star"), "gone")[1].count() == 0


def test_projects(spark, tmp_path):
    def make(name, n, kv):
        path = f"file://{tmp_path}/{name}"
        p = spark.createDataFrame([(i, 1, 1, 7, 0.5, kv) for i in range(1, n + 1)], "pind long, stkind long, state int, class long, corr double, kv int")
        project.write_segment(p, path, "ptcl2D")
        project.write_segment(spark.createDataFrame([(1, 1, n, n, 1)], "istk long, fromp long, top long, nptcls long, ogid long"), path, "stk", "istk")
        return path

    a, b, out = make("a", 3, 200), make("b", 2, 300), f"file://{tmp_path}/out"
    project.merged(spark, [a, b], out)
    p = project.read_segment(spark, out, "ptcl2D").orderBy("pind").collect()
    assert [(r.pind, r.stkind, r.kv) for r in p] == [(1, 1, 200), (2, 1, 200), (3, 1, 200), (4, 2, 300), (5, 2, 300)] and "class" not in p[0]
    s = project.read_segment(spark, out, "stk").orderBy("istk").collect()
    assert [(r.istk, r.fromp, r.top, r.ogid) for r in s] == [(1, 1, 3, 1), (2, 4, 5, 2)]
    project.replace_rows(project.read_segment(spark, a, "ptcl2D", (2, 2)).withColumn("state", F.lit(0)), a, "ptcl2D")
    assert [r.state for r in project.read_segment(spark, a, "ptcl2D").orderBy("pind").collect()] == [1, 0, 1]
    assert project.read_record(spark, a, "ptcl2D", 3).count() == 1 and not project.has_segment(spark, a, "cls2D")
    with pytest.raises(ValueError):
        project.write_segment(project.read_segment(spark, a, "stk"), a, "other")


def test_filters_reach_the_particle_table(spark):
    p = particles(spark, SF).where("class = 3 and pind <= 200").select("pind", "corr")
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "GreaterThan" in plan or "LessThanOrEqual(pind,200)" in plan
    assert "dfx" not in plan
