"""Samplers, clustering, formats and streams on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import aggregate as A
from tabulon.operators import cluster as K
from tabulon.operators import join as J
from tabulon.operators import rank as R
from tabulon.sources import images, text
from tabulon.sources.adapter import positions
from tabulon.streaming import chunks


def ptcls(spark, rows):
    return spark.createDataFrame(rows, "pind long, class long, state int, corr double, updatecnt int, sampled int")


def test_compress_and_masks(spark):
    df = ptcls(spark, [(i + 1, 1, s, c, 0, s) for i, (s, c) in enumerate(zip([1, 0, 1, 0, 1], [0.1, 0.2, 0.3, 0.4, 0.5], strict=True))])
    kept = df.where("state > 0")
    assert kept.count() == 3 and {r.sampled for r in kept.collect()} == {1}


def test_tiered_sampler(spark):
    df = ptcls(spark, [(i, 1, 1, 0.0, 0 if i <= 3 else 1 if i <= 8 else 2, 0) for i in range(1, 11)])
    got = sorted(r.pind for r in R.sample_lowest(df, 0.5).collect())
    assert len(got) == 5 and got[:3] == [1, 2, 3] and all(4 <= p <= 8 for p in got[3:])


def test_tiered_sampler_large(spark):
    n, frac = 500_001, 0.005
    first = int(n * frac * 0.9)
    df = spark.range(1, n + 1).select(F.col("id").alias("pind"), F.lit(1).alias("state"), F.when(F.col("id") <= first, 0).otherwise(1).alias("updatecnt"))
    got = R.sample_lowest(df, frac)
    assert got.count() == int(frac * n + 0.5) and got.where("updatecnt = 0").count() == first


def test_quotas():
    assert R.quotas([(1, 5), (2, 5)], 4) == {1: 2, 2: 2}
    assert R.quotas([(1, 5), (2, 5)], 5) == {1: 3, 2: 3}  # the last round overshoots
    assert R.quotas([(1, 1), (2, 5)], 100) == {1: 1, 2: 5}


def test_populations_of_nothing(spark):
    df = ptcls(spark, [])
    assert [r.pop for r in A.populations(df, "class", 3).collect()] == [0, 0, 0]
    assert A.largest_label(df, "class").first().n == 1 and A.total(df, "corr").first().avg is None


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = positions(df, ["k"]).orderBy("k").collect()
    assert [r.pind for r in got] == list(range(1, 1001))


@pytest.fixture
def blobs():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (100, 2)) for c in (0, 5, 10)])
    return x, np.sqrt(((x[:, None] - x) ** 2).sum(-1))


def test_hierarchical_and_medoids(blobs):
    x, d = blobs
    for labels in (K.hierarchical(d, 3), K.k_medoids(d, 3)[1], K.threshold_groups(x, 1.5)):
        assert all(len(set(labels[i : i + 100])) == 1 for i in (0, 100, 200)) and len(set(labels)) == 3
    assert K.silhouette(d, K.hierarchical(d, 3)) > 0.8


def test_affinity_propagation():
    offsets = np.linspace(-0.3, 0.3, 12)
    x = np.concatenate([np.pad(np.array(c)[None] + np.stack([offsets, offsets[::-1] ** 2], 1), ((0, 0), (0, 3))) for c in ((0, 0), (7, 0), (0, 7))])
    labels = K.affinity_propagation(-((x[:, None] - x) ** 2).sum(-1))
    assert len(set(labels)) == 3 and all(len(set(labels[i : i + 12])) == 1 for i in (0, 12, 24))


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    d = ((x[:, None] - x) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j), k + 1) for i in range(60) for k, j in enumerate(np.argsort(d[i])[:3])}
    for block in (1000, 17):
        assert {(r.src, r.dst, r.rank) for r in J.nearest(v, v, 3, block).collect()} == want
    edges = J.nearest(v, v, 1)
    labels = {r.id: r.label for r in J.connected(edges).collect()}
    assert all(labels[r.src] == labels[r.dst] for r in edges.collect())


def test_text_lines(spark):
    lines = spark.createDataFrame([("kv=300 cs=2.7  fraca=0.1 dfx=3.0",), ("# note",), ("",), ("kv=x",)], "value string")
    got = text.from_lines(lines, {"kv": "double", "cs": "double", "gone": "int"}).collect()
    assert [tuple(r) for r in got] == [(300.0, 2.7, None), (None, None, None)]


def test_star_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, 1.5 + i / 100, f"{i % 5 + 1}@stack{i % 2}.mrc") for i in range(1, 40)], "pind long, state int, dfx double, image string")
    text.export_star(df, str(tmp_path / "out"), {"rlnImageName": "image", "rlnDefocusU": "dfx"})
    got = text.import_star(spark, str(tmp_path / "out"))
    assert got.count() == df.where("state > 0").count()
    assert sorted((r.indstk, r.stk, round(r.dfx, 4)) for r in got.collect()) == sorted((int(r.image.split("@")[0]), r.image.split("@")[1], round(r.dfx, 4)) for r in df.where("state > 0").collect())
    first = text.stack_map(got.withColumn("pind", F.monotonically_increasing_id())).orderBy("stkind").collect()
    assert [r.stkind for r in first] == [1, 2]


def test_image_stacks(spark, tmp_path):
    x = np.random.default_rng(0).normal(3, 2, (4, 5, 6)).astype(np.float32)
    (tmp_path / "a.mrc").write_bytes(images.encode(x))
    rows = images.read_stacks(spark, str(tmp_path)).orderBy("index").collect()
    assert np.allclose([r.pixels for r in rows], x.reshape(4, -1)) and rows[0].ny == 5
    n = images.normalised(images.read_stacks(spark, str(tmp_path))).collect()
    assert all(abs(np.mean(r.pixels)) < 1e-5 and abs(np.std(r.pixels) - 1) < 1e-4 for r in n)


def test_streamed_chunks_are_the_batch_chunks(spark, tmp_path):
    schema = "source string, record_id long, n int"
    rows = [("a" if i % 3 else "b", i, i % 5 + 1) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = chunks.chunked(stream.select("source", "record_id", "n"), 12).writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.key, r.chunk): r.total for r in spark.table("chunks").collect()}
    want = [r for r in chunks.chunks_of(spark.createDataFrame(rows, schema), 12).collect() if not r.final]
    assert got == {(r.key, r.chunk): r.total for r in want}
    assert all(t > 12 for t in got.values())
