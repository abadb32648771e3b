"""The classifier: held-out accuracy, independence of the score from labels of the row, odd inputs."""

import re
import zlib

import numpy as np
import pyarrow as pa

from tabulon.llm import toxicity
from tabulon.session import table
from tests.conftest import SF_MID


def auc(score, y):
    r = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF_MID, "documents"), table(spark, SF_MID, "labels")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").withColumn("held", toxicity.held_out(labels["doc_id"])).toPandas()
    assert (rows.held == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    held = rows[rows.held]
    assert auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.85
    assert ((held.score >= 0.5) == (held.toxic == 1)).mean() > 0.88
    kept = toxicity.keep_clean(docs.withColumn("score", docs.doc_id), model)
    assert kept.columns == [*docs.columns, "score"] and 0.7 * docs.count() < kept.count() < docs.count()


def test_scores_of_whole_texts():
    rng = np.random.default_rng(0)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    clean = [" ".join(rng.choice(words, 12)) for _ in range(200)]
    bad = [t + " " + rng.choice(["vilestra", "vilean", "vileor"]) for t in clean[:60]]
    model = toxicity.train(clean + bad, [0] * 200 + [1] * 60, ["en"] * 260, buckets=1 << 12)
    long = " ".join(rng.choice(words, 200_000))
    s = model.scores(pa.array(["", long, long + " vilequa", "Vilestra!", *clean[:3], *bad[:3]], pa.large_string()))
    assert s[0] < 0.5 and s[1] < 0.5 and s[2] > 0.5 and s[3] > 0.5 and (s[4:7] < 0.5).all() and (s[7:] > 0.5).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, "x"), (None, "a b", "en", "x"), (2, "", "de", "x"), (2, "", "de", "x")], "doc_id long, text string, lang string, toxic string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert [r.score < 1e-9 for r in toxicity.score(docs, model).collect()] == [True] * 4
    assert toxicity.keep_clean(docs, model).count() == 4
    assert toxicity.score(docs.where("false"), model).count() == 0


def drawn_model(rng, buckets=64, size=5, each=4):
    filters = [rng.normal(0, 0.5, (w, size, each)).astype(np.float32) for w in toxicity.WIDTHS]
    return toxicity.Model(rng.normal(0, 0.5, (buckets, size)).astype(np.float32), filters, rng.normal(0, 0.2, 3 * each).astype(np.float32), rng.normal(0, 0.5, 3 * each).astype(np.float32), 0.1)


def plain_logit(model, text):
    """Words, their vectors, every filter at every place, the largest response, one by one."""
    x = [model.embedding[toxicity.word_features(pa.array([w], pa.large_string()), len(model.embedding))[0][0]].astype(float).sum(axis=0) for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
    at = lambda i: x[i] if i < len(x) else np.zeros(model.embedding.shape[1])
    logit, k = float(model.constant), 0
    for f in model.filters:
        for c in range(f.shape[2]):
            most = max(sum(float(at(i + j) @ f[j, :, c].astype(float)) for j in range(len(f))) for i in range(max(1, len(x))))
            logit += max(0.0, most + float(model.bias[k])) * float(model.weight[k])
            k += 1
    return logit


TEXTS = ["one two three", "", "word", "a b c d e f g a b c", "Ünï 漢字 x9, y! (z)", "two two two one"]


def test_convolution_and_pooling():
    model = drawn_model(np.random.default_rng(1))
    got = model.logits(pa.array(TEXTS, pa.large_string()))
    assert np.allclose(got, [plain_logit(model, t) for t in TEXTS], atol=1e-4)


def test_gradients():
    """A step's gradients, read from what it adds to the squared sums, against differences of the plain loss."""
    rng = np.random.default_rng(2)
    model = drawn_model(rng)
    y = np.array([1, 0, 1, 0, 1, 0], np.float32)

    def loss():
        z = np.array([plain_logit(model, t) for t in TEXTS])
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))) + 0.5e-4 * float((model.weight.astype(float) ** 2).sum())

    parts = {"w": lambda: model.weight, "b": lambda: model.bias, "e": lambda: model.embedding, **{f"f{i}": lambda i=i: model.filters[i] for i in range(3)}}
    want = {}
    for name, of in parts.items():
        value = of()
        for at in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(12)]:
            kept, d = value[at], 1e-3
            value[at] = kept + d
            up = loss()
            value[at] = kept - d
            want[name, at] = (up - loss()) / (2 * d)
            value[at] = kept
    before = {name: of().copy() for name, of in parts.items()}
    seen = {}
    toxicity._step(model, toxicity.word_features(pa.array(TEXTS, pa.large_string()), len(model.embedding)), y, np.ones(len(model.embedding), bool), seen, 1e-3)
    off = []
    for (name, at), w in want.items():
        g = np.sign(before[name][at] - parts[name]()[at]) * np.sqrt(max(0.0, seen[name][at] - 1e-4))
        off.append(abs(g - w))
    assert np.quantile(off, 0.95) < 5e-3 and max(abs(w) for w in want.values()) > 0.05, sorted(off)[-5:]
