"""Toxicity: a convolutional text classifier trained in NumPy, with decision thresholds calibrated by language.

Words (runs of ASCII letters and digits and of other characters, A-Z as a-z) get the sum of hashed embeddings of the
word and of its first 3 to 6 bytes. Filters of one, two and three words run over the whole text, each keeps its largest
response (max pooling), and a logistic unit scores them. Training is stochastic gradient descent (Adagrad) on a sample of
at most `max_rows` labelled texts, whole; embeddings start from the smoothed log-odds of their presence, features in
fewer than `least_docs` texts stay at zero. A fifth of the sample sets the epoch, the scale of the score (0.5 parts the
labels best over all languages) and a threshold for each language with enough toxic texts. The score sees the text only;
a language's threshold matters to `decide` alone.

Cases: null and empty texts get the score of a text without words; very long texts are scored whole, a few MB at a time;
labels other than 0 and 1 are left out of training; repeated label rows count again; without labels of both kinds every
score is 0; an empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.kernels import buffers, slices, span_hashes, texts, word_bounds
from tabulon.session import small_batches

_BREAK = np.ones(256, dtype=bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
PREFIXES = (3, 4, 5, 6)
WIDTHS = (1, 2, 3)


def word_features(arr: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets of each distinct word (a row each), the distinct word at each place, and the texts' offsets."""
    data, off = buffers(arr)
    start, end, woff = word_bounds(data, off, _BREAK)
    if not len(start):
        return np.zeros((0, len(PREFIXES) + 1), np.int64), np.zeros(0, np.int64), woff
    coded = pa.array(span_hashes(data, start, end)).dictionary_encode()
    inv = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.empty(len(coded.dictionary), np.int64)
    first[inv[::-1]] = np.arange(len(inv) - 1, -1, -1)
    s, e = start[first], end[first]
    columns = [coded.dictionary.to_numpy(zero_copy_only=False) % np.uint64(buckets)]
    for n in PREFIXES:
        columns.append(span_hashes(data, s, np.minimum(s + n, e)) * np.uint64(2 * n + 1) % np.uint64(buckets))
    return np.stack(columns, axis=1).astype(np.int64), inv, woff


@dataclass
class Model:
    embedding: np.ndarray  # buckets x size
    filters: list[np.ndarray]  # of each width: width x size x filters
    bias: np.ndarray  # of each filter
    weight: np.ndarray
    constant: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def responses(self, words: np.ndarray, inv: np.ndarray, woff: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Each width's responses at every row, the rows' input, and the first and last row of each text. Texts are two rows of zeros apart."""
        n = np.diff(woff)
        rows = np.maximum(n, 1)
        begin = np.cumsum(rows + 2) - rows - 2
        x = np.zeros((int(begin[-1] + rows[-1] + 3) if len(n) else 3, self.embedding.shape[1]), np.float32)
        vectors = self.embedding[words].sum(axis=1)
        x[np.repeat(begin - woff[:-1], n) + np.arange(len(inv))] = vectors[inv]
        out = []
        for f in self.filters:
            y = x @ f[0]
            for j in range(1, len(f)):
                y[:-j] += x[j:] @ f[j]
            out.append(y)
        return out, x, begin, begin + rows

    def logits(self, arr: pa.Array, most: int = 1 << 18) -> np.ndarray:
        """The logit of each text; about `most` bytes of text at a time, as a word takes some 400 bytes here."""
        cum = buffers(arr)[1][1:]
        parts, at = [np.zeros(0, np.float32)], 0
        while at < len(arr):
            to = max(at + 1, int(np.searchsorted(cum, (cum[at - 1] if at else 0) + most, side="right")))
            parts.append(self._logits(arr.slice(at, to - at)))
            at = to
        return np.concatenate(parts)

    def _logits(self, arr: pa.Array) -> np.ndarray:
        out, _, begin, end = self.responses(*word_features(arr, len(self.embedding)))
        cuts = np.stack([begin, end], axis=1).ravel()
        pooled = np.concatenate([np.maximum.reduceat(y, cuts, axis=0)[::2] for y in out], axis=1)
        return np.maximum(pooled + self.bias, 0) @ self.weight + self.constant

    def scores(self, arr: pa.Array) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(arr).astype(np.float64) + b, -40, 40)))


def _initial(batches: list, y: np.ndarray, buckets: int, size: int, each: int, least_docs: int, rng: np.random.Generator) -> tuple[Model, np.ndarray]:
    have = np.zeros((2, buckets))
    for (words, inv, woff), at in batches:
        for k, i in enumerate(at):
            own = np.unique(words[np.unique(inv[woff[k] : woff[k + 1]])])
            have[int(y[i]), own] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    odds = np.log((have[1] + 1) / (n[1] + 2)) - np.log((have[0] + 1) / (n[0] + 2))
    odds *= have.sum(0) / (have.sum(0) + 3)
    known = have.sum(0) >= least_docs
    e = rng.normal(0, 0.05, (buckets, size)).astype(np.float32)
    e[:, 0] = np.clip(odds, -1, 4) / 4
    e[~known] = 0
    filters = [rng.normal(0, 0.3 / np.sqrt(w * size), (w, size, each)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, 0] += 0.5
    return Model(e, filters, np.zeros(len(WIDTHS) * each, np.float32), rng.normal(0.05, 0.02, len(WIDTHS) * each).astype(np.float32), float(np.log((n[1] + 1) / (n[0] + 1)))), known


def _step(model: Model, batch: tuple, y: np.ndarray, known: np.ndarray, seen: dict, rate: float) -> None:
    words, inv, woff = batch
    out, x, begin, end = model.responses(words, inv, woff)
    each = model.filters[0].shape[2]
    top = np.stack([np.concatenate([b + o[b:e].argmax(axis=0) for o in out]) for b, e in zip(begin, end, strict=True)])
    col = np.arange(each)
    pooled = np.concatenate([o[top[:, i * each : (i + 1) * each], col] for i, o in enumerate(out)], axis=1) + model.bias
    h = np.maximum(pooled, 0)
    p = 1 / (1 + np.exp(-np.clip(h @ model.weight + model.constant, -30, 30)))
    d = ((p - y) / len(y)).astype(np.float32)
    dh = d[:, None] * model.weight * (pooled > 0)

    def move(name: str, value: np.ndarray, g: np.ndarray) -> None:
        a = seen.setdefault(name, np.full(value.shape, 1e-4, np.float32))
        a += g * g
        value -= rate * g / np.sqrt(a)

    dx = np.zeros_like(x)
    for i, f in enumerate(model.filters):
        at, g = top[:, i * each : (i + 1) * each], dh[:, i * each : (i + 1) * each]
        df = np.zeros_like(f)
        for j in range(len(f)):
            df[j] = np.einsum("bfd,bf->df", x[at + j], g)
            np.add.at(dx, (at + j).ravel(), (g[:, :, None] * f[j].T[None]).reshape(-1, x.shape[1]))
        move(f"f{i}", f, df)
    move("w", model.weight, h.T @ d + 1e-4 * model.weight)
    move("b", model.bias, dh.sum(0))
    model.constant -= 0.05 * float(d.sum())
    row = np.repeat(begin - woff[:-1], np.diff(woff)) + np.arange(len(inv))
    hit = np.flatnonzero(np.abs(dx[row]).sum(1) > 0)
    ids = words[inv[hit]]
    rows, back = np.unique(ids, return_inverse=True)
    g = np.zeros((len(rows), x.shape[1]), np.float32)
    np.add.at(g, back.ravel(), np.repeat(dx[row[hit]], ids.shape[1], axis=0))
    g[~known[rows]] = 0
    a = seen.setdefault("e", np.full(model.embedding.shape, 1e-4, np.float32))
    a[rows] += g * g
    model.embedding[rows] -= rate * g / np.sqrt(a[rows])


def _best_cut(values: np.ndarray, y: np.ndarray, usual: float) -> float:
    """The cut of the best F1: the usual one if it is among the best, else the middle of the span they fill."""
    order = np.sort(np.unique(values))
    cuts = np.concatenate([[order[0] - 1e-6], (order[1:] + order[:-1]) / 2, [order[-1] + 1e-6], [usual]])
    f1 = np.array([2 * ((values >= c) & (y == 1)).sum() / max(1, (values >= c).sum() + (y == 1).sum()) for c in cuts])
    top = np.sort(cuts[f1 >= f1.max() - 1e-12])
    if top[0] <= usual <= top[-1]:
        return usual
    # between the neighbours of the best cuts, so that a wide gap is cut in its middle
    below, above = values[values < top[0]], values[values >= top[-1]]
    return float(((below.max() if len(below) else top[0]) + (above.min() if len(above) else top[-1])) / 2)


def train(many: list[str], labels: list[int], languages: list[str], buckets: int = 1 << 16, size: int = 16, each: int = 16, least_docs: int = 3, epochs: int = 8, rate: float = 0.05, batch_rows: int = 32, seed: int = 1) -> Model:
    """A model of the labelled texts; every fifth is held for calibration."""
    y = np.array(labels, np.float32)
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    if len({*y[~held]}) < 2 or len({*y[held]}) < 2:
        if len({*y}) < 2:
            return Model(np.zeros((1, size), np.float32), [np.zeros((w, size, each), np.float32) for w in WIDTHS], np.zeros(each * len(WIDTHS), np.float32), np.zeros(each * len(WIDTHS), np.float32), -40.0)
        held[:] = False
    order = np.flatnonzero(~held)
    rng.shuffle(order)
    batches = [(word_features(pa.array([many[i] for i in at], pa.large_string()), buckets), at) for at in (order[i : i + batch_rows] for i in range(0, len(order), batch_rows))]
    model, known = _initial(batches, y, buckets, size, each, least_docs, rng)
    check = held if held.any() else ~held
    aside = pa.array([many[i] for i in np.flatnonzero(check)], pa.large_string())
    best, least, seen = None, np.inf, {}
    for _ in range(epochs):
        rng.shuffle(batches)
        for features, at in batches:
            _step(model, features, y[at], known, seen, rate)
        z = model.logits(aside).astype(np.float64)
        s = np.where(y[check] == 1, z, -z)
        loss = float(np.logaddexp(0, -np.clip(s, -30, 30)).mean())
        if loss < least:
            least, best = loss, Model(model.embedding.copy(), [f.copy() for f in model.filters], model.bias.copy(), model.weight.copy(), model.constant)
    best.scale = (1.0, -_best_cut(best.logits(aside).astype(np.float64), y[check], 0.0))
    best.thresholds = _thresholds(best.scores(aside), y[check], [languages[i] for i in np.flatnonzero(check)])
    return best


def _thresholds(scores: np.ndarray, y: np.ndarray, languages: list[str], least: int = 10) -> dict[str, float]:
    """The best cut for each language with enough texts of both kinds; others keep 0.5."""
    out = {}
    lang = np.array([x or "" for x in languages])
    for name in sorted({*lang.tolist()}):
        s, t = scores[lang == name], y[lang == name]
        if (t == 1).sum() < least or (t == 0).sum() < least:
            continue
        out[name] = _best_cut(s, t, 0.5)
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", **options) -> Model:
    """Trains on the max_rows labelled rows of lowest hash that are not held out; so few rows are broadcast to the texts."""
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).join(F.broadcast(marks), "doc_id").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text or ""))
    return train([r.text or "" for r in rows], [r.y for r in rows], [r.lang for r in rows], **options)


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, most=2 << 20):
        yield pa.record_batch([b.column(0), pa.array(model.value.scores(texts(b.column(1))))], names=["doc_id", "score"])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(partial(_score, model=shared), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def _decide(batches: Iterator[pa.RecordBatch], model, text: int, lang: int) -> Iterator[pa.RecordBatch]:
    for b in (piece for whole in batches for piece in slices([whole], whole.schema.names[text], 2 << 20)):
        s = model.value.scores(texts(b.column(text)))
        limit = np.array([model.value.thresholds.get(x or "", 0.5) for x in b.column(lang).to_pylist()])
        yield b.filter(pa.array(s < limit))


def keep_clean(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs, with all their columns, whose score is below their language's threshold."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_decide, model=shared, text=docs.columns.index(text), lang=docs.columns.index(lang)), docs.schema)
