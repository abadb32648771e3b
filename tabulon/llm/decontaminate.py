"""Benchmark decontamination: a BM25 inverted index of test items, searched by every training passage with block-max WAND.

An item's impact of a term is its BM25 weight divided by the item's sum of weights, so an item's score is the share of it
that a passage covers, and one threshold serves all items. A text is cut into cells of as many words as the longest item
has (64 at least); a passage is two cells in a row, so every occurrence of an item lies in a passage whole.

All passages are searched. Before the document-at-a-time search a bound is taken for all passages of a batch at once:
items are dealt into `BLOCKS` blocks, a term's bound in a block is its largest impact there, frequent terms together
count as the most that they make up of one item of the block, and a passage below the threshold in all blocks is done.
The others run block-max WAND over posting lists with a bound for every `POSTINGS` postings. Items at or above the
threshold are verified: of question (all but the last sentence or line) and answer (the rest) a share of `overlap` of the
words at least must occur in order, each within 1.6 item lengths at any place of the passage, with other text between them
or not; each place counts. A short item (below 8 words) must occur as it is.

The index is broadcast; its items have at most `most_bytes` of text together (its size is a few times that: postings and
block bounds are kept for the terms that an item has), more are searched in further passes over the texts. Document
frequencies, the number of items, their mean length and the longest one are those of all items in every pass, so a
score doesn't depend on the passes. Cases: null and empty items match nothing; null and empty texts and texts shorter
than an item give no rows unless they hold the item; very long texts are searched whole; repeated rows of texts or items
give rows each (items with one id, too; equal items are indexed once and counted); an empty table on either side gives no
rows; of places that overlap the one with the larger overlaps counts, of ties the first; columns other than those named
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.kernels import buffers, slices, span_hashes, texts, word_bounds
from tabulon.llm.toxicity import _BREAK
from tabulon.session import forget, small_batches, written

BLOCKS, POSTINGS, CELL, SHORT = 256, 8, 64, 8
K1, B = 1.2, 0.75


def words_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = buffers(arr)
    start, end, woff = word_bounds(data, off, _BREAK)
    return span_hashes(data, start, end), woff


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last line, or else the last sentence, is the answer; an item of one sentence is cut in half."""
    text = text.strip()
    head, _, tail = text.rpartition("\n")
    if not head.strip():
        m = list(re.finditer(r"[.?!:]\s+(?=\S)", text))
        at = m[-1].end() if m else text.find(" ", len(text) // 2)
        head, tail = (text[:at], text[at:]) if at > 0 else (text, "")
    return head, tail


class Index:
    """BM25 impacts of the items, posting lists with block maxima, and the bounds of item blocks.

    times: how often each item occurs in its table; overall: (items, mean length, longest, {term: document frequency}) of
    all items where these are a part of them."""

    def __init__(self, ids: list[int], items: list[str], threshold: float, times: list[int] | None = None, overall: tuple[int, float, int, dict[int, int]] | None = None):
        self.ids, self.threshold = ids, threshold
        self.times = np.array(times or [1] * len(ids), np.int64)
        parts = [split_item(t) for t in items]
        self.question = self._parts([p[0] for p in parts])
        self.answer = self._parts([p[1] for p in parts])
        self.words = [np.concatenate(x) for x in zip(self.question, self.answer, strict=True)]
        n = np.array([len(w) for w in self.words], np.int64)
        many, mean, longest, frequency = overall or (int(self.times.sum()), float((n * self.times).sum() / max(1, self.times.sum())), max(n.tolist(), default=0), None)
        self.cell = max(CELL, longest)
        item = np.repeat(np.arange(len(n)), n)
        flat = np.concatenate([*self.words, np.zeros(0, np.uint64)])
        self.terms, t = np.unique(flat, return_inverse=True)
        pairs, tf = np.unique(t.astype(np.int64) * max(1, len(n)) + item, return_counts=True)
        term, doc = pairs // max(1, len(n)), pairs % max(1, len(n))
        df = np.bincount(term, minlength=len(self.terms))
        if frequency is None:
            holding = np.bincount(term, self.times[doc], minlength=len(self.terms))
        else:
            holding = np.array([frequency[int(t)] for t in self.terms.view(np.int64)], float)
        idf = np.log1p((many - holding + 0.5) / (holding + 0.5))
        w = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[doc] / max(1.0, mean)))
        w /= np.bincount(doc, w, minlength=len(n))[doc]
        self.doc, self.impact = doc.astype(np.int32), w.astype(np.float32)
        self.at = np.concatenate([[0], np.cumsum(df)])
        self.most = np.maximum.reduceat(self.impact, self.at[:-1]) if len(self.terms) else np.zeros(0, np.float32)
        self.blocks = max(1, min(BLOCKS, len(n)))
        # a term's bounds: its blocks in order, each with the largest impact there
        cells, inverse = np.unique(term * self.blocks + doc * self.blocks // max(1, len(n)), return_inverse=True)
        self.bound_block = (cells % self.blocks).astype(np.int32)
        self.bound = np.zeros(len(cells), np.float32)
        np.maximum.at(self.bound, inverse, self.impact)
        self.bound_at = np.searchsorted(cells // self.blocks, np.arange(len(self.terms) + 1))
        # Frequent terms, as many as leave less than a third of the threshold to any item, count together.
        held = np.zeros(len(n))
        self.rare = np.ones(len(self.terms) + 1, bool)
        self.rare[-1] = False
        for k in np.argsort(-df, kind="stable"):
            d = self.doc[self.at[k] : self.at[k + 1]]
            if (held[d] + self.impact[self.at[k] : self.at[k + 1]]).max() > threshold / 3:
                break
            held[d] += self.impact[self.at[k] : self.at[k + 1]]
            self.rare[k] = False
        self.rest = np.zeros(self.blocks, np.float32)
        np.maximum.at(self.rest, np.arange(len(n)) * self.blocks // max(1, len(n)), held)

    @staticmethod
    def _parts(many: list[str]) -> list[np.ndarray]:
        h, off = words_of(pa.array(many, pa.large_string()))
        return [h[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The term of each word; len(terms) for words of no item."""
        if not len(self.terms):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, len(self.terms))

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """All items that the distinct terms score at the threshold or above: block-max WAND."""
        theta, out = self.threshold, []
        cur = [[int(self.at[t]), int(self.at[t + 1]), float(self.most[t]), int(t)] for t in terms.tolist()]
        doc, impact = self.doc, self.impact
        while cur:
            cur.sort(key=lambda c: doc[c[0]])
            total, pivot = 0.0, -1
            for i, c in enumerate(cur):
                total += c[2]
                if total >= theta - 1e-6:
                    pivot = i
                    break
            if pivot < 0:
                break
            d = int(doc[cur[pivot][0]])
            while pivot + 1 < len(cur) and doc[cur[pivot + 1][0]] == d:
                pivot += 1
            bound, nearest = 0.0, len(self.ids)
            for c in cur[: pivot + 1]:
                first = int(self.at[c[3]])
                k = c[0] + int(np.searchsorted(doc[c[0] : c[1]], d))
                if k < c[1]:
                    s = first + (k - first) // POSTINGS * POSTINGS
                    e = min(s + POSTINGS, c[1])
                    bound += float(impact[s:e].max())
                    nearest = min(nearest, int(doc[e - 1]) + 1)
            if bound < theta - 1e-6:
                to = max(d + 1, nearest)
                if pivot + 1 < len(cur):
                    to = max(d + 1, min(to, int(doc[cur[pivot + 1][0]])))
                for c in cur[: pivot + 1]:
                    c[0] += int(np.searchsorted(doc[c[0] : c[1]], to))
            elif doc[cur[0][0]] == d:
                score = sum(float(impact[c[0]]) for c in cur[: pivot + 1])
                if score >= theta - 1e-6:
                    out.append((d, score))
                for c in cur[: pivot + 1]:
                    c[0] += 1
            else:
                for c in cur[: pivot + 1]:
                    c[0] += int(np.searchsorted(doc[c[0] : c[1]], d))
            cur = [c for c in cur if c[0] < c[1]]
        return out


def in_order(part: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """The longest common subsequence's share of the part's words, and the span of the passage's words where it may lie (by matches that are close together)."""
    if not len(part):
        return 1.0, -1, -1
    masks: dict[int, int] = {}
    for i, w in enumerate(part.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(part)) - 1
    v, lengths = full, []
    for w in passage.tolist():
        m = v & masks.get(w, 0)
        v = (v + m | v - m) & full
        lengths.append(len(part) - v.bit_count())
    best = lengths[-1] if lengths else 0
    end = lengths.index(best) + 1 if best else -1
    return best / len(part), end - len(part) if best else -1, end


def _places(part: np.ndarray, passage: np.ndarray, width: int, overlap: float) -> list[tuple[float, int, int]]:
    """(share, start, end) of all places of the passage, apart from each other, where within `width` words enough of the part's words occur in order."""
    hit = np.flatnonzero(np.isin(passage, part))
    near = np.searchsorted(hit, hit + width) - np.arange(len(hit))
    found = set()
    for k in np.flatnonzero(near >= overlap * len(part) - 1e-9).tolist():
        own = hit[k : k + int(near[k])]
        share, _, end = in_order(part, passage[own])
        if share >= overlap:
            _, _, back = in_order(part[::-1], passage[own[:end]][::-1])
            found.add((share, int(own[end - back]), int(own[end - 1]) + 1))
    out: list[tuple[float, int, int]] = []
    for f in sorted(found, key=lambda f: (-f[0], f[2] - f[1], f[1])):
        if all(f[2] <= o[1] or f[1] >= o[2] for o in out):
            out.append(f)
    return out


def _verified(index: Index, item: int, passage: np.ndarray, overlap: float) -> list[tuple[float, float, int, int]]:
    """(question's share, answer's share, start, end) of all places of the item: the question wherever it is, with the answer nearest to it."""
    words = index.words[item]
    out: list[tuple[float, float, int, int]] = []
    if len(words) < SHORT:
        for i in np.flatnonzero(passage[: max(0, len(passage) - len(words) + 1)] == words[0]).tolist() if len(words) else []:
            if (passage[i : i + len(words)] == words).all() and (not out or i >= out[-1][3]):
                out.append((1.0, 1.0, i, i + len(words)))
        return out
    width = len(words) + 3 * (len(words) // 5)
    questions, answers = (_places(p[item], passage, width, overlap) if len(p[item]) else None for p in (index.question, index.answer))
    if questions is None or answers is None:
        many = [(f[0], 1.0, f[1], f[2]) if answers is None else (1.0, f[0], f[1], f[2]) for f in questions or answers or []]
    else:
        many = []
        for share, s, e in questions:
            if answers:
                other = min(answers, key=lambda f: (max(f[1] - e, s - f[2], 0), f[1] < s))
                many.append((share, other[0], min(s, other[1]), max(e, other[2])))
    for f in sorted(many, key=lambda f: (f[3] - f[2], f[2])):
        if all(f[3] <= o[2] or f[2] >= o[3] for o in out):
            out.append(f)
    return out


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])


def matches(arr: pa.Array, index: Index, overlap: float) -> list[tuple[int, int, int, int, float, float, float]]:
    """(text, item, start word, end word, score, overlaps) of all verified items in the texts."""
    h, woff = words_of(arr)
    n = np.diff(woff)
    cells = np.maximum((n + index.cell - 1) // index.cell, (n > 0).astype(np.int64))
    if not cells.sum() or not len(index.terms):
        return []
    text = np.repeat(np.arange(len(n)), cells)
    first = np.cumsum(cells) - cells
    at = woff[:-1][text] + (np.arange(len(text)) - first[text]) * index.cell
    term = index.lookup(h)
    hit = np.flatnonzero(index.rare[term])
    v = len(index.terms) + 1
    pairs = np.unique((np.searchsorted(at, hit, side="right") - 1) * v + term[hit])  # each term of a cell once
    bound = np.zeros((len(text) + 1) * index.blocks, np.float32)
    for some in np.array_split(pairs, 1 + len(pairs) // (1 << 18)):
        t = some % v
        many = index.bound_at[t + 1] - index.bound_at[t]
        entry = np.arange(many.sum()) + np.repeat(index.bound_at[t] - np.cumsum(many) + many, many)
        bound += np.bincount(np.repeat(some // v * index.blocks, many) + index.bound_block[entry], index.bound[entry], len(bound)).astype(np.float32)
    bound = bound.reshape(-1, index.blocks)
    last = np.append(text[1:] != text[:-1], True)
    both = bound[:-1] + np.where(last[:, None], 0, bound[1:])
    chosen = np.flatnonzero((both + index.rest >= index.threshold - 1e-5).any(axis=1))
    found: dict[tuple[int, int], list[tuple]] = {}
    for c in chosen.tolist():
        t = int(text[c])
        s, e = int(at[c]), int(min(woff[t + 1], at[c] + 2 * index.cell))
        own = np.unique(term[s:e])
        for item, score in index.search(own[own < len(index.terms)]):
            for v in _verified(index, item, h[s:e], overlap):
                start, end = s + v[2] - int(woff[t]), s + v[3] - int(woff[t])
                have = found.setdefault((t, item), [])
                same = [f for f in have if min(end, f[3]) > max(start, f[2])]
                if all((v[0] + v[1], score) > (f[5] + f[6], f[4]) for f in same):
                    have[:] = [f for f in have if f not in same] + [(t, item, start, end, score, v[0], v[1])]
    return sorted(f for many in found.values() for f in many)


def _search(batches: Iterator[pa.RecordBatch], index, overlap: float) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, most=2 << 20):
        rows = matches(texts(b.column(1)), index.value, overlap)
        if rows:
            ids = b.column(0).to_pylist()
            columns = list(zip(*((ids[t], index.value.ids[i], *rest) for t, i, *rest in rows for _ in range(int(index.value.times[i]))), strict=True))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, times, text): (part, times, words, distinct terms)."""
    for b in slices(batches):
        h, off = words_of(texts(b.column(2)))
        terms = [np.unique(h[x:y]).view(np.int64) for x, y in zip(off[:-1], off[1:], strict=True)]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(np.diff(off)), pa.array(terms, pa.list_(pa.int64()))], names=["part", "times", "words", "terms"])


def _indexes(docs: DataFrame, items: DataFrame, threshold: float, item_id: str, item_text: str, most_bytes: int) -> Iterator:
    """Broadcast indexes of the items with at most about most_bytes of text each, dealt by a hash of the item."""
    tests = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where("text is not null and trim(text) <> ''")
    tests = written(tests.groupBy("id", "text").agg(F.count("*").alias("times")), "leak-items")
    passes = max(1, -(-int(tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most_bytes))
    dealt = tests.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(passes)).cast("int"))
    overall = None
    if passes > 1:
        terms = written(dealt.select("part", "times", "text").mapInArrow(_item_terms, "part int, times long, words long, terms array<long>"), "leak-terms")
        many, words, longest = terms.agg(F.sum("times"), F.sum(F.col("times") * F.col("words")), F.max("words")).first()
        each = terms.select("part", "times", F.explode("terms").alias("term"))
        frequency = written(each.groupBy("term").agg(F.sum("times").alias("df")), "leak-frequencies")
        own_terms = written(each.select("part", "term").distinct().join(frequency, "term"), "leak-own-frequencies")
        forget(terms, frequency)
    for k in range(passes):
        own = sorted(((r.id, r.text, r.times) for r in dealt.where(F.col("part") == k).select("id", "text", "times").collect()), key=str)
        if passes > 1:
            overall = (many, words / many, longest, {r.term: r.df for r in own_terms.where(F.col("part") == k).select("term", "df").collect()})
        yield docs.sparkSession.sparkContext.broadcast(Index([i for i, *_ in own], [t for _, t, _ in own], threshold, [n for *_, n in own], overall))
    forget(tests, *([own_terms] if passes > 1 else []))


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.8, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most_bytes: int = 4 << 20) -> DataFrame:
    """A row for each occurrence of a test item in a text: doc_id, item_id, words from and to, score, overlaps."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for index in _indexes(docs, items, threshold, item_id, item_text, most_bytes):
        part = rows.mapInArrow(partial(_search, index=index, overlap=overlap), "doc_id long, item_id long, start_word long, end_word long, score double, question_overlap double, answer_overlap double")
        out = part if out is None else out.unionByName(part)
    return out


def _clean(batches: Iterator[pa.RecordBatch], index, overlap: float, text: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices([whole], whole.schema.names[text], 2 << 20):
            keep = np.ones(b.num_rows, bool)
            keep[[m[0] for m in matches(texts(b.column(text)), index.value, overlap)]] = False
            yield b.filter(pa.array(keep))


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.8, text: str = "text", item_id: str = "item_id", item_text: str = "text", most_bytes: int = 4 << 20) -> DataFrame:
    """The rows of docs, with all columns, that hold no test item; decided row by row, so rows without an id and repeated rows too."""
    small_batches(docs.sparkSession)
    for index in _indexes(docs, items, threshold, item_id, item_text, most_bytes):
        docs = docs.mapInArrow(partial(_clean, index=index, overlap=overlap, text=docs.columns.index(text)), docs.schema)
    return docs
