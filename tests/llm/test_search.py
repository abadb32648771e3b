"""Decontamination and near-dedup against brute force."""

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tabulon.llm import decontaminate, near_dup
from tabulon.llm.kernels import distinct, shingles, texts, word_hashes
from tabulon.session import table
from tests.conftest import SF, SF_MID


def test_wand_finds_all_above_threshold():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)]
    weight = 1 / np.arange(1, 301)
    items = [" ".join(rng.choice(vocabulary, rng.integers(3, 30), p=weight / weight.sum())) for _ in range(120)]
    index = decontaminate.Index(list(range(120)), items, 0.4)
    for _ in range(60):
        words = set(rng.choice(vocabulary, 40, p=weight / weight.sum())) | set(rng.choice(items).split()[: rng.integers(2, 30)])
        h, _ = decontaminate.words_of(pa.array([" ".join(sorted(words))], pa.large_string()))
        terms = np.unique(index.lookup(h))
        terms = terms[terms < len(index.terms)]
        want = np.zeros(120)
        for t in terms:
            want[index.doc[index.at[t] : index.at[t + 1]]] += index.impact[index.at[t] : index.at[t + 1]]
        got = dict(index.search(terms))
        assert {*got} >= {*np.flatnonzero(want >= 0.4 + 1e-6)} and all(abs(want[d] - s) < 1e-5 and s >= 0.4 - 1e-5 for d, s in got.items())


def test_leaks_in_the_documents(spark):
    docs, items = table(spark, SF_MID, "documents"), table(spark, SF_MID, "benchmark")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    want = {(d.doc_id, b.item_id) for d, b in itertools.product(docs.collect(), items.collect()) if b.text in d.text}
    assert want and got == want


def test_leaks_odd(spark):
    item = "What is the tallest tower of the old town near the river bank where traders met each spring? It is the grey clock tower."
    filler = " ".join(f"f{i}" for i in range(5000))
    rows = [(1, item), (2, f"{filler} {item.upper()} {filler}"), (3, item.replace("tallest", "highest")), (4, item[:60]), (5, None), (6, ""), (None, item), (1, item), (7, filler), (8, "say Short Answer, now"), (9, "short long answer")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "", 0), (4, "short answer", 0), (4, "short answer", 0)], "item_id long, text string, doc_id int")
    got = sorted((r.doc_id or 0, r.item_id) for r in decontaminate.leaks(docs, items).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (8, 4), (8, 4)]
    many = sorted((r.doc_id or 0, r.item_id) for r in decontaminate.leaks(docs, items, most_bytes=60).collect())
    assert many == got
    clean = decontaminate.without_leaks(docs, items, most_bytes=60)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [4, 5, 6, 7, 9]
    assert decontaminate.leaks(docs.where("false"), items).count() == 0 and decontaminate.leaks(docs, items.where("false")).count() == 0


def test_leaks_at_every_place():
    item = "What is the tallest tower of the old town near the river bank where traders met each spring? It is the grey clock tower."
    question, answer = decontaminate.split_item(item)
    index = decontaminate.Index([1], [item], 0.6)
    filler = lambda n: " ".join(f"f{i}" for i in range(n))
    w = item.split()
    shuffled = " ".join(w[::-1] + w[::2][::-1])
    rows = [f"{shuffled} {filler(20)} {item} {filler(20)}", f"{question} {filler(50)} {answer}", f"{item} {filler(9)} {item} {filler(60)} {item}", shuffled, question, f"{answer} {filler(90)}"]
    got = [[m[2:4] for m in decontaminate.matches(texts(pa.array([r])), index, 0.8)] for r in rows]
    n, q = len(w), len(question.split())
    start = len(shuffled.split()) + 20
    assert got == [[(start, start + n)], [(0, n + 50)], [(0, n), (n + 9, 2 * n + 9), (2 * n + 69, 3 * n + 69)], [], [], []] and q < n


def test_edited_items_are_found(spark):
    """Every benchmark item with a word in twelve replaced, put in or left out, in the midst of other text."""
    rng = np.random.default_rng(4)
    items = [(r.item_id, r.text) for r in table(spark, SF_MID, "benchmark").collect()]
    filler = lambda n: " ".join(f"f{i}" for i in rng.integers(0, 10**6, n))
    rows = []
    for item, text in items:
        w = text.split(" ")
        for at in rng.choice(len(w), max(1, len(w) // 12), replace=False).tolist():
            w[at] = ["", f"{w[at]} new{at}", f"other{at}"][int(rng.integers(0, 3))]
        rows.append((item, f"{filler(90)} {' '.join(w)} {filler(70)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, table(spark, SF_MID, "benchmark")).collect()}
    hit = sum((i, i) in found for i, _ in items)
    assert hit >= 0.9 * len(items), (hit, len(items))


def test_index_grows_with_its_postings():
    rng = np.random.default_rng(2)
    items = [" ".join(f"w{i}" for i in rng.zipf(1.3, 60) % 10**6) for _ in range(5000)]
    index = decontaminate.Index(list(range(5000)), items, 0.6)
    size = sum(a.nbytes for a in vars(index).values() if isinstance(a, np.ndarray)) + sum(w.nbytes for many in (index.words, index.question, index.answer) for w in many)
    assert size < 10 * sum(map(len, items))


def test_scores_do_not_depend_on_passes(spark):
    items = table(spark, SF, "benchmark")
    docs = table(spark, SF, "documents")
    one, many = ({(r.doc_id, r.item_id, r.start_word, r.end_word, round(r.score, 5)) for r in decontaminate.leaks(docs, items, most_bytes=n).collect()} for n in (4 << 20, 2000))
    assert one and one == many


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_groups(rows, k, similarity):
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both):
            parent[top(i)] = top(j)
    first = {}
    for i, (d, _) in enumerate(rows):  # rows of one id are one document, linked by each text that has words
        if d is not None and sets[i]:
            parent[top(i)] = top(first.setdefault(d, i))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d or -1, len(sets[i]), -1 if d is None else least[top(i)]) for i, (d, _) in enumerate(rows))


def got_groups(df):
    return sorted((r.doc_id or -1, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in df.collect())


def test_near_groups(spark):
    rng = np.random.default_rng(5)
    base = [f"v{i}" for i in rng.integers(0, 500, 120)]
    rows = [(i, t) for i, t in enumerate(["A b  c", "a B\tc", "a", "", None, "a b c d e", "  ", "é É"], 1)]
    for i in range(90):  # copies of one text with 1 to 8 words changed: chains of links, similarities about 0.8
        w = list(base)
        for p in rng.integers(0, 120, rng.integers(1, 9)):
            w[p] = f"n{rng.integers(0, 10**6)}"
        rows.append((100 + i, " ".join(w)))
    rows += [(100, " ".join(base)), (None, " ".join(base)), (700, "long " * 3000), (701, "long " * 2500)]
    rows += [(800, "one two three four five"), (802, "six seven eight nine ten"), (802, "one two three four five"), (802, ""), (803, "six seven eight nine ten")]
    docs = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id long, text string, n int, mark string")
    got = near_dup.near_groups(docs, 4)
    assert got_groups(got) == brute_groups(rows, 4, 80)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got.collect())
    assert near_dup.near_groups(docs.where("false"), 4).count() == 0


def test_large_mixed_buckets(spark, monkeypatch):
    """Hubs, and buckets of many components in small blocks: no link is lost, and only rows outside the largest component are copied much."""
    rng = np.random.default_rng(9)
    base = [f"v{i}" for i in rng.integers(0, 500, 60)]
    rows = []
    for i in range(420):
        w = list(base)
        for p in rng.integers(0, 60, 1 if i < 300 else 3):
            w[p] = f"n{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "SPREAD", 8)
    assert got_groups(near_dup.near_groups(docs, 4)) == brute_groups(rows, 4, 80)


def test_blocks_copy_the_largest_component_once(spark):
    named = spark.createDataFrame([(0, 7, i, i, 50, 0 if i < 5000 else i) for i in range(5003)], "slot int, band long, id long, s long, n long, label long")
    regs = named.select("s", F.lit(b"x").alias("regs"))
    rows, _ = near_dup._mixed_blocks(named, regs)
    assert rows.where("label = 0").count() == 5000 and rows.count() <= 5000 + 3 * (1 + 10)


def test_keep_first_with_odd_columns(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "other words that are here now", "z"), (3, "and a second text of this id", "q"), (None, "a b c d e f", "n"), (4, None, "w"), (3, "and a second text of this id", "q")]
    docs = spark.createDataFrame([(d, t, m, 1, 2, "s", "u") for d, t, m in rows], "doc_id long, text string, _place string, kept int, label int, s string, row string")
    got = near_dup.keep_first(docs, 5)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, "a b c d e f"), (1, "a b c d e f"), (3, "and a second text of this id"), (4, "")]


def test_estimate_is_unbiased():
    rng = np.random.default_rng(0)
    for j in (0.3, 0.6, 0.8, 0.95):
        n = 900
        both = int(2 * n * j / (1 + j))
        e = []
        for _ in range(40):
            x = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = np.sort(x[:n]), np.sort(np.concatenate([x[:both], x[n : 2 * n - both]]))
            r = near_dup.registers(np.concatenate([a, b]), np.array([0, n, 2 * n]))
            e.append(near_dup.estimate(r[:1], r[1:], np.array([n]), np.array([n]))[0])
        assert abs(np.mean(e) - j) < 0.02 and np.std(e) < 0.06


def test_sketches_merge():
    a = distinct(*shingles(*word_hashes(texts(pa.array(["one two three four five six", "five six seven eight nine ten", "one two three four five six seven eight nine ten"]))), 1))
    r = near_dup.registers(*a)
    assert (np.maximum(r[0], r[1]) == r[2]).all()


def test_small_table_agrees(spark):
    docs = table(spark, SF, "documents")
    assert got_groups(near_dup.near_groups(docs, 5)) == brute_groups([tuple(r) for r in docs.select("doc_id", "text").collect()], 5, 80)
