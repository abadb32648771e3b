"""The stages in a row, each against brute force over what it was given."""

import corpus_pipeline
from tabulon.llm import toxicity
from tabulon.llm.near_dup import near_groups
from tabulon.llm.substring import repeats
from tabulon.session import table, written
from tests.conftest import SF
from tests.llm.test_formats import check_packing
from tests.llm.test_search import brute_groups, got_groups
from tests.llm.test_substring import check, words


def test_stages(spark):
    docs = table(spark, SF, "documents")
    given = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given[name] = docs
        out = written(stage(spark, docs, SF), "test-stage")
        assert out.dtypes == docs.dtypes and 0.6 * docs.count() < out.count() <= docs.count()
        given[name, "out"] = docs = out
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    d = given["toxicity"]
    model = toxicity.fit(d, table(spark, SF, "labels"))
    lang = {r.doc_id: r.lang for r in d.collect()}
    clean = {r.doc_id for r in toxicity.score(d, model).collect() if r.score < model.thresholds.get(lang[r.doc_id], 0.5)}
    assert ids(given["toxicity", "out"]) == clean

    d = given["near_dedup"]
    want = brute_groups([tuple(r) for r in d.select("doc_id", "text").collect()], 5, 80)
    assert got_groups(near_groups(d, 5)) == want
    assert ids(given["near_dedup", "out"]) == {c for _, _, c in want}

    d = given["substring_dedup"]
    cut = {}
    for r in check(d, repeats(d)):
        cut.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    left = {r.doc_id: [w for i, w in enumerate(words(r.text)) if i not in cut.get(r.doc_id, ())] for r in d.collect()}
    out = {r.doc_id: r for r in given["substring_dedup", "out"].collect()}
    assert {k: words(r.text) for k, r in out.items()} == {k: v for k, v in left.items() if v or k not in cut}
    assert all(r.n_chars == len(r.text) for r in out.values())

    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    assert ids(given["decontamination", "out"]) == {r.doc_id for r in given["decontamination"].collect() if not any(t in r.text for t in items)}

    check_packing(docs, corpus_pipeline.STAGES[-1][1](spark, docs, SF))


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (None, "a b c", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, kept, SF), "test-stage")
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3]
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
        assert none.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
