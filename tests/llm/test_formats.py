"""Packing, token files, WARC, chat and LZ fingerprints against brute force."""

import base64
import hashlib
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.llm import chat, lz, packing, token_files, warc
from tabulon.llm.kernels import texts
from tabulon.llm.tokens import public_path, tokenizer
from tabulon.session import scratch, table
from tests.conftest import SF

VOCABULARY = public_path("word_bpe_49k.json")
ODD = ["", None, "a", "  ", "<|endoftext|> x<|ENDOFTEXT|>", "it's we'LL", "Ünḯ ẞ İstanbul ΑΣ", "x1y2 z\x1cq", "漢字 🙂🙂", "word " * 9000, "a", "same same", "same same"]
DOCS = "doc_id long, text string, seq string, length int, doc string"


def odd_docs(spark):
    return spark.createDataFrame([(i * 3 if i != 4 else None, t, "s", 1, "d") for i, t in enumerate(ODD)], DOCS)


def plain_ids(text):
    return tokenizer(VOCABULARY).tok.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_chunk_tokenizer_equals_library(many):
    many = [t.encode("utf-8", "ignore").decode() for t in many]
    ids, off = tokenizer(VOCABULARY).encode(texts(pa.array(many, pa.string())))
    assert [ids[off[i] : off[i + 1]].tolist() for i in range(len(many))] == [plain_ids(t) for t in many]


def check_packing(docs, out):
    want = {}
    for d in docs.collect():
        ids = plain_ids(d.text) + [1]
        for p in range(0, len(ids), 4096):
            want.setdefault((d.doc_id, p // 4096, p, len(ids[p : p + 4096]), crc(ids[p : p + 4096])), []).append(1)
    got = out.toPandas()
    assert sorted((k for k, v in want.items() for _ in v), key=str) == sorted(((None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()), key=str)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 4096
    return got


def test_packing(spark):
    docs = table(spark, SF, "documents")
    got = check_packing(docs, packing.pack_documents(docs, VOCABULARY))
    assert got.sequence_id.nunique() == math.ceil(got.length.sum() / 4096)


def test_packing_odd(spark):
    check_packing(odd_docs(spark), packing.pack_documents(odd_docs(spark), VOCABULARY))
    assert packing.pack_documents(odd_docs(spark).where("false"), VOCABULARY).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), min_size=1, max_size=20))
def test_packing_plan_places_every_length_once(histogram):
    runs, n, bound = packing.packing_plan(histogram, 64)
    loads = {}
    for length, first, count, seq, k, _ in runs.tolist():
        for i in range(count):
            loads[seq + i // k] = loads.get(seq + i // k, 0) + length
    assert max(loads.values()) <= 64 and len(loads) == n
    for length, count in histogram.items():
        spans = sorted((f, f + c) for m, f, c, *_ in runs.tolist() if m == length)
        assert [0, *(b for _, b in spans)] == [*(a for a, _ in spans), count]
    assert bound <= n + 1e-6 and n <= 1.25 * bound + 2


def fewest(lengths, size):
    """The least number of sequences, by trying all sets of pieces."""
    n = len(lengths)
    whole = [sum(x for i, x in enumerate(lengths) if m >> i & 1) <= size for m in range(1 << n)]
    least = [0] + [n] * ((1 << n) - 1)
    for m in range(1, 1 << n):
        s = m
        while s:
            if whole[s]:
                least[m] = min(least[m], least[m & ~s] + 1)
            s = s - 1 & m
    return least[-1]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=8))
def test_packing_plan_against_all_packings(lengths):
    _, n, bound = packing.packing_plan({x: lengths.count(x) for x in lengths}, 40)
    least = fewest(lengths, 40)
    assert math.ceil(bound - 1e-6) <= least <= n <= least + 1


def test_packing_program_by_known_optima():
    assert packing.packing_plan({10: 100_000}, 4096)[1] == 245  # 409 a sequence
    assert packing.packing_plan({2100: 1000, 1500: 600, 1000: 900}, 4096)[1:] == (1125, pytest.approx(1125, abs=0.1))
    assert packing.packing_plan({4096: 7, 4095: 3, 1: 3}, 4096)[1] == 10
    rng = np.random.default_rng(1)
    many = {int(x): int(rng.integers(1, 50)) for x in rng.integers(1, 1500, 400)}
    assert packing.packing_plan(many, 4096)[1] == math.ceil(sum(a * b for a, b in many.items()) / 4096)


@pytest.mark.parametrize("odd", [False, True])
def test_token_files(spark, odd):
    docs = odd_docs(spark) if odd else table(spark, SF, "documents")
    got = token_files.token_file_digest(spark, docs, VOCABULARY).toPandas()
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id))
    assert len(got) == len(rows)
    got = got.sort_values("start", kind="stable")
    at = 0
    for r, d in zip(got.itertuples(), rows, strict=True):
        ids = plain_ids(d.text) + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_token_file_random_access(spark):
    docs = table(spark, SF, "documents").limit(40)
    m = token_files.write_token_files(docs, scratch(spark, "t"), VOCABULARY, 2, seq_len=128, batch_rows=3, tasks=1).collect()
    f = token_files.TokenFile(m[0].path)
    flat = np.concatenate([*f.tokens()])
    assert len(m) == 1 and len(flat) == m[0].n_tokens and len(f) == -(-len(flat) // 128)
    for i in (0, 4, len(f) - 1):
        ids, mask = f[i]
        assert ids[: int(mask.sum())].tolist() == flat[i * 128 : (i + 1) * 128].tolist()
    assert token_files.token_file_digest(spark, docs.where("false"), VOCABULARY).count() == 0


def test_token_files_of_several_tasks(spark):
    docs = table(spark, SF, "documents")
    m = token_files.write_token_files(docs, scratch(spark, "t"), VOCABULARY, 2, seq_len=64, batch_rows=2, tasks=3, shard_tokens=1000)
    rows = m.collect()
    assert len({r.task for r in rows}) == 3 and len({r.path for r in rows}) == len(rows) >= 3
    want = {tuple(r) for r in token_files.token_file_digest(spark, docs, VOCABULARY).collect()}
    assert {tuple(r) for r in token_files.read_token_files(spark, m).collect()} == want


def test_token_files_roll(tmp_path, monkeypatch):
    import pyspark

    many = [f"text {i} " * (i % 40) for i in range(300)] + ["long " * 3000]
    given = [pa.record_batch([pa.array(range(k, min(k + 7, 301)), pa.int64()), pa.array(many[k : k + 7])], names=["doc_id", "text"]) for k in range(0, 301, 7)]
    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})()))
    rows = [r for b in token_files._write(iter(given), VOCABULARY, str(tmp_path), 2, 16, 2, 500) for r in b.to_pylist()]
    assert len(rows) > 10 and sum(r["n_docs"] for r in rows) == 301
    ids = [plain_ids(t) + [2] for t in many]
    at = 0
    for r in rows:
        index = token_files.read_index(r["path"])
        end = (index["start"].to_numpy() + index["n_tokens"].to_numpy()).tolist()
        assert end[-1] == r["n_tokens"] and r["n_tokens"] - len(ids[at + len(end) - 1]) < 500 + 7 * 130
        assert token_files.document_crcs(r["path"], np.array(end)).tolist() == [crc(x) for x in ids[at : at + len(end)]]
        at += len(end)


def test_warc(spark):
    rows = [(5, "u", "x"), (7, None, "x"), (7, "u", "y"), (1, "a\r\nb", None), (2, "u", ""), (9, "u", "é" * 3000), (9, "u", "é" * 3000), (None, "u", "x"), (3, "u", "lone")]
    pages = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, digest string, kind int")
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_round_trip(spark, pages).collect())
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        most = max((q for q, _, g in rows if (g or "") == (h or "") and q is not None), default=None)
        again = most is not None and p != most
        want.append((p or -1, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", most if again else None))
    assert got == sorted(want)
    assert warc.warc_round_trip(spark, pages.where("false")).count() == 0


def test_warc_rolls_and_is_deterministic(spark):
    pages = table(spark, SF, "pages")
    runs = []
    for _ in range(2):
        m = warc.write_warc(pages, scratch(spark, "w"), roll_bytes=20_000, shards=2).orderBy("shard", "file").collect()
        runs.append([hashlib.sha1(open(r.path.removeprefix("file://"), "rb").read()).hexdigest() for r in m])
        assert len(m) > 4 and all(r.n_bytes <= 20_000 or r.n_records == 1 for r in m) and sum(r.n_records for r in m) == pages.count()
    assert runs[0] == runs[1]


TALKS = [
    (1, 0, "system", "be"), (1, 1, "user", "a</s>\n<s>user<|>b"), (1, 2, "assistant", r"c\<|\\[INST]"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "tail\n"),
    (2, 0, "user", "only"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, 0, None, "n"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (8, 1, "assistant", "語" * 5000),
]


def digest(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
    loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("odd", [False, True])
def test_chat(spark, odd):
    turns = spark.createDataFrame([(*r, "e") for r in TALKS], "conv_id long, turn long, role string, text string, turns string") if odd else table(spark, SF, "conversations")
    groups = {}
    for r in sorted(turns.select("conv_id", "turn", "role", "text").collect(), key=lambda r: (r.turn, r.role or "", r.text or "")):
        groups.setdefault(r.conv_id, []).append(tuple(r))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.conversation_digest(chat.format_conversations(turns)).collect()}
    assert got == {k: digest(v) for k, v in groups.items()}
    assert chat.format_conversations(turns.where("false")).count() == 0


def test_chat_examples(spark):
    turns = spark.createDataFrame(TALKS[:6], "conv_id long, turn long, role string, text string")
    e = [r.asDict() for r in chat.format_conversations(turns).orderBy("example").collect()]
    assert [x["formatted"][x["loss_start"] : x["loss_start"] + x["loss_chars"]] for x in e] == [r"c\\<\|\\\\[\INST]", "", ""]
    assert e[0]["formatted"] == "<s>system<|>be</s>\n<s>user<|>a<\\/s>\n<\\s>user<\\|>b</s>\n<s>assistant<|>" + r"c\\<\|\\\\[\INST]" + "</s>\n"
    assert all(b["formatted"].startswith(a["formatted"]) for a, b in zip(e, e[1:], strict=False))


def brute_phrases(text):
    """LZ78 by a trie."""
    trie, out, node, w = {}, set(), None, ""
    node = trie
    for c in text:
        w += c
        if c in node:
            node = node[c]
        else:
            node[c] = {}
            out.add(w)
            node, w = trie, ""
    return out


def brute_fingerprint(text):
    """Minimum hashes with Python's numbers, place by place."""
    hashes = [int(lz.span_hashes(np.frombuffer(p.encode(), np.uint8), np.array([0]), np.array([len(p.encode())]), lower=False)[0]) >> 32 for p in brute_phrases(text)]
    out = ""
    for a, b in zip(lz._A.tolist(), lz._B.tolist(), strict=True):
        least = None
        for h in hashes:
            x = h * a % 2**32
            x ^= x >> 15
            x = x * 0x2C1B3C6D % 2**32 ^ b
            least = x if least is None else min(least, x)
        out += "0000" if least is None else f"{(least ^ least >> 16) % 2**16 | 1:04x}"
    return out


@pytest.mark.parametrize("odd", [False, True])
def test_lz(spark, odd):
    docs = odd_docs(spark) if odd else table(spark, SF, "documents").where("doc_id < 60")
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or ""))
    ids, many = [r.doc_id for r in rows], [r.text or "" for r in rows]
    got = sorted(lz.neighbours(docs).collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)
    assert [r.doc_id for r in got] == ids
    for i, r in enumerate(got):
        nxt = many[(i + 1) % len(many)]
        e = many[i][: len(many[i]) - len(many[i]) // 2] + nxt[: len(many[i]) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(many[i]), hashlib.sha256(e.encode()).hexdigest())
        own, other, following = (brute_fingerprint(t) for t in (many[i], e, nxt))
        assert (r.fingerprint, r.edited_fingerprint) == (own, other)
        same = lambda x, y: sum(x[k : k + 4] == y[k : k + 4] for k in range(0, len(x), 4)) / lz.PLACES
        assert (r.near_edited, r.near_next) == (same(own, other), same(own, following))
    if not odd:
        assert sum(r.near_edited > r.near_next for r in got) > 0.9 * sum(r.n_chars > 200 for r in got)
    assert lz.neighbours(docs.where("false")).count() == 0


def test_lz_estimates_the_overlap_of_phrases():
    rows = pd.read_parquet(f"{SF}/documents.parquet").text[:60].tolist()
    sets = [lz.phrases(t) for t in rows]
    s = lz.signatures(sets)
    off = [abs(lz.likeness(s[i], s[i + 1]) - len(sets[i] & sets[i + 1]) / max(1, len(sets[i] | sets[i + 1]))) for i in range(0, 58, 2)]
    assert max(off) < 0.25 and sum(off) / len(off) < 0.06
    assert lz.phrases("alpha alpha") == brute_phrases("alpha alpha") == {"a", "l", "p", "h", "a ", "al", "ph"}
    same = lz.signatures([lz.phrases(rows[0]), lz.phrases(rows[0])])
    assert (same[0] == same[1]).all()
