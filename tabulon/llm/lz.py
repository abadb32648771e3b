"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into phrases as LZ78 does, character by character, white space included: the longest phrase seen before
and one character more make a new phrase; what is left at the end is a known phrase or nothing. The set of phrases is
hashed and summarised by 64 minimum hashes of 16 bits, the fingerprint; the share of equal places estimates the overlap of two dictionaries, which is large where one
text would compress well with the other's dictionary.

`neighbours` compares each text with an edited copy (its last half replaced by the head of the next text) and with the
next text by id; a text and its edited copy are parsed together as far as they are the same. Texts are range-sorted once; each task sees its range in order, and only the last text of a range and
the first of the next meet afterwards, in a join of as many rows as there are ranges.

Cases: null and empty texts have no phrase and one fingerprint, alike to each other (likeness 1) and to nothing else
(0); very long texts are parsed whole; repeated rows follow each other, rows of one id by their text; null ids sort first; one row alone is its own
next text; an empty table gives no rows; columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.kernels import buffers, seeds, segment_min, slices, span_hashes, texts
from tabulon.session import shuffle_partitions, small_batches, written

PLACES = 64
_A = (seeds(PLACES, 3) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (seeds(PLACES, 4) >> np.uint64(32)).astype(np.uint32)


def _parse(text: str, found: set[str], held: str) -> str:
    """Adds the phrases of the text, which follows the unfinished phrase `held`; gives the one unfinished at its end."""
    add, w = found.add, held
    for c in text:
        w += c
        if w not in found:
            add(w)
            w = ""
    return w


def phrases(text: str) -> set[str]:
    """The LZ78 phrases of the text."""
    found: set[str] = set()
    _parse(text, found, "")
    return found


def both_phrases(text: str, kept: int, tail: str) -> tuple[set[str], set[str]]:
    """The phrases of the text, and of its first `kept` characters followed by `tail`."""
    own: set[str] = set()
    held = _parse(text[:kept], own, "")
    other = set(own)
    _parse(tail, other, held)
    _parse(text[kept:], own, held)
    return own, other


def signatures(many: list[set[str]]) -> np.ndarray:
    """A row of PLACES minimum hashes (16 bits) for each set of phrases; empty sets have zeros, others none."""
    flat: list[str] = []
    off = [0]
    for found in many:
        flat += found
        off.append(len(flat))
    data, at = buffers(pa.array(flat, pa.large_string()))
    h = (span_hashes(data, at[:-1], at[1:], lower=False) >> np.uint64(32)).astype(np.uint32)
    off = np.array(off)
    out = np.zeros((len(many), PLACES), np.uint16)
    for i in range(PLACES):
        x = h * _A[i]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= _B[i]
        least = segment_min(x, off, 0)
        out[:, i] = np.where(off[1:] > off[:-1], (least ^ least >> np.uint32(16)).astype(np.uint16) | 1, 0)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_DONE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _rows(ids: list, many: list[str], following: str) -> pa.RecordBatch:
    """The finished rows of texts that follow each other, the last of them followed by `following`."""
    nexts = [*many[1:], following]
    changed = [edited(a, b) for a, b in zip(many, nexts, strict=True)]
    pairs = [both_phrases(t, len(t) - len(t) // 2, e[len(t) - len(t) // 2 :]) for t, e in zip(many, changed, strict=True)]
    own, other = signatures([p for p, _ in pairs] + [phrases(following)]), signatures([q for _, q in pairs])
    n = len(many)
    hexes = lambda s: [x.tobytes().hex() for x in s.astype(">u2")]
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(t) for t in many], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(hexes(own[:n])), pa.array(hexes(other)), pa.array(likeness(own[:n], other)), pa.array(likeness(own[:n], own[1:]))], schema=_SCHEMA)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished rows (kind 0), the last row of the range, which waits for the next range (1), and the first row (2)."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    schema = _SCHEMA.append(pa.field("part", pa.int32())).append(pa.field("kind", pa.int32())).append(pa.field("text", pa.string()))

    def marked(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.num_rows
        return pa.record_batch([*b.columns, pa.array([part] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.string())], schema=schema)

    def edge(kind: int, doc_id, text: str) -> pa.RecordBatch:
        return pa.record_batch([pa.array([doc_id], pa.int64()), *(pa.nulls(1, t) for t in _SCHEMA.types[1:]), pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([text], pa.string())], schema=schema)

    ids, many = [], []
    begun = False
    for b in slices(batches, most=2 << 20):
        new_ids, new = b.column(0).to_pylist(), texts(b.column(1)).to_pylist()
        if not begun:
            begun = True
            yield edge(2, new_ids[0], new[0])
        ids, many = ids + new_ids, many + new
        if len(many) > 1:
            yield marked(_rows(ids[:-1], many[:-1], many[-1]))
            ids, many = ids[-1:], many[-1:]
    if begun:
        yield edge(1, ids[0], many[0])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for doc_id, text, following in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield _rows([doc_id], [text or ""], following or "")


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and its edited copy, and their likeness; see the module's text."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    ranged = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    rows = written(ranged.mapInArrow(_ranges, _DONE + ", part int, kind int, text string"), "lz-ranges")
    parts = sorted(r[0] for r in rows.where("kind = 2").select("part").collect())
    links = spark.createDataFrame([(p, q) for p, q in zip(parts, parts[1:] + parts[:1], strict=True)], "part int, following int")
    waiting = rows.where("kind = 1").select("doc_id", "text", "part")
    first = rows.where("kind = 2").select(F.col("part").alias("following"), F.col("text").alias("head"))
    ends = waiting.join(links, "part").join(first, "following").select("doc_id", "text", "head").mapInArrow(_finish, _DONE)
    return rows.where("kind = 0").select(*_SCHEMA.names).unionByName(ends)
