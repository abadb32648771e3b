"""Token-ID output: Arrow files of fixed-size-list batches, with random access to equal-length sequences and masks.

Texts are range-sorted by id, each task encodes its range and writes shards: `ids` (fixed-size lists of `seq_len` ids, the
stream of all its documents with an end id after each) and `mask` (true: an id, false: padding after the last). A shard
is closed as soon as it holds `shard_tokens` ids or `SHARD_DOCS` documents, so its size doesn't follow the table or the
number of tasks. A second Arrow file holds the shard's index (doc_id, start within the shard, n_tokens). Shards are
committed under temporary names; a manifest row for each follows. Opening a shard maps it; sequence i is a slice of the
file, and reading goes batch by batch.

Cases: null and empty texts are documents of the end id alone; very long texts are encoded whole and lie in one shard;
repeated rows are documents of their own, next to each other; rows of one id are in the order of their texts; null ids
sort first; an empty table gives no shard; columns other than the two named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tabulon.llm.kernels import slices, texts
from tabulon.llm.shards import commit, open_file
from tabulon.llm.tokens import tokenizer, with_end
from tabulon.session import scratch, shuffle_partitions, small_batches, written

MANIFEST = "task int, shard int, path string, n_docs long, n_tokens long"
SHARD_DOCS = 1 << 20
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _write(batches: Iterator[pa.RecordBatch], path: str, out: str, end: int, seq_len: int, rows: int, most: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    tk = tokenizer(path)
    schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(tk.dtype), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
    encoded = ((b.column(0).cast(pa.int64()), *with_end(*tk.encode(texts(b.column(1))), end)) for b in slices(batches))
    waiting = next(encoded, None)
    index: list[pa.RecordBatch] = []

    def batch(ids: np.ndarray) -> pa.RecordBatch:
        pad = -len(ids) % seq_len
        mask = np.ones(len(ids) + pad, bool)
        mask[len(ids) :] = False
        ids = np.concatenate([ids, np.zeros(pad, ids.dtype)])
        return pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), seq_len) for x in (ids, mask)], schema=schema)

    def write(stream) -> None:
        """What waits and all that follows, up to the size of a shard."""
        nonlocal waiting
        held, total, docs = np.zeros(0, tk.dtype), 0, 0
        with pa.ipc.new_file(stream, schema) as f:
            while waiting and total < most and docs < SHARD_DOCS:
                doc, ids, off = waiting
                index.append(pa.record_batch([doc, pa.array(total + off[:-1]), pa.array(np.diff(off))], schema=INDEX))
                total, docs = total + len(ids), docs + len(doc)
                held = np.concatenate([held, ids])
                whole = len(held) // (rows * seq_len) * rows * seq_len
                for at in range(0, whole, rows * seq_len):
                    f.write_batch(batch(held[at : at + rows * seq_len]))
                held = held[whole:]
                waiting = next(encoded, None)
            if len(held):
                f.write_batch(batch(held))

    def write_index(stream) -> None:
        with pa.ipc.new_file(stream, INDEX) as f:
            for b in index:
                f.write_batch(b)

    shard = 0
    while waiting:
        to = f"{out}/shard-{task:05d}-{shard:05d}.arrow"
        index.clear()
        commit(to, write)
        commit(f"{to}.index", write_index)
        yield pa.record_batch([pa.array([task], pa.int32()), pa.array([shard], pa.int32()), pa.array([to]), pa.array([sum(b.num_rows for b in index)], pa.int64()), pa.array([int(index[-1][1][-1].as_py() + index[-1][2][-1].as_py())], pa.int64())], names=["task", "shard", "path", "n_docs", "n_tokens"])
        shard += 1


def write_token_files(docs: DataFrame, out: str, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text", seq_len: int = 2048, batch_rows: int = 64, tasks: int | None = None, shard_tokens: int = 1 << 24) -> DataFrame:
    """Writes the shards and returns their manifest (task, shard, path, n_docs, n_tokens), itself written beside them."""
    small_batches(docs.sparkSession)
    n = tasks or shuffle_partitions(docs.sparkSession)
    ranged = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(ranged.mapInArrow(partial(_write, path=vocabulary, out=out, end=end_id, seq_len=seq_len, rows=batch_rows, most=shard_tokens), MANIFEST), "token-manifest")


class TokenFile:
    """A shard, mapped: sequence i and its mask are views of the file."""

    def __init__(self, path: str):
        self.reader = pa.ipc.open_file(open_file(path))
        n = self.reader.num_record_batches
        # all batches but the last have the same number of sequences
        self.rows = self.reader.get_batch(0).num_rows if n else 0
        self.sequences = (n - 1) * self.rows + self.reader.get_batch(n - 1).num_rows if n else 0

    def __len__(self) -> int:
        return self.sequences

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        b = self.reader.get_batch(i // self.rows)
        return tuple(c.values.slice((c.offset + i % self.rows) * c.type.list_size, c.type.list_size).to_numpy(zero_copy_only=j == 0) for j, c in enumerate(b.columns))

    def tokens(self) -> Iterator[np.ndarray]:
        """The ids of each batch, without padding."""
        for i in range(self.reader.num_record_batches):
            b = self.reader.get_batch(i)
            n = int(np.count_nonzero(b.column(1).flatten().to_numpy(zero_copy_only=False)))
            yield b.column(0).flatten().to_numpy()[:n]


def read_index(path: str) -> pa.Table:
    return pa.ipc.open_file(open_file(f"{path}.index")).read_all()


def document_crcs(path: str, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of each document's ids, as 32-bit numbers; end: where each ends in the shard's stream. A document may go on in the next batch."""
    out = np.zeros(len(end), np.int64)
    doc, at, crc = 0, 0, 0
    for ids in TokenFile(path).tokens():
        ids = ids.astype("<u4")
        last = int(np.searchsorted(end, at + len(ids), side="right"))  # documents that end in this batch
        begin = at
        for k, e in enumerate(end[doc:last].tolist(), doc):
            out[k] = zlib.crc32(ids[begin - at : e - at].tobytes(), crc)
            begin, crc = e, 0
        crc = zlib.crc32(ids[begin - at :].tobytes(), crc)
        doc, at = last, at + len(ids)
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            index = read_index(path)
            start, n = index["start"].to_numpy(), index["n_tokens"].to_numpy()
            yield pa.record_batch([index["doc_id"].combine_chunks(), pa.array(start + base), pa.array(n), pa.array(document_crcs(path, start + n))], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """A row for each document, from the files: doc_id, start in the whole stream, n_tokens, ids_crc32.

    A task's shards are placed by running sums over the manifest; the driver gets a row for each task of the writer.
    """
    base, bases = 0, []
    for task, n in sorted(tuple(r) for r in manifest.groupBy("task").agg(F.sum("n_tokens")).collect()):
        bases.append((task, base))
        base += n
    before = W.Window.partitionBy("task").orderBy("shard").rowsBetween(W.Window.unboundedPreceding, -1)
    placed = manifest.join(F.broadcast(spark.createDataFrame(bases, "task int, base long")), "task")
    files = placed.select("path", (F.col("base") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).alias("base")).repartition(shuffle_partitions(spark))
    return files.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    return read_token_files(spark, write_token_files(docs, scratch(spark, "token-files"), vocabulary, end_id))
