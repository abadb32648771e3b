"""Best-fit packing of token pieces into sequences of a fixed size.

The lengths' histogram (at most `size` rows, so bounded) goes to the driver. There the configuration linear program
(fewest sequences, each filled by a configuration of lengths, every length served as often as it occurs) is solved by
multiplicative weights: lengths carry prices, knapsack dynamic programming finds the configuration of the highest price,
and served lengths get cheaper by a factor exponential in the served share. Prices over that configuration's price are
dual values and give a lower bound. Rounding takes whole sequences of priced configurations until every count is served;
nothing is left for another method. The plan is a list of runs (length, first rank, count, sequence, offset) whose number
doesn't grow with the documents; each piece finds its place by its rank in its length.

Ranks come without a global sort: pieces are salted by a hash into as many parts as there are shuffle partitions, a
part's base is the sum of the earlier parts' counts, and row_number runs within (length, part). A length that a third
of all pieces share is thus spread over all parts.

Cases: null and empty texts are pieces of the end id alone; very long texts are encoded whole and cut into pieces;
repeated rows are packed each, and rows alike in everything take places of equal pieces; an empty table gives an empty
result; columns other than the two named are not read; null ids are kept as null.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tabulon.llm.kernels import slices, texts
from tabulon.llm.tokens import crc32_ids, tokenizer, with_end
from tabulon.session import shuffle_partitions, small_batches, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(batches: Iterator[pa.RecordBatch], path: str, end: int, size: int) -> Iterator[pa.RecordBatch]:
    tk = tokenizer(path)
    for b in slices(batches):
        ids, off = with_end(*tk.encode(texts(b.column(1))), end)
        n = np.diff(off)
        pieces = (n + size - 1) // size
        doc = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * size
        length = np.minimum(n[doc] - start, size)
        at = off[doc] + start
        crc = [crc32_ids(ids[a : a + k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
        yield pa.record_batch([b.column(0).cast(pa.int64()).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents' ids with the end id, cut into pieces of `size` where longer; start: the document's ids before the piece."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(partial(_cut, path=vocabulary, end=end_id, size=size), PIECES)


def _price_out(lengths: np.ndarray, left: np.ndarray, price: np.ndarray, size: int) -> tuple[dict[int, int], float]:
    """Knapsack pricing by dynamic programming: the configuration {index: times} of the highest price within the size that takes no length more often than is left, and that price. Times are binary splits of what is left and fits; of equal prices the one with the earlier lengths wins."""
    best = np.zeros(size + 1)
    took: list[tuple[int, int, np.ndarray]] = []
    for i, (n, most) in enumerate(zip(lengths.tolist(), np.minimum(left, size // lengths).tolist(), strict=True)):
        k = 1
        while most > 0:
            k = min(k, most)
            w = n * k
            with_it = best[: size + 1 - w] + price[i] * k
            better = with_it > best[w:] + 1e-12
            np.copyto(best[w:], with_it, where=better)
            took.append((i, k, better))
            most -= k
            k *= 2
    out: dict[int, int] = defaultdict(int)
    room = size
    for i, k, better in reversed(took):
        w = int(lengths[i]) * k
        if room >= w and better[room - w]:
            out[i] += k
            room -= w
    return out, float(best[-1])


def dual_prices(lengths: np.ndarray, counts: np.ndarray, size: int, work: int = 200_000) -> tuple[np.ndarray, float]:
    """(prices, bound): prices of the lengths, at most 1 for any configuration, whose total over all counts, the program's dual value, is the largest found; no packing undercuts it.

    Multiplicative weights, starting at the shares of a sequence: the best configuration by the prices is used as often as
    its scarcest length occurs, and each of its lengths gets cheaper exponentially in the share of its count that this
    serves, at a falling rate. Ends as soon as the bound rounds to what volume needs at least, and after `work` knapsack items."""
    price, best, bound = lengths / size, lengths / size, 0.0
    for t in range(max(8, min(2000, work // max(1, len(lengths))))):
        config, value = _price_out(lengths, counts, price, size)
        if counts @ price / value > bound:
            bound, best = float(counts @ price / value), price / value
        i, k = (np.array(x) for x in zip(*config.items(), strict=True))
        price = price / value
        price[i] *= np.exp(-0.5 / np.sqrt(1 + t / 4) * k / counts[i] * (counts[i] / k).min())
    return best, bound


def configuration_program(lengths: np.ndarray, counts: np.ndarray, size: int, prices: np.ndarray, rate: float, longest: bool, steps: int = 256, partial_of: int = 64) -> list[tuple[int, dict[int, int]]]:
    """The rounded program [(sequences, {index of a length: times})], which serves every count exactly.

    A round lowers each length's price by a weight that falls exponentially (by `rate`) with the share of its count that is
    served, and takes the configuration of the highest price (`longest`: among those with the longest length left, the
    hardest to place late; lengths come longest first) `total / steps` times, or as often as its scarcest length lasts. Steps are rounded down to whole sequences, so no count is overdrawn and no fraction is left over; rounds go on
    until all counts are served. A round prices a part of the columns: the `partial_of` lengths of the highest prices for
    their size (of equal ones the longest) and as many drawn ones."""
    rng = np.random.default_rng(len(lengths))
    left = counts.astype(np.int64).copy()
    most = max(1, int((lengths * counts).sum() / size / steps))
    prices = np.maximum(prices, 1e-6 * lengths / size)  # what has no price is served, too
    plan: list[tuple[int, dict[int, int]]] = []
    while left.any():
        active = np.flatnonzero(left)
        # longer lengths win ties by a hair: they are the hardest to place late
        price = prices * np.exp(-rate * (1 - left / counts)) * (1 + 1e-6 * lengths / size)
        order = active[np.lexsort((-lengths[active], -(price / lengths * size)[active].round(5)))]
        if len(order) > 2 * partial_of:
            order = np.concatenate([order[:partial_of], rng.choice(order[partial_of:], partial_of, replace=False)])
        order = order[np.argsort(-lengths[order], kind="stable")]
        first = int(active[0]) if longest else -1
        config, _ = _price_out(lengths[order], left[order] - (order == first), price[order], size - (int(lengths[first]) if longest else 0))
        config = {int(order[i]): k for i, k in config.items()}
        if longest:
            config[first] = config.get(first, 0) + 1
        times = min([most, *(int(left[i]) // k for i, k in config.items())])
        for i, k in config.items():
            left[i] -= k * times
        plan.append((times, config))
    return plan


def packing_plan(histogram: dict[int, int], size: int, gap: float = 2e-5) -> tuple[np.ndarray, int, float]:
    """Runs (length, first rank, count, first sequence, times a sequence, offset) for all pieces by length and rank, the sequences used, and the program's lower bound.

    The program is rounded with the shares of a sequence as prices; if that takes more sequences than the dual bound asks
    for (by more than the share `gap`), again with learned prices at rising rates, until one meets the bound. The plan with
    the fewest sequences counts."""
    lengths = np.array(sorted(histogram, reverse=True), np.int64)
    counts = np.array([histogram[int(n)] for n in lengths], np.int64)
    short = lengths < size  # whole sequences are configurations of their own
    n, c = lengths[short], counts[short]
    best: list[tuple[int, dict[int, int]]] | None = None
    bound = float((n * c).sum()) / size
    share, learned = n / size, None
    for rate, longest in ((None, False), (None, True), (0.0, False), (0.0, True), (0.05, False), (0.5, False), (0.5, True), (2.0, False)) if len(n) else ():
        if best is not None and sum(t for t, _ in best) <= np.ceil(bound * (1 + gap) - 1e-6):
            break
        if rate is not None and learned is None:
            learned, dual = dual_prices(n, c, size)
            bound = max(bound, dual)
        plan = configuration_program(n, c, size, share if rate is None else learned, rate or 0.0, longest)
        best = plan if best is None else min(best, plan, key=lambda p: sum(t for t, _ in p))
    runs: list[tuple[int, int, int, int, int, int]] = []
    used = np.zeros(len(lengths), np.int64)
    sequences, skip = 0, int((~short).sum())
    for times, config in [(m, {k - skip: 1}) for k, m in enumerate(counts[~short].tolist())] + (best or []):
        at = 0
        for i, k in config.items():
            j = i + skip
            runs.append((int(lengths[j]), int(used[j]), times * k, sequences, k, at))
            used[j] += times * k
            at += k * int(lengths[j])
        sequences += times
    return np.array(sorted(runs), np.int64).reshape(-1, 6), sequences, bound + float(counts[~short].sum())


def _place(batches: Iterator[pa.RecordBatch], runs: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = runs[:, 0] << 44 | runs[:, 1]
    for b in batches:
        length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
        r = runs[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
        i = rank - r[:, 1]
        yield pa.record_batch([*b.columns[:5], pa.array(r[:, 3] + i // r[:, 4]), pa.array(r[:, 5] + i % r[:, 4] * length)], names=[*b.schema.names[:5], "sequence_id", "offset"])


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to token_pieces' rows."""
    pieces = written(pieces, "pieces")
    parts = shuffle_partitions(pieces.sparkSession)
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    count = written(salted.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {int(n): int(k) for n, k in count.groupBy("length").agg(F.sum("n")).collect()}
    runs, _, _ = packing_plan(histogram, size)
    before = W.Window.partitionBy("length").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    base = count.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = F.row_number().over(W.Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("local", local).join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(partial(_place, runs=runs), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents' token pieces, each with its sequence and its offset there."""
    return pack(token_pieces(docs, vocabulary, size, end_id, doc_id, text), size)
