"""MinHash near-dedup with SetSketch registers.

A document's set is its distinct k-word shingles. Its sketch has M registers: the least of the set's exponential
variates for each register, rounded on an exponential scale and truncated, so sketches merge by the larger register and
equal registers tell of common shingles. BANDS bands of ROWS registers each are the candidate keys; the low bytes of all
M registers serve keys and estimates.

1. Documents with equal sets are one from here on.
2. In each bucket of a band every set is compared with the bucket's least id: pairs are as many as rows, whatever a
   bucket's size. A pair goes on if sizes allow the similarity and the joint likelihood of both sketches puts its estimate
   above the similarity less MARGIN; then the full sets (64-bit hashes) decide.
3. Links make components (least-label propagation with pointer jumping). Buckets that hold several components are
   searched further: rows outside the bucket's largest component are compared with each other and with its rows, in
   blocks of about BLOCK rows or BLOCK_BYTES of sets, and the largest component's rows not among themselves. Sketches tell
   which rows have a likely partner in another component; these rows meet once more, with their full sets, and each
   likely pair of components that are still apart is verified where it is found. Only links leave a block, fewer than
   its rows; no pair is written.

A link is missed only if no band of two sets agrees, 3e-8 at a similarity of 0.8 (BANDS = 44, ROWS = 5), or if
the estimate is off by MARGIN, five standard errors. Two different shingles count as one if their 64-bit hashes agree.

Rows of each step: BANDS for a set, fewer stars, one full set for each set in a shared bucket; in step 3 a bucket of n rows,
r of them outside its largest component, copies these n / BLOCK times and the others r / BLOCK times, so a step grows with
rows unless buckets are large and mixed throughout. Buckets and counts are partial aggregates; a key with more than SPREAD rows (a
pivot, a hub) is dealt by a salt, and only its partner's one row is copied; full sets are built only for candidates.

Cases: texts without words have an empty set, linked with nothing; shorter texts than k words are one shingle; very long
texts are read whole; repeated rows count as equal documents; rows that share an id are one document, linked by each of
their texts (ties don't arise: the least id stands for a component); rows without an id get a size but no component
(null) and are kept; an empty table gives no rows; columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.kernels import binary_rows, distinct, mix, seeds, segment_min, shingles, slices, texts, word_hashes
from tabulon.session import forget, small_batches, written

M, BANDS, ROWS, BASE, RATE = 512, 44, 5, 1.05, 20.0
MARGIN = 0.085
BLOCK, BLOCK_BYTES, SPREAD, SALTS = 512, 4 << 20, 64, 64
_MUL = seeds(M, 21) | np.uint64(1)
_LOG = np.log(BASE)


def registers(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """SetSketch registers of each set of 64-bit hashes, on a scale that puts a set of one element at about 64; sets without an element have zeros."""
    out = np.zeros((len(off) - 1, M), np.uint16)
    full = off[1:] > off[:-1]
    with np.errstate(over="ignore", divide="ignore"):
        for i in range(M):
            h = sets * _MUL[i]
            h ^= h >> np.uint64(32)
            h *= _MUL[i]
            least = segment_min(h, off, 0)
            x = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64) / RATE
            k = np.floor(1 - np.log(np.maximum(x, 1e-300)) / _LOG) + 128
            out[:, i] = np.where(full, np.clip(k, 1, 1023), 0)
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The most likely Jaccard similarity of sets of the known sizes na and nb, from the orders of their registers. Low bytes of registers do: those of sets of like sizes differ by less than 128, so the sign of the byte difference is the order."""
    d = (a.astype(np.uint8) - b.astype(np.uint8)).view(np.int8)
    above, below = (d > 0).sum(axis=-1), (d < 0).sum(axis=-1)
    equal = a.shape[-1] - above - below
    u, v = na / (na + nb), nb / (na + nb)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / _LOG

    def value(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return above * np.log(up) + below * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(14):
        x, y = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        left = value(x) > value(y)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    return (lo + hi) / 2


def _sets(arr: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct(*shingles(*word_hashes(arr), k))


def _marks(sets: np.ndarray, off: np.ndarray) -> pa.Array:
    """128 bits that tell sets apart: two sums of mixed hashes."""
    cum = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(np.stack([mix(sets ^ np.uint64(5)), mix(sets ^ np.uint64(11))], axis=1), axis=0, dtype=np.uint64)])
    with np.errstate(over="ignore"):
        return binary_rows((cum[off[1:]] - cum[off[:-1]]).ravel(), np.arange(len(off)) * 2)


def _sketch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, most=1 << 19):
        sets, off = _sets(texts(b.column(1)), k)
        yield pa.record_batch([b.column(0), pa.array(np.diff(off)), _marks(sets, off), binary_rows(registers(sets, off).astype(np.uint8).ravel(), np.arange(len(off)) * M)], names=["doc_id", "n", "mark", "regs"])


def _full_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The sorted 64-bit hashes of each set."""
    for b in slices(batches, most=1 << 19):
        sets, off = _sets(texts(b.column(1)), k)
        yield pa.record_batch([_marks(sets, off), binary_rows(sets, off)], names=["mark", "set"])


def common(a: bytes, b: bytes) -> int:
    x = np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)])
    x.sort()
    return int((x[1:] == x[:-1]).sum())


def _verify(batches: Iterator[pa.RecordBatch], similarity: int) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, na, nb, set_a, set_b) the links (a, b): those whose sets reach the similarity (in hundredths)."""
    for b in batches:
        na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
        both = np.fromiter((common(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)), np.int64, b.num_rows)
        yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(100 * both >= similarity * (na + nb - both)))


def _likely(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, na, nb, sa, sb, regs_a, regs_b) the pairs whose estimate reaches `least`."""
    for b in batches:
        if b.num_rows:
            ra, rb = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, M) for c in b.columns[6:8])
            yield b.select(["a", "b", "na", "nb", "sa", "sb"]).filter(pa.array(estimate(ra, rb, b.column(2).to_numpy(), b.column(3).to_numpy()) >= least))


def _pairs_of(count: np.ndarray, step: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of each group (sizes `count`, rows in order), about `step` at a time."""
    i_s, j_s, have, at = [], [], 0, 0
    for n in count.tolist():
        for r in range(0, n, 256):
            i, j = np.triu_indices(min(256, n - r), 1, n - r)
            i_s.append(i + at + r)
            j_s.append(j + at + r)
            have += len(i)
            if have >= step:
                yield np.concatenate(i_s), np.concatenate(j_s)
                i_s, j_s, have = [], [], 0
        at += n
    if have:
        yield np.concatenate(i_s), np.concatenate(j_s)


_PAIR = ("a", "b", "na", "nb", "sa", "sb")
PAIR = "a long, b long, na long, nb long, sa long, sb long"


def _across_groups(t: pa.Table, least: float, ratio: float, similarity: int) -> pa.RecordBatch | None:
    """Of rows (band, x, y, i, id, s, n, label, slot, regs[, set]) of whole groups (band, x, y), the likely pairs of different components from both blocks, at the first band that both share. Without sets: the rows (band, s) of such pairs. With sets: links (a, b) of components that no earlier link here joins."""
    band, x, y, block, ids, own, n, comp, slot = (t[c].to_numpy() for c in ("band", "x", "y", "i", "id", "s", "n", "label", "slot"))
    regs = np.frombuffer(b"".join(t["regs"].to_pylist()), np.uint8).reshape(-1, M)
    new = np.ones(len(band), bool)
    new[1:] = (band[1:] != band[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    count = np.diff(np.append(np.flatnonzero(new), len(band)))
    asking = np.zeros(len(band), bool)
    sets = t["set"].to_pylist() if "set" in t.schema.names else None
    top: dict[int, int] = {}
    links: list[tuple[int, int]] = []

    def find(c: int) -> int:
        while (up := top.get(c, c)) != c:
            top[c] = top.get(up, up)
            c = up
        return c

    for i, j in _pairs_of(count):
        keep = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) >= ratio * np.maximum(n[i], n[j])) & ((block[i] != block[j]) | (x[i] == y[i]))
        i, j = i[keep], j[keep]
        same = regs[i] == regs[j]
        first = same[:, : BANDS * ROWS].reshape(len(i), BANDS, ROWS).all(axis=2).argmax(axis=1)
        keep = (same.sum(axis=1) >= M * (least - 0.03)) & (first == slot[i])
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        e = estimate(regs[i], regs[j], n[i], n[j])
        if sets is None:
            asking[i[e >= least]] = asking[j[e >= least]] = True
            continue
        likely = np.flatnonzero(e >= least)
        for k in likely[np.argsort(-e[likely], kind="stable")].tolist():
            p, q = int(i[k]), int(j[k])
            a, b = find(int(comp[p])), find(int(comp[q]))
            if a == b:
                continue
            both = common(sets[p], sets[q])
            if 100 * both >= similarity * (int(n[p]) + int(n[q]) - both):
                top[max(a, b)] = min(a, b)
                links.append((int(ids[p]), int(ids[q])))
    if sets is None:
        return pa.record_batch([pa.array(band[asking]), pa.array(own[asking])], names=["band", "s"]) if asking.any() else None
    return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"]) if links else None


def _across(batches: Iterator[pa.RecordBatch], least: float, ratio: float, similarity: int) -> Iterator[pa.RecordBatch]:
    """Cuts sorted batches at the ends of groups."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(i).to_numpy() for i in range(3)])
        last = int(np.flatnonzero((key != key[:, -1:]).any(axis=0))[-1]) + 1 if (key != key[:, -1:]).any() else 0
        if last or (held and [c[held[-1].num_rows - 1].as_py() for c in held[-1].columns[:3]] != key[:, 0].tolist()):
            out = _across_groups(pa.Table.from_batches([*held, b.slice(0, last)]), least, ratio, similarity)
            held = []
            if out is not None:
                yield out
        held.append(b.slice(last))
    if held:
        out = _across_groups(pa.Table.from_batches(held), least, ratio, similarity)
        if out is not None:
            yield out


def small_or_joined(left: DataFrame, ids: DataFrame, on: str, how: str, bound: int = 200_000) -> DataFrame:
    """A semi or anti join with a table of ids: broadcast if it is counted at `bound` rows or fewer, shuffled otherwise."""
    return left.join(F.broadcast(ids) if ids.count() <= bound else ids, on, how)


def spread_join(left: DataFrame, right: DataFrame, on: str, by: str) -> DataFrame:
    """left joined with right's one row for each key. A key with more than SPREAD rows of left is dealt into parts of about that many by a hash of `by`, and right's row is copied for each part: no task gets all rows of a key, and copies are fewer than left's rows / SPREAD."""
    hot = written(left.groupBy(on).agg(F.count("*").alias("_many")).where(f"_many > {SPREAD}").select(on, F.ceil(F.col("_many") / SPREAD).cast("int").alias("_parts")), "near-hot")
    n = hot.count()
    if not n:
        forget(hot)
        return left.join(right, on)
    few = F.broadcast(hot) if n <= 200_000 else hot
    dealt = left.join(few, on, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    copied = right.join(few, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [on, "_part"]).drop("_part")


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of all ids in edges (a, b): label is the least id of the component. Least labels of neighbours, then labels of labels, until nothing changes.

    Joins go by (key, salt): a hub's label is first copied to the salts that ask for it, SALTS at most, so neither a hub nor the least id of a large component is one task's key."""
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int").alias("salt")
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a")).distinct()
    both = written(both.select("u", "v", salt("u")), "near-edges")
    asked = written(both.select("v", "salt").distinct(), "near-asked")
    labels = written(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("v")).select("id", F.least("id", "v").alias("label")), "near-labels")
    while True:
        told = asked.join(labels.withColumnRenamed("id", "v"), "v")
        near = both.join(told, ["v", "salt"]).groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        step = written(labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"), salt("id")), "near-step")
        jump = step.select("label", "salt").distinct().join(step.select(F.col("id").alias("label"), F.col("label").alias("to")), "label")
        new = written(step.join(jump, ["label", "salt"]).select("id", "was", F.col("to").alias("label")), "near-labels")
        changed = new.where("was <> label").limit(1).count()
        forget(labels, step)
        labels = new.select("id", "label")
        labels._tabulon_path = new._tabulon_path
        if not changed:
            forget(both, asked)
            return labels


def _mixed_blocks(named: DataFrame, data: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (band, x, y, i, id, s, n, label, slot, and data's columns) of the buckets with several components, by pairs of blocks (x, y) and sorted: those outside the largest component against all. And the written table of these buckets."""
    size = named.groupBy("band", "label").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    mixed = size.groupBy("band").agg(F.max_by("label", "k").alias("big"), F.max("k").alias("most"), F.sum("k").alias("all"), F.max_by("n", "k").alias("most_n"), F.sum("n").alias("all_n")).where("most < all")
    blocks = lambda k, n: F.greatest(F.ceil(k / BLOCK), F.ceil(8 * n / BLOCK_BYTES)).cast("int")
    most, every, most_n, every_n = (F.col(c) for c in ("most", "all", "most_n", "all_n"))
    mixed = written(mixed.select("band", "big", blocks(every - most, every_n - most_n).alias("few"), blocks(most, most_n).alias("many")), "near-mixed")
    own = F.col("label") == F.col("big")
    h = F.xxhash64("id", "s")
    rows = named.join(mixed, "band").withColumn("i", F.when(own, F.col("few") + F.pmod(h, F.col("many"))).otherwise(F.pmod(h, F.col("few"))).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.when(own, F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1))))
    rows = rows.select("band", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "i", "id", "s", "n", "label", "slot").join(data, "s")
    return rows.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y", "id", "s"), mixed


def near_groups(docs: DataFrame, k: int, similarity: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; similarity in hundredths."""
    small_batches(docs.sparkSession)
    least, ratio = similarity / 100 - MARGIN, similarity / 100
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = written(rows.mapInArrow(partial(_sketch, k=k), "doc_id long, n long, mark binary, regs binary").select("doc_id", "n", F.xxhash64("mark", "n").alias("s"), "regs"), "near-sketches")
    sizes = written(sketches.select("doc_id", "n", "s"), "near-sizes")
    reps = written(sketches.where("n > 0 and doc_id is not null").groupBy("s", "n", "regs").agg(F.min("doc_id").alias("id")), "near-sets")
    forget(sketches)

    bands = reps.select("id", "s", "n", F.posexplode(F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(regs, i * {ROWS} + 1, {ROWS})))")).alias("slot", "band"))
    shared = written(bands.groupBy("band").agg(F.min("id").alias("pivot"), F.min_by("s", "id").alias("pivot_s"), F.count("*").alias("many")).where("many > 1").drop("many"), "near-buckets")
    members = written(bands.join(shared, "band"), "near-members")
    regs = reps.select("s", "regs")

    def end(which: str) -> DataFrame:
        return reps.select(F.col("s").alias("s" + which), F.col("n").alias("n" + which), F.col("regs").alias("regs_" + which))

    star = written(members.where("pivot <> id").select(F.col("pivot").alias("a"), F.col("id").alias("b"), F.col("pivot_s").alias("sa"), F.col("s").alias("sb")).distinct(), "near-stars")
    ends = spread_join(star.join(end("b"), "sb"), end("a"), "sa", "sb").where(f"100 * least(na, nb) >= {similarity} * greatest(na, nb)")
    pairs = written(ends.select(*_PAIR, "regs_a", "regs_b").mapInArrow(partial(_likely, least=least), PAIR), "near-pairs")
    forget(shared, star)

    # Full sets of every set that a bucket shares and that may yet be compared.
    ids = written(members.select(F.col("id").alias("doc_id")).distinct(), "near-ids")
    sets = small_or_joined(rows, ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(partial(_full_sets, k=k), "mark binary, set binary")
    full = written(sets.select(F.xxhash64("mark", (F.octet_length("set") / 8).cast("long")).alias("s"), "set").dropDuplicates(["s"]), "near-full")

    a, b = (full.select(F.col("s").alias("s" + c), F.col("set").alias("set_" + c)) for c in "ab")
    ends = spread_join(pairs.join(b, "sb"), a, "sa", "sb").select("a", "b", "na", "nb", "set_a", "set_b")
    links = written(ends.mapInArrow(partial(_verify, similarity=similarity), "a long, b long"), "near-links")
    forget(ids, pairs)
    twice = sizes.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi").select("doc_id")
    again = written(sizes.select("doc_id", "s").distinct().join(twice, "doc_id").join(reps.select("s", "id"), "s").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b"), "near-again")
    labels = components(links.unionByName(again))

    named = written(members.join(labels, "id", "left").select("slot", "band", "id", "s", "n", F.coalesce("label", "id").alias("label")), "near-named")
    search = partial(_across, least=least, ratio=ratio, similarity=similarity)
    rows, mixed = _mixed_blocks(named, regs)
    asking = written(rows.mapInArrow(search, "band long, s long").distinct(), "near-asking")
    more = late = None
    if asking.limit(1).count():
        rows, late = _mixed_blocks(named.join(asking, ["band", "s"]), regs.join(full, "s"))
        more = written(rows.mapInArrow(search, "a long, b long"), "near-more-links")
        if more.limit(1).count():
            forget(labels)
            labels = components(links.unionByName(again).unionByName(more))
    old = [x for x in (named, mixed, asking, more, late) if x is not None]
    named = written(reps.join(labels, "id", "left").select("s", F.coalesce("label", "id").alias("label")), "near-components")
    forget(labels, members, full, reps, links, again, *old)
    some = sizes.join(named, "s", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("label", "doc_id"))
    return some.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, k: int = 5, similarity: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all columns, without those that another document of their component stands for. Rows that share an id are one document, and the first by text stays (of equal texts, the first by a hash of the row). Any other columns may be there."""
    groups = written(near_groups(docs, k, similarity, doc_id, text).select(F.col("doc_id").alias(doc_id), "kept"), "near-groups")
    kept = small_or_joined(docs, groups.where("not kept").select(doc_id).distinct(), doc_id, "left_anti")
    twice = groups.where(F.col("kept") & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.count("*").alias("many")).where("many > 1").select(doc_id)
    if not twice.limit(1).count():
        return kept
    first = F.min_by(F.struct(*(F.col(c) for c in docs.columns)), F.struct(F.col(text), F.xxhash64(*docs.columns)))
    again = kept.join(twice, doc_id, "left_semi").groupBy(doc_id).agg(first.alias("row")).select("row.*")
    return kept.join(twice, doc_id, "left_anti").select(*docs.columns).unionByName(again)
