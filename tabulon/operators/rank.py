"""Rankings, samples and relabelling. Orders are total: ties go to the lower pind; random order is a hash of pind and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tabulon.sources.adapter import positions


def shuffled(seed: int) -> Column:
    """A fixed pseudo-random order that SQL engines share: a digest of the seed and pind."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("pind").cast("string")))


def uniform(seed: int) -> Column:
    """A fixed pseudo-random number in [0, 1) for each pind: the digest's first 32 bits."""
    return F.conv(F.substring(shuffled(seed), 1, 8), 16, 10).cast("double") / 2**32


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in an order that is total, for any n: rows are numbered through range partitions."""
    keys = [f"_key{i}" for i in range(len(order))]
    return positions(df.withColumns(dict(zip(keys, order, strict=True))), keys, "_place").where(F.col("_place") <= n).drop(*keys, "_place")


def top(df: DataFrame, by: list[Column], n: int) -> DataFrame:
    """The first n rows: a heap in each task, merged."""
    return df.orderBy(*by).limit(n)


def top_in_group(df: DataFrame, group: str, by: list[Column], n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.Window.partitionBy(group).orderBy(*by))).where(F.col("place") <= n)


def sample_lowest(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Tiered sampling: nint(fraction * active) rows, lowest updatecnt first, in fixed random order within a tier. Tier sizes come first, so only the cutoff tier is ordered."""
    rows = df.where("state > 0")
    tiers = sorted(tuple(r) for r in rows.groupBy("updatecnt").count().collect())
    left = max(1, int(fraction * sum(n for _, n in tiers) + 0.5))
    whole: list[int] = []
    for tier, n in tiers:
        if n > left:
            cut = first_rows(rows.where(F.col("updatecnt") == tier), [shuffled(seed), F.col("pind")], left)
            return rows.where(F.col("updatecnt").isin(whole)).unionByName(cut) if whole else cut
        whole.append(tier)
        left -= n
        if not left:
            break
    return rows.where(F.col("updatecnt").isin(whole))


def quotas(pops: list[tuple[int, int]], n: int) -> dict[int, int]:
    """Round-robin quotas: every class with room gains one a round until n is reached, so the last round may overshoot; stops when all are full."""
    quota = {c: 0 for c, _ in pops}
    while sum(quota.values()) < n:
        room = [c for c, p in pops if quota[c] < p]
        if not room:
            break
        # as many whole rounds at once as the smallest room and the rest allow
        step = max(1, min(min(p - quota[c] for c, p in pops if quota[c] < p), (n - sum(quota.values())) // len(room)))
        for c in room:
            quota[c] += step
    return quota


def sample_balanced(df: DataFrame, n: int, greedy: bool = True, seed: int = 0) -> DataFrame:
    """n rows over the classes with balanced quotas (a row for each class on the driver), the best of each by corr or in fixed random order."""
    rows = df.where("state <> 0")
    pops = sorted(tuple(r) for r in rows.groupBy("class").count().collect())
    q = df.sparkSession.createDataFrame([(c, k) for c, k in quotas(pops, n).items()], "class long, quota long")
    order = [F.desc("corr"), F.col("pind")] if greedy else [shuffled(seed), F.col("pind")]
    ranked = rows.withColumn("place", F.row_number().over(W.Window.partitionBy("class").orderBy(*order)))
    return ranked.join(F.broadcast(q), "class").where("place <= quota").drop("quota", "place")


def deal(df: DataFrame, parts: int) -> DataFrame:
    """Active members of each class, best first, dealt round-robin to parts; a last round that isn't full stays undealt (part 0)."""
    w = W.Window.partitionBy("class")
    place = F.row_number().over(w.orderBy(F.desc("corr"), "pind"))
    rows = df.where("state <> 0").select("pind", "class", place.alias("place"), F.count("*").over(w).alias("pop"))
    return rows.select("pind", "class", F.when(F.floor((F.col("place") - 1) / parts) < F.floor(F.col("pop") / parts), (F.col("place") - 1) % parts + 1).otherwise(0).cast("int").alias("part"))


def blocks(df: DataFrame, parts: int) -> DataFrame:
    """Active members of each class, best first, in contiguous blocks of even sizes."""
    return df.where("state <> 0").select("pind", "class", F.ntile(parts).over(W.Window.partitionBy("class").orderBy(F.desc("corr"), "pind")).alias("part"))


def even_parts(df: DataFrame, parts: int, n: int) -> DataFrame:
    """Contiguous parts of numbered rows, the first n % parts one row larger: arithmetic on pind, no window."""
    size, rest = divmod(n, parts)
    cut = rest * (size + 1)
    p = F.when(F.col("pind") <= cut, F.ceil(F.col("pind") / (size + 1))).otherwise(rest + F.ceil((F.col("pind") - cut) / max(size, 1)))
    return df.select("pind", p.cast("int").alias("part"))


def rank_weights(n: Column, r: Column, p: float) -> list[Column]:
    """Rank-sum, exponent and inverse weights of rank r of n, each over its sum in the window of the caller."""
    return [(2 * (n + 1 - r) / (n * (n + 1))).alias("rank_sum"), F.pow(n - r + 1, F.lit(p)).alias("exponent"), (1 / r).alias("inverse")]


def scale_in(df: DataFrame, which: str, group: str) -> DataFrame:
    """z score (1 for a constant), min-max share and percentage within each group."""
    w = W.Window.partitionBy(group)
    c, sd, lo, hi = F.col(which), F.stddev_samp(which).over(w), F.min(which).over(w), F.max(which).over(w)
    share = F.when(hi > lo, (c - lo) / (hi - lo))
    return df.select("pind", group, F.round(F.when(sd > 0, (c - F.avg(which).over(w)) / sd).otherwise(1.0), 5).alias("z"), F.round(share, 6).alias("share"), F.round(100 * share, 5).alias("percent"), F.round(100 * (1 - share), 5).alias("reverse"))


def compact_labels(df: DataFrame, label: str, most: int) -> DataFrame:
    """Consecutive labels for classes of more than one active row, others get label and state 0; nothing changes unless some class is empty."""
    pops = df.where("state <> 0").groupBy(label).agg(F.count("*").alias("_pop"))
    if pops.where(F.col(label).between(1, most)).count() == most:
        return df
    new = pops.where("_pop > 1").select(label, F.row_number().over(W.Window.orderBy(label)).cast("long").alias("_new"))
    return df.join(F.broadcast(new), label, "left").withColumn(label, F.coalesce("_new", F.lit(0))).withColumn("state", F.when(F.col("_new").isNull(), 0).otherwise(F.col("state"))).drop("_new")


def split_group(df: DataFrame, label: str, value: int, seed: int = 0) -> DataFrame:
    """Half of a group, in fixed random order, gets the next label after the largest; a label out of range is an error."""
    new = int(df.agg(F.coalesce(F.greatest(F.lit(1), F.max(label)), F.lit(1))).first()[0]) + 1
    if not 1 <= value < new:
        raise ValueError(f"{label} {value} is out of range")
    half = df.where(F.col(label) == value).select("pind", F.ntile(2).over(W.Window.partitionBy(label).orderBy(shuffled(seed), "pind")).alias("_half"), label)
    moved = half.where("_half = 2").select("pind", F.lit(new).alias("_to"))
    return df.join(moved, "pind", "left").withColumn(label, F.coalesce("_to", label)).drop("_to")
