"""Particle samplers. All choices are exact in number; random order is a digest of a seed and pind; nothing is gathered on one task: large choices number rows through range partitions, and class quotas need one row for each class on the driver.

Null states count as inactive; an empty table gives an empty sample; ties in corr go to the lower pind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators.rank import first_rows, quotas, shuffled, uniform
from tabulon.sources.adapter import running

ACTIVE = "state > 0"


def size_of(df: DataFrame, fraction: float) -> int:
    """The nearest integer to the fraction of active rows, at least 1 and at most all."""
    n = df.where(ACTIVE).count()
    return min(n, max(1, int(fraction * n + 0.5)))


def for_reconstruction(df: DataFrame) -> DataFrame:
    """Active rows that were ever updated, or all active rows if none was."""
    rows = df.where(ACTIVE)
    some = F.broadcast(rows.agg(F.coalesce(F.bool_or(F.col("updatecnt") > 0), F.lit(False)).alias("_some")))
    return rows.join(some).where(~F.col("_some") | (F.col("updatecnt") > 0)).drop("_some")


def random_part(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    return first_rows(df.where(ACTIVE), [shuffled(seed), F.col("pind")], size_of(df, fraction))


def latest_generation(df: DataFrame) -> DataFrame:
    """The active rows of the latest sample generation, again."""
    latest = F.broadcast(df.agg(F.max("sampled").alias("_latest")))
    return df.where(ACTIVE).join(latest).where(F.col("sampled") == F.col("_latest")).drop("_latest")


def fill_in(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Never-updated rows first, then those updated once, and so on."""
    return first_rows(df.where(ACTIVE), [F.col("updatecnt"), shuffled(seed), F.col("pind")], size_of(df, fraction))


def missing(df: DataFrame) -> DataFrame:
    return df.where(f"{ACTIVE} and updatecnt = 0")


def marked(df: DataFrame, chosen: DataFrame, increment: bool = True) -> DataFrame:
    """The table after an update of the chosen rows: their updatecnt grows by one, and sampled becomes the next generation (the latest one, without increment)."""
    latest = F.broadcast(df.agg((F.coalesce(F.max("sampled"), F.lit(0)) + (1 if increment else 0)).alias("_gen")))
    ids = chosen.select("pind").distinct().withColumn("_in", F.lit(True))
    rows = df.join(ids, "pind", "left").join(latest)
    return rows.withColumns({"updatecnt": F.col("updatecnt") + F.when(F.col("_in"), 1).otherwise(0), "sampled": F.when(F.col("_in"), F.col("_gen")).otherwise(F.col("sampled"))}).drop("_in", "_gen")


def set_updates(df: DataFrame, chosen: DataFrame, count: int) -> DataFrame:
    """updatecnt 0 everywhere but on the chosen rows."""
    ids = chosen.select("pind").distinct().withColumn("_in", F.lit(True))
    return df.join(ids, "pind", "left").withColumn("updatecnt", F.when(F.col("_in"), count).otherwise(0)).drop("_in")


def _placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their 1-based place in their class: a running count over range partitions of (class, order), less the classes before."""
    keys = [f"_key{i}" for i in range(len(order))]
    r = running(rows.withColumns(dict(zip(keys, order, strict=True))).withColumn("_one", F.lit(1)), ["class", *keys], ["_one"])
    before = r.groupBy("class").agg((F.min("cum__one") - 1).alias("_before"))
    return r.join(before, "class").withColumn(name, (F.col("cum__one") - F.col("_before")).cast("long")).drop(*keys, "_one", "cum__one", "_before")


def class_quotas(df: DataFrame, n: int, trim: bool = False) -> list[tuple[int, int, int]]:
    """(class, population, quota) by class; trim: the overshoot of the last round goes, from the last class backwards."""
    pops = sorted(tuple(r) for r in df.where(ACTIVE).groupBy("class").count().collect())
    quota = quotas(pops, n)
    if trim:
        for c, _ in reversed(pops):
            if sum(quota.values()) == n:
                break
            if quota[c] > 0:
                quota[c] -= 1
    return [(c, p, quota[c]) for c, p in pops]


def by_class(df: DataFrame, n: int, best: float | None = None, worst: float | None = None, cohort: bool = False, tiers: bool = False, greedy: bool = False, seed: int = 0) -> DataFrame:
    """A sample of about n active rows over the classes with round-robin quotas.

    Eligible are a class's members, or the best or worst fraction by corr (the quota at least), and with `cohort` only those
    sampled before (and the sum is exactly n). Of the eligible, the best by corr are taken (greedy), or those of the lowest
    updatecnt (tiers), in random order within a tier, or any. Fails where a class's cohort is too small."""
    rows = df.where(ACTIVE)
    sizes = class_quotas(df, n, trim=cohort)
    table = F.broadcast(df.sparkSession.createDataFrame(sizes, "class long, _pop long, _quota long"))
    share = best if best is not None else worst
    if share is not None:
        order = [-F.col("corr"), F.col("pind")] if best is not None else [F.col("corr"), -F.col("pind")]
        ranked = _placed(rows, order, "_rank").join(table, "class")
        rows = ranked.where(F.col("_rank") <= F.least(F.col("_pop"), F.greatest(F.col("_quota"), F.floor(share * F.col("_pop") + 0.5)))).drop("_rank", "_pop", "_quota")
    if cohort:
        rows = rows.where("sampled > 0")
    order = [-F.col("corr"), F.col("pind")] if greedy else [F.col("updatecnt"), shuffled(seed), F.col("pind")] if tiers else [shuffled(seed), F.col("pind")]
    out = _placed(rows, order, "_rank").join(table, "class").where("_rank <= _quota").drop("_rank", "_pop", "_quota")
    if cohort and out.count() < sum(q for *_, q in sizes):
        raise ValueError("a class has fewer rows sampled before than its quota")
    return out


def shuffled_ids(df: DataFrame, seed: int = 0) -> DataFrame:
    """pind and its place in a fixed random order."""
    from tabulon.sources.adapter import positions

    return positions(df.select("pind", shuffled(seed).alias("_key")), ["_key", "pind"], "place").drop("_key")


def balanced_labels(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Labels 1..n of sizes that differ by one at most, dealt in random order."""
    return shuffled_ids(df, seed).select("pind", ((F.col("place") - 1) % n + 1).alias("label"))


def drawn_index(probabilities: list[float], r: Column) -> Column:
    """A draw: probabilities in ascending order, the place from the back where their running sum first reaches r (1-based; ties keep their order); what rounding leaves falls to the least."""
    order = sorted(range(len(probabilities)), key=lambda i: (probabilities[i], i))
    total, out = 0.0, None
    for i in reversed(order):
        total += probabilities[i]
        out = F.when(r <= total, i + 1) if out is None else out.when(r <= total, i + 1)
    return out.otherwise(order[0] + 1)


def likelihood_draw(distances: list[float], n: int, r: Column) -> Column:
    """A draw among the n smallest distances with weights exp(least - distance)."""
    order = sorted(range(len(distances)), key=lambda i: (distances[i], i))[:n]
    from math import exp

    w = [exp(distances[order[0]] - distances[i]) for i in order]
    total, out = 0.0, None
    for i, x in zip(order, w, strict=True):
        total += x / sum(w)
        out = F.when(r <= total, i + 1) if out is None else out.when(r <= total, i + 1)
    return out.otherwise(order[-1] + 1)


def stacks_up_to(stacks: DataFrame, cap: int, bias: bool = False, seed: int = 0) -> DataFrame:
    """Whole stacks (okey, nptcls, cnt) in random order until their particles reach the cap; bias: less updated stacks (cnt) come first, by ((1 + cnt - min) / (1 + max - min)) ** 0.1 less a random number."""
    key = uniform(seed)
    rows = stacks.withColumn("pind", F.col("okey"))
    if bias:
        lim = F.broadcast(rows.agg(F.min("cnt").alias("_lo"), F.max("cnt").alias("_hi")))
        rows = rows.join(lim)
        key = F.pow((1.0 + F.col("cnt") - F.col("_lo")) / (1.0 + F.col("_hi") - F.col("_lo")), F.lit(0.1)) - key
    r = running(rows.withColumn("_key", key).select("okey", "nptcls", "_key"), ["_key", "okey"], ["nptcls"])
    return r.where(F.col("cum_nptcls") - F.col("nptcls") < cap).select("okey", "nptcls")
