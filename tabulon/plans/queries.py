"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tabulon.functions import columns as C
from tabulon.operators import aggregate as A
from tabulon.operators import join as J
from tabulon.operators import rank as R
from tabulon.operators import reshape as S
from tabulon.operators import robust as B
from tabulon.operators import select as P
from tabulon.sources.adapter import SQL, classes, particles, positions, stacks
from tabulon.sources.text import from_lines, to_lines
from tabulon.streaming.chunks import chunks_of, rates, sessions
from tabulon.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):
    """Registers a query under its function's name; base: the SQL gets the adapter's tables (ptcl, cls, stk)."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (f"WITH {SQL}{',' if sql.lstrip().startswith(',') else ''} " + sql.lstrip().lstrip(",")) if base else sql
        return f

    return keep


# Selection


@query("SELECT pind, corr FROM ptcl WHERE state > 0")
def get_all(spark, d):
    return P.get_all(particles(spark, d), "corr", nonzero=True)


@query("SELECT pind, round(dfx)::BIGINT AS dfx FROM ptcl")
def get_all_asint(spark, d):
    return P.get_all_asint(particles(spark, d), "dfx")


@query("SELECT pind, corr FROM ptcl WHERE class = 3 AND state > 0")
def get_arr_class(spark, d):
    return P.get_arr(particles(spark, d), "corr", cls=3)


@query("SELECT pind, dfy FROM ptcl WHERE state = 2")
def get_arr_state(spark, d):
    return P.get_arr(particles(spark, d), "dfy", state=2)


@query("SELECT pind, sampled FROM ptcl WHERE state = 1 AND sampled > (SELECT max(sampled) FROM ptcl WHERE state = 1) - 0.5")
def get_all_sampled(spark, d):
    return P.latest_sampled(particles(spark, d), 1).select("pind", "sampled")


@query("SELECT pind FROM ptcl WHERE class = 5 AND state <> 0 AND updatecnt <> 0")
def get_pinds(spark, d):
    return P.label_rows(particles(spark, d), "class", 5, updated=True)


@query("SELECT DISTINCT class FROM ptcl WHERE state <> 0 AND class >= 1", True)
def get_label_inds(spark, d):
    return P.label_values(particles(spark, d, numbered=False), "class")


@query("SELECT pind, (class = 2 AND corr >= (SELECT quantile_cont(corr, 0.8) FROM ptcl WHERE class = 2)) AS mask FROM ptcl")
def gen_ptcl_mask(spark, d):
    return P.best_fraction(particles(spark, d), "class", 2, 0.2)


@query("SELECT pind, state = 1 AND class = 4 AS mask FROM ptcl")
def gen_mask(spark, d):
    return particles(spark, d).select("pind", ((F.col("state") == 1) & (F.col("class") == 4)).alias("mask"))


@query("SELECT pind, state > 0 AS incl FROM ptcl")
def included(spark, d):
    return particles(spark, d).select("pind", (F.col("state") > 0).alias("incl"))


@query("SELECT bool_or(state = 0) AS any_zero, bool_or(sampled > 0) AS any_sampled FROM ptcl")
def any_state_zero(spark, d):
    return particles(spark, d, False).agg(F.bool_or(F.col("state") == 0).alias("any_zero"), F.bool_or(F.col("sampled") > 0).alias("any_sampled"))


@query("SELECT row_number() OVER (ORDER BY pind) AS pind, class, corr FROM ptcl WHERE state > 0")
def compress(spark, d):
    """Physical filter and new numbers."""
    return positions(particles(spark, d).where("state > 0").withColumnRenamed("pind", "was"), ["was"]).select("pind", "class", "corr")


@query("SELECT i.range AS place, p.pind, p.class FROM range(1, 101) i JOIN ptcl p ON p.pind = i.range * 37")
def extract_subset(spark, d):
    ids = spark.range(1, 101).select(F.col("id").alias("place"), (F.col("id") * 37).alias("pind"))
    return P.gather(particles(spark, d), ids).select("place", "pind", "class")


@query("SELECT CASE WHEN pind > 7 THEN pind - 1 ELSE pind END AS pind, corr FROM ptcl WHERE pind <> 7")
def delete_row(spark, d):
    return P.drop_row(particles(spark, d), 7).select("pind", "corr")


@query("SELECT pind, 0.0::DOUBLE AS corr, 0.0::DOUBLE AS class FROM ptcl")
def delete_clustering(spark, d):
    return P.reset(particles(spark, d), ["corr", "class"]).select("pind", "corr", "class")


@query("SELECT pind, CASE WHEN class = 3 THEN 1.0 ELSE corr END::DOUBLE AS corr FROM ptcl")
def set_field(spark, d):
    return P.set_where(particles(spark, d), "class", 3, "corr", 1.0).select("pind", "corr")


@query("SELECT pind, CASE WHEN corr < 0.02 OR dfx > 60000 OR state = 0 THEN 0 ELSE 1 END AS state FROM ptcl")
def selection(spark, d):
    return P.selection(particles(spark, d), least_corr=0.02, most_df=60000.0).select("pind", "state")


@query("""SELECT * FROM (SELECT pind, class, round(corr, 6) AS corr, row_number() OVER (ORDER BY corr DESC, pind) AS place FROM ptcl WHERE state > 0) WHERE place BETWEEN 101 AND 150""")
def page_query(spark, d):
    """Sorted page: a heap keeps the rows up to the page's end, and only those are numbered."""
    rows = R.top(particles(spark, d).where("state > 0"), [F.desc("corr"), F.col("pind")], 150)
    return rows.withColumn("place", F.row_number().over(W.Window.orderBy(F.desc("corr"), "pind"))).where("place >= 101").select("pind", "class", F.round("corr", 6).alias("corr"), "place")


# Joins


@query("SELECT p.pind, p.class, coalesce(c.cls_state, 0) AS state FROM ptcl p LEFT JOIN cls c ON c.icls = p.class")
def map2ptcls_state(spark, d):
    return J.class_state_to_particles(particles(spark, d), classes(spark, d)).select("pind", "class", "state")


@query("SELECT p.pind, CASE WHEN c.cls_state = 0 THEN 0 ELSE p.state END AS state, c.cls_state AS flag FROM ptcl p LEFT JOIN cls c ON c.icls = p.class")
def map_cls2d_flag(spark, d):
    c = classes(spark, d).withColumn("flag", F.col("cls_state"))
    return J.class_flag_to_particles(particles(spark, d), c, "flag").select("pind", "state", F.col("flag_of_class").alias("flag"))


@query("""SELECT icls, coalesce(n - off, 0) AS pop, CASE WHEN coalesce(n - off, 0) > 0 THEN cls_state ELSE 0 END AS state
    FROM cls LEFT JOIN (SELECT class, count(*) AS n, count(*) FILTER (state <> 1) AS off FROM ptcl GROUP BY class) p ON p.class = icls""")
def map_ptcls_state_to_cls(spark, d):
    return J.particle_state_to_classes(particles(spark, d, False), classes(spark, d))


@query("SELECT p.pind, p.okey, p.pind - s.fromp + 1 AS indstk FROM ptcl p JOIN stk s USING (okey)")
def map_ptcl_ind2stk_ind(spark, d):
    p = particles(spark, d)
    return J.stack_positions(p, stacks(p))


@query("SELECT p.pind, s.okey AS stack FROM ptcl p JOIN stk s ON p.pind BETWEEN s.fromp AND s.top")
def stack_of_range(spark, d):
    p = particles(spark, d)
    return J.by_range(p, stacks(p)).select("pind", "stack")


@query("""SELECT o_orderkey AS okey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""", base=False)
def mics_without_stack(spark, d):
    return J.orphans(table(spark, d, "orders").select(F.col("o_orderkey").alias("okey")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("okey")), "okey")


@query("""SELECT o.o_orderkey AS okey, c.c_nationkey + 1 AS ogid, n.n_name AS ogname, coalesce(s.nptcls, 0) AS nptcls
    FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN stk s ON s.okey = o.o_orderkey""")
def mic_optics(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("okey")).agg(F.count("*").alias("nptcls"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("okey"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(table(spark, d, "nation"), "n_nationkey")
    return o.join(c, "c_custkey").join(n, "okey", "left").select("okey", (F.col("n_nationkey") + 1).alias("ogid"), F.col("n_name").alias("ogname"), F.coalesce("nptcls", F.lit(0)).alias("nptcls"))


@query("""SELECT okey, class, w::BIGINT AS weight FROM (SELECT okey, class, w, row_number() OVER (PARTITION BY okey ORDER BY w DESC, class) AS k
    FROM (SELECT okey, class, sum(updatecnt) AS w FROM ptcl GROUP BY 1, 2)) WHERE k = 1""")
def consensus_vote(spark, d):
    return J.vote(particles(spark, d, False), "okey", "class", "updatecnt")


@query("""SELECT src, dst, rank, round(d2, 4) AS d2 FROM (SELECT a.vec_id AS src, b.vec_id AS dst, d2, row_number() OVER (PARTITION BY a.vec_id ORDER BY d2, b.vec_id) AS rank
    FROM embeddings a, embeddings b, LATERAL (SELECT list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS d2)
    WHERE a.vec_id <> b.vec_id AND a.vec_id % 50 = 0) WHERE rank <= 5""", base=False)
def nearest_neighbours(spark, d):
    """Neighbours among all vectors of the query set, the vectors whose id is divisible by 50."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return J.nearest(v.where("id % 50 = 0"), v, 5).select("src", "dst", "rank", F.round("d2", 4).alias("d2"))


# Aggregates


@query(", g AS (SELECT range AS class FROM range(1, 21)) SELECT g.class, coalesce(n, 0) AS pop FROM g LEFT JOIN (SELECT class, count(*) AS n FROM ptcl WHERE state <> 0 GROUP BY class) p USING (class)")
def get_pops(spark, d):
    return A.populations(particles(spark, d, False), "class", 20)


@query("SELECT greatest(1, max(class)) AS n FROM ptcl")
def get_n(spark, d):
    return A.largest_label(particles(spark, d, False), "class")


@query("SELECT count(*) AS noris, count(*) FILTER (state > 0) AS active, count(*) FILTER (eo = 0) AS neven, count(*) FILTER (state = 2) AS state2 FROM ptcl")
def get_noris(spark, d):
    return particles(spark, d, False).agg(F.count("*").alias("noris"), F.count_if(F.col("state") > 0).alias("active"), F.count_if(F.col("eo") == 0).alias("neven"), F.count_if(F.col("state") == 2).alias("state2"))


@query("SELECT class, eo, state, count(*) AS pop FROM ptcl WHERE state <> 0 GROUP BY ALL")
def get_pop_labels(spark, d):
    return particles(spark, d, False).where("state <> 0").groupBy("class", "eo", "state").agg(F.count("*").alias("pop"))


@query("SELECT round(coalesce(sum(corr), 0), 6) AS total, count(*) AS cnt, round(sum(corr) / count(*), 6) AS avg FROM ptcl WHERE state <> 0 AND class = 4")
def get_avg(spark, d):
    return A.total(particles(spark, d, False), "corr", F.col("class") == 4)


@query("SELECT round(median(corr), 6) AS med, min(corr) AS lo, max(corr) AS hi, round(avg(corr), 6) AS ave, round(stddev_samp(corr), 6) AS sdev FROM ptcl WHERE state > 0")
def stats(spark, d):
    return particles(spark, d, False).where("state > 0").agg(F.round(F.median("corr"), 6).alias("med"), F.min("corr").alias("lo"), F.max("corr").alias("hi"), F.round(F.avg("corr"), 6).alias("ave"), F.round(F.stddev_samp("corr"), 6).alias("sdev"))


@query("SELECT state, count(*) AS n FROM ptcl GROUP BY state HAVING count(*) > 100")
def states_exist(spark, d):
    return particles(spark, d, False).groupBy("state").agg(F.count("*").alias("n")).where("n > 100")


@query("SELECT class, round(count(*) FILTER (sampled = (SELECT max(sampled) FROM ptcl)) / count(*)::DOUBLE, 6) AS frac FROM ptcl WHERE state > 0 AND updatecnt > 0 GROUP BY class")
def get_class_update_fracs(spark, d):
    return A.update_fractions(particles(spark, d, False), ["class"])


@query("SELECT class, count(*) AS pop, string_agg(pind, ',' ORDER BY corr DESC, pind) AS pinds FROM ptcl WHERE state <> 0 GROUP BY class")
def get_class_sample_stats(spark, d):
    return A.group_order(particles(spark, d), "class").withColumn("pinds", F.array_join("pinds", ","))


@query("""SELECT count(*) AS n, round(avg(value), 6) AS ave, round(stddev_samp(value), 6) AS sdev, round(var_samp(value), 6) AS var, round(skewness(value), 5) AS skew,
    round((n1 + 1) * n1 / ((n1 - 1) * (n1 - 2) * (n1 - 3)) * n1 * (kurtosis_pop(value) + 3) - 3 * (n1 - 1) * (n1 - 1) / ((n1 - 2) * (n1 - 3)), 4) AS kurt
    FROM events, (SELECT count(*)::DOUBLE AS n1 FROM events) GROUP BY n1""", base=False)
def moments(spark, d):
    return table(spark, d, "events").agg(*A.moments("value"))


@query("SELECT round(corr(corr, dfy), 6) AS r FROM ptcl")
def pearson(spark, d):
    return particles(spark, d, False).agg(F.round(F.corr("corr", "dfy"), 6).alias("r"))


@query("""SELECT event_type, round(med, 6) AS med, round(mad, 6) AS mad, round(mad * 1.4826, 6) AS mad_gau, round(med + 3 * mad, 6) AS thres FROM (
    SELECT event_type, med, median(abs(value - med)) AS mad FROM events JOIN (SELECT event_type, median(value) AS med FROM events GROUP BY 1) USING (event_type) GROUP BY 1, 2)""", base=False)
def robust_sigma_thres(spark, d):
    return A.robust(table(spark, d, "events"), "value", 3.0, ["event_type"])


HIST = """h AS (SELECT event_type, least(20, greatest(1, ceil((value - lo) / ((hi - lo) / 20))))::INT AS bin, lo + (least(20, greatest(1, ceil((value - lo) / ((hi - lo) / 20)))) - 1) * ((hi - lo) / 20) AS edge
    FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events))"""


@query(f"WITH {HIST} SELECT bin, round(edge, 6) AS edge, count(*) AS cnt FROM h GROUP BY ALL", base=False)
def histogram(spark, d):
    return A.histogram(table(spark, d, "events"), "value", 20)


@query(f"WITH {HIST}, c AS (SELECT bin, count(*) / sum(count(*)) OVER () AS p FROM h GROUP BY bin) SELECT round(-sum(p * ln(p)), 6) AS entropy, round(-sum(p * ln(p)) / ln(20), 6) AS bounded FROM c", base=False)
def histogram_entropy(spark, d):
    return A.entropy(A.histogram(table(spark, d, "events"), "value", 20), 20)


@query("""WITH a AS (SELECT floor(value / 10)::INT AS bin, count(*) / sum(count(*)) OVER () AS p FROM events WHERE event_id % 2 = 0 GROUP BY 1),
    b AS (SELECT floor(value / 10)::INT AS bin, count(*) / sum(count(*)) OVER () AS q FROM events WHERE event_id % 2 = 1 GROUP BY 1),
    c AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q, (coalesce(p, 0) + coalesce(q, 0)) / 2 AS m FROM a FULL JOIN b USING (bin))
    SELECT round(sum(abs(p - q)) / 2, 6) AS tvd, round(sum(CASE WHEN p > 0 AND q > 0 THEN p * ln(p / q) ELSE 0 END), 6) AS kld,
    round((sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END)) / 2, 6) AS jsd, round(sqrt(sum((sqrt(p) - sqrt(q)) ** 2) / 2), 6) AS hd FROM c""", base=False)
def histogram_divergences(spark, d):
    e = table(spark, d, "events").select("event_id", F.floor(F.col("value") / 10).cast("int").alias("bin"))
    h = lambda k: e.where(f"event_id % 2 = {k}").groupBy("bin").agg(F.count("*").alias("cnt"))
    return A.divergences(h(0), h(1))


@query("""WITH x AS (SELECT n_chars > 1500 AS p, toxic = 1 AS a FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND NOT a) AS tn, count(*) FILTER (NOT p AND a) AS fn FROM x),
    m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END AS pr, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END AS re, CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp)::DOUBLE END AS sp FROM c)
    SELECT tp, fp, tn, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(sp, 6) AS specificity, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1,
    round((re + sp) / 2, 6) AS balacc, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy FROM m""", base=False)
def binary_metrics(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return A.confusion(rows, F.col("n_chars") > 1500, F.col("toxic") == 1)


@query("""WITH x AS (SELECT n_chars, toxic FROM documents JOIN labels USING (doc_id)), r AS (SELECT toxic, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rk FROM x)
    SELECT round((sum(rk) FILTER (toxic = 1) - count(*) FILTER (toxic = 1) * (count(*) FILTER (toxic = 1) + 1) / 2.0) / (count(*) FILTER (toxic = 1) * count(*) FILTER (toxic = 0))::DOUBLE, 6) AS auc FROM r""", base=False)
def auc_for_values(spark, d):
    return A.auc(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id"), "n_chars", F.col("toxic") == 1)


@query("SELECT eo, count(DISTINCT class) AS classes, count(DISTINCT okey) AS stacks FROM ptcl GROUP BY eo")
def distinct_counts(spark, d):
    return particles(spark, d, False).groupBy("eo").agg(F.count_distinct("class").alias("classes"), F.count_distinct("okey").alias("stacks"))


@query("SELECT state, class, count(*) AS n FROM ptcl GROUP BY CUBE (state, class)")
def cube_counts(spark, d):
    return particles(spark, d, False).cube("state", "class").agg(F.count("*").alias("n"))


@query("SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS n FROM events) WHERE k = 1 + floor(0.25 * (n - 1))", base=False)
def percentile_real(spark, d):
    return B.percentile_at(table(spark, d, "events"), "value", 0.25)


@query("SELECT min(dfx) AS dfx FROM (SELECT dfx, sum(corr) OVER (ORDER BY dfx) AS cum, sum(corr) OVER () AS t FROM ptcl) WHERE cum >= 0.5 * t - 1e-12")
def percentile_weighted_real(spark, d):
    return B.percentile_weighted(particles(spark, d, False), "dfx", "corr", 0.5)


@query("SELECT dfx FROM (SELECT dfx, row_number() OVER (ORDER BY dfx) AS k, count(*) OVER () AS n FROM ptcl WHERE state > 0) WHERE k = round(n * 0.1)")
def extremal_bound(spark, d):
    return B.at_place(particles(spark, d, False).where("state > 0"), "dfx", F.round(F.col("n") * 0.1))


@query("SELECT round(avg(value), 6) AS avg FROM (SELECT value, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS n FROM events) WHERE k <= ceil(n * 0.3)", base=False)
def avg_frac_smallest(spark, d):
    return B.mean_of_smallest(table(spark, d, "events"), "value", 0.3)


@query("""WITH g AS (SELECT value, count(*) FILTER (user_id % 2 = 0) AS a, count(*) FILTER (user_id % 2 = 1) AS b FROM events GROUP BY value),
    c AS (SELECT sum(a) OVER (ORDER BY value) / sum(a) OVER ()::DOUBLE AS fa, sum(b) OVER (ORDER BY value) / sum(b) OVER ()::DOUBLE AS fb FROM g),
    m AS (SELECT max(abs(fa - fb)) AS d, (SELECT sqrt(sum(a) * sum(b) / (sum(a) + sum(b))::DOUBLE) FROM g) AS e FROM c)
    SELECT round(any_value(d), 6) AS d, round(least(1, greatest(0, sum(2 * (CASE WHEN k.range % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k.range * k.range * ((e + 0.12 + 0.11 / e) * d) ** 2)))), 6) AS prob FROM m, range(1, 101) k""", base=False)
def kstwo(spark, d):
    return B.two_sample_distance(table(spark, d, "events"), "value", F.col("user_id") % 2 == 1)


@query("""WITH l AS (SELECT min(value) AS lo, max(value) AS hi FROM events), v AS (SELECT round((value - lo) * 255 / (hi - lo))::INT AS b FROM events, l),
    t AS (SELECT range AS t FROM range(1, 255)), s AS (SELECT t, var_pop(b) FILTER (b <= t) * count(*) FILTER (b <= t) + coalesce(var_pop(b) FILTER (b > t) * count(*) FILTER (b > t), 0) AS within FROM v, t GROUP BY t)
    SELECT round(lo + t * (hi - lo) / 255, 6) AS threshold FROM l, (SELECT t FROM s ORDER BY round(within, 4), t LIMIT 1)""", base=False)
def otsu(spark, d):
    return B.otsu(table(spark, d, "events"), "value")


@query("""SELECT class, round(m, 6) AS mean, round(CASE WHEN n > 1 THEN (sxx / sw - m * m) * n / (n - 1) ELSE 0 END, 6) AS var FROM (
    SELECT class, count(*) AS n, sum(corr) AS sw, sum(corr * dfy * dfy) AS sxx, sum(corr * dfy) / sum(corr) AS m FROM ptcl WHERE corr > 0 GROUP BY class)""")
def online_var(spark, d):
    return B.weighted_moments(particles(spark, d, False), "dfy", "corr", "class")


@query("SELECT least(30, round((dfx - lo) / ((hi + 1 - lo) / 30)) + 1)::INT AS bin, count(*) AS cnt FROM ptcl, (SELECT min(dfx) AS lo, max(dfx) AS hi FROM ptcl) GROUP BY 1")
def create_hist_vector(spark, d):
    return B.nearest_bins(particles(spark, d, False), "dfx", 30)


@query(""", c AS (SELECT floor((pind - 1) * 4096 / n) AS cell, n, min(pind) AS lo, max(pind) AS hi, count(*) FILTER (state > 0) AS a FROM ptcl, (SELECT count(*) AS n FROM ptcl) GROUP BY 1, 2),
    s AS (SELECT *, least(6, floor((sum(a) OVER (ORDER BY cell) - a) / ceil(n / 6.0)) + 1)::INT AS part FROM c) SELECT part, min(lo) AS lo, max(hi) AS hi, sum(a)::BIGINT AS active FROM s GROUP BY part""")
def gen_balanced_partitions(spark, d):
    return B.balanced_ranges(particles(spark, d), 6)


@query("SELECT state, class, count(*) AS n FROM ptcl GROUP BY state, class HAVING count(*) > 150")
def projs_exist(spark, d):
    return particles(spark, d, False).groupBy("state", "class").agg(F.count("*").alias("n")).where("n > 150")


@query("SELECT state, round(count(*) FILTER (sampled = (SELECT max(sampled) FROM ptcl)) / count(*)::DOUBLE, 6) AS frac FROM ptcl WHERE state > 0 AND updatecnt > 0 GROUP BY state")
def get_state_update_fracs(spark, d):
    return A.update_fractions(particles(spark, d, False), ["state"])


@query("SELECT round(1 - 6 * sum((r1 - r2) ** 2) / (max(n)::DOUBLE * (max(n)::DOUBLE * max(n) - 1)), 6) AS r FROM (SELECT row_number() OVER (ORDER BY value, event_id) AS r1, row_number() OVER (ORDER BY user_id, event_id) AS r2, count(*) OVER () AS n FROM events)", base=False)
def spear(spark, d):
    """Rank correlation without tie correction; both ranks come from range partitions."""
    e = positions(table(spark, d, "events").select("event_id", "value", "user_id"), ["value", "event_id"], "r1")
    e = positions(e, ["user_id", "event_id"], "r2")
    n = F.count("*").cast("double")
    return e.agg(F.round(1 - 6 * F.sum((F.col("r1") - F.col("r2")).cast("double") ** 2) / (n * (n * n - 1)), 6).alias("r"))


# Rankings


@query("SELECT pind, corr, row_number() OVER (ORDER BY corr DESC, pind) AS place FROM ptcl")
def order(spark, d):
    """All rows ranked by corr: numbered through range partitions."""
    rows = particles(spark, d).select("pind", "corr", (-F.col("corr")).alias("_k"))
    return positions(rows, ["_k", "pind"], "place").drop("_k")


@query("SELECT class, pop, row_number() OVER (ORDER BY pop DESC, class) AS place FROM (SELECT class, count(*) AS pop FROM ptcl WHERE state <> 0 GROUP BY class)")
def order_cls(spark, d):
    c = particles(spark, d, False).where("state <> 0").groupBy("class").agg(F.count("*").alias("pop"))
    return c.withColumn("place", F.row_number().over(W.Window.orderBy(F.desc("pop"), "class")))


@query("""SELECT pind, class, round(CASE WHEN sd > 0 THEN (corr - av) / sd ELSE 1 END, 5) AS z, round(CASE WHEN hi > lo THEN (corr - lo) / (hi - lo) END, 6) AS share,
    round(100 * CASE WHEN hi > lo THEN (corr - lo) / (hi - lo) END, 5) AS percent, round(100 * (1 - CASE WHEN hi > lo THEN (corr - lo) / (hi - lo) END), 5) AS reverse
    FROM (SELECT *, stddev_samp(corr) OVER w AS sd, avg(corr) OVER w AS av, min(corr) OVER w AS lo, max(corr) OVER w AS hi FROM ptcl WINDOW w AS (PARTITION BY class))""")
def z_scores(spark, d):
    return R.scale_in(particles(spark, d), "corr", "class")


@query("""SELECT class, place, round(2 * (n + 1 - place) / (n * (n + 1))::DOUBLE, 9) AS rank_sum, round((n - place + 1) ** 2.0 / sum((n - place + 1) ** 2.0) OVER w, 9) AS exponent, round((1.0::DOUBLE / place) / sum(1.0::DOUBLE / place) OVER w, 9) AS inverse
    FROM (SELECT class, row_number() OVER (PARTITION BY class ORDER BY corr DESC, pind) AS place, count(*) OVER (PARTITION BY class) AS n FROM ptcl WHERE state <> 0) WINDOW w AS (PARTITION BY class)""")
def rank_weights(spark, d):
    w = W.Window.partitionBy("class")
    p = particles(spark, d).where("state <> 0").select("class", F.row_number().over(w.orderBy(F.desc("corr"), "pind")).alias("place"), F.count("*").over(w).alias("n"))
    p = p.select("class", "place", *R.rank_weights(F.col("n"), F.col("place"), 2.0))
    return p.select("class", "place", F.round("rank_sum", 9).alias("rank_sum"), *(F.round(F.col(c) / F.sum(c).over(w), 9).alias(c) for c in ("exponent", "inverse")))


@query("SELECT pind, ntile(7) OVER (ORDER BY pind) AS part FROM ptcl")
def split_nobjs_even(spark, d):
    p = particles(spark, d)
    return R.even_parts(p, 7, p.count())


@query("SELECT pind, ((pind - 1) % 2)::BIGINT AS eo FROM ptcl")
def partition_eo(spark, d):
    return particles(spark, d).select("pind", ((F.col("pind") - 1) % 2).alias("eo"))


@query("""SELECT event_id, value FROM (SELECT event_id, user_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE (a IS NULL AND b IS NULL) OR (a IS NULL AND value > b) OR (b IS NULL AND value > a) OR (value >= a AND value >= b)""", base=False)
def peakfinder(spark, d):
    """Local maxima of each user's series: at least both neighbours inside, more than the one at an end."""
    w = W.Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_id", "value", F.lag("value").over(w).alias("a"), F.lead("value").over(w).alias("b"))
    v, a, b = F.col("value"), F.col("a"), F.col("b")
    return e.where((a.isNull() & b.isNull()) | (a.isNull() & (v > b)) | (b.isNull() & (v > a)) | ((v >= a) & (v >= b))).select("event_id", "value")


# Samples

SHUFFLED = "md5('0:' || pind)"


@query(f"""SELECT pind FROM (SELECT pind, row_number() OVER (ORDER BY updatecnt, {SHUFFLED}, pind) AS k, round(0.1 * count(*) OVER ()) AS n FROM ptcl WHERE state > 0) WHERE k <= n""")
def sample4update_cnt(spark, d):
    return R.sample_lowest(particles(spark, d), 0.1).select("pind")


@query("SELECT pind, sampled FROM ptcl WHERE state > 0 AND updatecnt > 0")
def sample4update_updated(spark, d):
    return particles(spark, d).where("state > 0 and updatecnt > 0").select("pind", "sampled")


@query(f"SELECT pind FROM (SELECT pind, row_number() OVER (ORDER BY {SHUFFLED}, pind) AS k FROM ptcl WHERE state > 0) WHERE k <= 200")
def select_particles_set(spark, d):
    return R.top(particles(spark, d).where("state > 0"), [R.shuffled(0), F.col("pind")], 200).select("pind")


@query("""SELECT pind, class, CASE WHEN (k - 1) // 4 < n // 4 THEN (k - 1) % 4 + 1 ELSE 0 END::INT AS part FROM
    (SELECT pind, class, row_number() OVER (PARTITION BY class ORDER BY corr DESC, pind) AS k, count(*) OVER (PARTITION BY class) AS n FROM ptcl WHERE state <> 0)""")
def sample_balanced_parts(spark, d):
    return R.deal(particles(spark, d), 4)


@query("SELECT pind, class, ntile(4) OVER (PARTITION BY class ORDER BY corr DESC, pind) AS part FROM ptcl WHERE state <> 0")
def sample_ranked_parts(spark, d):
    return R.blocks(particles(spark, d), 4)


@query(""", pop AS (SELECT class, count(*) AS n FROM ptcl WHERE state <> 0 GROUP BY class),
    q AS (SELECT min(k) AS k FROM (SELECT range AS k FROM range(0, 5000)) r WHERE (SELECT sum(least(n, r.k)) FROM pop) >= 300)
    SELECT pind, class FROM (SELECT pind, class, row_number() OVER (PARTITION BY class ORDER BY corr DESC, pind) AS place FROM ptcl WHERE state <> 0) WHERE place <= (SELECT k FROM q)""")
def sample_balanced(spark, d):
    return R.sample_balanced(particles(spark, d), 300).select("pind", "class")


@query("SELECT * FROM (SELECT pind, class, corr, row_number() OVER (PARTITION BY class ORDER BY corr DESC, pind) AS place FROM ptcl) WHERE place <= 3")
def top_per_class(spark, d):
    return R.top_in_group(particles(spark, d), "class", [F.desc("corr"), F.col("pind")], 3).select("pind", "class", "corr", "place")


@query("SELECT pind, corr FROM (SELECT pind, corr, row_number() OVER (ORDER BY dfx, pind) AS k FROM ptcl) WHERE k <= 25")
def minnloc(spark, d):
    return R.top(particles(spark, d), [F.col("dfx"), F.col("pind")], 25).select("pind", "corr")


# Sets and shapes


@query("SELECT row_number() OVER (PARTITION BY okey ORDER BY pind) AS indstk, okey, pind AS was, count(*) OVER (PARTITION BY okey) AS nptcls FROM ptcl WHERE state > 0")
def prune_particles(spark, d):
    return S.prune(particles(spark, d))


@query("""SELECT okey, nptcls, (sum(nptcls) OVER (ORDER BY okey) - nptcls + 1)::BIGINT AS fromp, (sum(nptcls) OVER (ORDER BY okey))::BIGINT AS top FROM (SELECT okey, count(*) AS nptcls FROM ptcl WHERE state > 0 GROUP BY okey)""")
def repair_stack_ranges(spark, d):
    """New contiguous ranges after pruning, from numbered kept particles."""
    kept = positions(particles(spark, d).where("state > 0").select("okey", F.col("pind").alias("was")), ["was"])
    return stacks(kept).select("okey", "nptcls", "fromp", "top")


@query("""SELECT s.okey, s.fromp, s.top, 1 AS project FROM stk s UNION ALL SELECT s.okey, s.fromp + n, s.top + n, 2 FROM stk s, (SELECT count(*) AS n FROM ptcl)""")
def merge_projects(spark, d):
    p = particles(spark, d).withColumn("stkind", F.col("okey"))
    s = stacks(p).select(F.col("okey").alias("istk"), "fromp", "top", F.lit(1).alias("ogid"), "okey")
    a, b = s.withColumn("project", F.lit(1)), s.withColumn("project", F.lit(2))
    return S.merge_projects([(a, p), (b, p)])[0].select("okey", "fromp", "top", "project")


@query("SELECT pind, r.range AS copy FROM ptcl, range(1, 4) r")
def symmetrize(spark, d):
    return S.symmetrize(particles(spark, d).select("pind"), 3).select("pind", F.col("copy").cast("long").alias("copy"))


@query("""SELECT round((SELECT count(*) FROM (SELECT DISTINCT class FROM ptcl WHERE state = 1 INTERSECT SELECT DISTINCT class FROM ptcl WHERE state = 2 AND corr > 0.09)) /
    least((SELECT count(DISTINCT class) FROM ptcl WHERE state = 1), (SELECT count(DISTINCT class) FROM ptcl WHERE state = 2 AND corr > 0.09))::DOUBLE, 6) AS overlap""")
def overlap(spark, d):
    p = particles(spark, d, False)
    return S.overlap(p.where("state = 1"), p.where("state = 2 and corr > 0.09"), "class")


@query(""", pop AS (SELECT class, count(*) AS n FROM ptcl WHERE state = 2 GROUP BY class), m AS (SELECT class, row_number() OVER (ORDER BY class) AS new FROM pop WHERE n > 1)
    SELECT p.pind, CASE WHEN (SELECT count(*) FROM pop) = (SELECT max(class) FROM ptcl) THEN class ELSE coalesce(m.new, 0) END AS class,
    CASE WHEN state <> 2 THEN 0 WHEN (SELECT count(*) FROM pop) = (SELECT max(class) FROM ptcl) THEN 2 WHEN m.new IS NULL THEN 0 ELSE 2 END AS state FROM ptcl p LEFT JOIN m USING (class)""")
def remap_cls(spark, d):
    """Classes without a particle of state 2 count as empty; all rows stay."""
    p = particles(spark, d).withColumn("state", F.when(F.col("state") == 2, 2).otherwise(0))
    return R.compact_labels(p, "class", int(p.agg(F.max("class")).first()[0])).select("pind", "class", "state")


@query(f"""SELECT p.pind, CASE WHEN h.k = 2 THEN (SELECT max(class) + 1 FROM ptcl) ELSE class END AS class FROM ptcl p LEFT JOIN (SELECT pind, ntile(2) OVER (ORDER BY {SHUFFLED}, pind) AS k FROM ptcl WHERE class = 2) h USING (pind)""")
def split_class(spark, d):
    return R.split_group(particles(spark, d), "class", 2).select("pind", "class")


# Scalars


@query("""SELECT page_id, split_part(url, '/', 3) AS host, upper(url) AS up, length(url) AS n, coalesce(trim(split_part(url, ',', 2)), '') AS field2, lpad(page_id::VARCHAR, 8, '0') AS padded,
    regexp_replace(url, '[ -+\\-./:-@\\[-^{-~]', '', 'g') AS plain FROM pages""".replace("\\\\", "\\"), base=False)
def string_functions(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.get(F.split(u, "/"), F.lit(2)).alias("host"), F.upper(u).alias("up"), F.length(u).cast("long").alias("n"), C.csv_field(u, 2).alias("field2"), F.lpad(F.col("page_id").cast("string"), 8, "0").alias("padded"), C.remove_punctuation(u).alias("plain"))


@query(r"""SELECT doc_id, CASE WHEN trim(text, ' ') = '' OR starts_with(trim(text, ' '), '#') THEN 0 ELSE len(list_filter(regexp_split_to_array(trim(text, ' '), '\s+'), lambda x: x <> '')) END AS tokens FROM documents""", base=False)
def cnt_recs_per_line(spark, d):
    return table(spark, d, "documents").select("doc_id", C.count_tokens(F.col("text")).cast("long").alias("tokens"))


@query("SELECT pind, class, state, corr, updatecnt FROM ptcl")
def text_round_trip(spark, d):
    p = particles(spark, d)
    return from_lines(to_lines(p, ["pind", "class", "state", "corr", "updatecnt"]), {"pind": "long", "class": "long", "state": "int", "corr": "double", "updatecnt": "int"})


@query("SELECT pind, (2 * ceil((corr * 100 - 1) / 2))::BIGINT AS even, round(CASE WHEN corr = 0 THEN 1 ELSE sin(corr) / corr END, 9) AS sinc, round(exp(-((corr - 0.05) ** 2) / 0.02) / sqrt(2 * pi() * 0.01), 6) AS gauss FROM ptcl")
def math_functions(spark, d):
    c = F.col("corr")
    return particles(spark, d).select("pind", C.round_to_even(c * 100).alias("even"), F.round(C.sinc(c), 9).alias("sinc"), F.round(C.gaussian(c, 0.05, 0.01), 6).alias("gauss"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS power, round(list_max(embedding)::DOUBLE, 6) AS most FROM embeddings", base=False)
def array_norms(spark, d):
    sq = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(sq, 4).alias("power"), F.round(F.array_max("embedding").cast("double"), 6).alias("most"))


# Streams, as batches


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, count(*) AS n, min(ts) AS begin, max(ts) AS last FROM s GROUP BY user_id, k""", base=False)
def idle_sessions(spark, d):
    return sessions(table(spark, d, "events"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS begin, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL", base=False)
def hourly_rates(spark, d):
    return rates(table(spark, d, "events")).withColumn("begin", F.col("begin").cast("timestamp_ntz"))


@query("""WITH RECURSIVE r AS (SELECT event_type AS key, event_id AS id, (user_id % 7 + 1) AS n, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, count(*) OVER (PARTITION BY event_type) AS many FROM events),
    f AS (SELECT key, k, many, n AS total, 1 AS chunk, n > 40 AS shut FROM r WHERE k = 1
        UNION ALL SELECT r.key, r.k, r.many, CASE WHEN f.shut THEN r.n ELSE f.total + r.n END, f.chunk + f.shut::INT, CASE WHEN f.shut THEN r.n ELSE f.total + r.n END > 40 FROM f JOIN r ON r.key = f.key AND r.k = f.k + 1)
    SELECT f.key, f.chunk::INT AS chunk, string_agg(r.id, ',' ORDER BY r.k) AS records, max(f.total)::BIGINT AS total, NOT bool_or(f.shut) AS final FROM f JOIN r USING (key, k) GROUP BY f.key, f.chunk""", base=False)
def count_chunks(spark, d):
    """Chunks closed by the record that takes their sum over the limit, for each event type."""
    e = table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("record_id"), (F.col("user_id") % 7 + 1).alias("n"))
    return chunks_of(e, 40).withColumn("records", F.array_join("records", ","))


from tabulon.plans import more  # noqa: E402, F401  registers further queries
