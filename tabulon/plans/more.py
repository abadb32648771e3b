"""Further queries: samplers, transfers, angles, records, scalings, projects. Each has the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from tabulon.functions import angles as G
from tabulon.functions import columns as C
from tabulon.functions import records as T
from tabulon.operators import aggregate as A
from tabulon.operators import clusters as K
from tabulon.operators import edit as E
from tabulon.operators import join as J
from tabulon.operators import rank as R
from tabulon.operators import reshape as S
from tabulon.operators import robust as B
from tabulon.operators import sampling as M
from tabulon.operators import series as V
from tabulon.operators import transfer as X
from tabulon.plans.queries import query
from tabulon.sources import project as PR
from tabulon.sources.adapter import classes, directions, micrographs, particles, poses, positions, stacks
from tabulon.session import scratch, table


def shuffle_sql(seed: int) -> str:
    return f"md5('{seed}:' || pind)"


def uniform_sql(seed: int, key: str = "pind") -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


# Samplers


@query("SELECT pind FROM ptcl WHERE state > 0 AND (updatecnt > 0 OR (SELECT max(updatecnt) FROM ptcl WHERE state > 0) <= 0)")
def sample4rec(spark, d):
    return M.for_reconstruction(particles(spark, d)).select("pind")


@query("SELECT pind, updatecnt + (state > 0)::INT AS updatecnt, CASE WHEN state > 0 THEN (SELECT max(sampled) + 1 FROM ptcl) ELSE sampled END AS sampled FROM ptcl")
def sample4update_all(spark, d):
    """All active rows; their counts and generation after the update."""
    p = particles(spark, d)
    return M.marked(p, p.where(M.ACTIVE)).select("pind", "updatecnt", "sampled")


@query(f"SELECT pind FROM (SELECT pind, row_number() OVER (ORDER BY {shuffle_sql(3)}, pind) AS k, count(*) OVER () AS n FROM ptcl WHERE state > 0) WHERE k <= greatest(1, round(0.2 * n))")
def sample4update_rnd(spark, d):
    return M.random_part(particles(spark, d), 0.2, seed=3).select("pind")


@query("SELECT pind FROM ptcl WHERE state > 0 AND sampled = (SELECT max(sampled) FROM ptcl)")
def sample4update_reprod(spark, d):
    return M.latest_generation(particles(spark, d)).select("pind")


@query(f"SELECT pind FROM (SELECT pind, row_number() OVER (ORDER BY updatecnt, {shuffle_sql(1)}, pind) AS k, count(*) OVER () AS n FROM ptcl WHERE state > 0) WHERE k <= greatest(1, round(0.3 * n))")
def sample4update_fillin(spark, d):
    return M.fill_in(particles(spark, d), 0.3, seed=1).select("pind")


@query("SELECT pind FROM ptcl WHERE state > 0 AND updatecnt = 0")
def sample4update_missing(spark, d):
    return M.missing(particles(spark, d)).select("pind")


def quota_sql(n: str) -> str:
    return f"""pop AS (SELECT class, count(*) AS n FROM ptcl WHERE state > 0 GROUP BY class),
    q AS (SELECT class, n, least(n, (SELECT min(k) FROM (SELECT range AS k FROM range(0, 5000)) r WHERE (SELECT sum(least(n, r.k)) FROM pop) >= {n})) AS quota FROM pop)"""


@query(f""", {quota_sql('(SELECT round(0.2 * count(*)) FROM ptcl WHERE state > 0)')},
    b AS (SELECT p.*, q.n, q.quota, row_number() OVER (PARTITION BY class ORDER BY corr DESC, pind) AS r FROM ptcl p JOIN q USING (class) WHERE state > 0),
    e AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY updatecnt, {shuffle_sql(5)}, pind) AS k FROM b WHERE r <= least(n, greatest(quota, floor(0.5 * n + 0.5))))
    SELECT pind, class FROM e WHERE k <= quota""")
def sample4update_class(spark, d):
    """Of the best half of each class those of the lowest updatecnt, with round-robin quotas."""
    p = particles(spark, d)
    return M.by_class(p, int(0.2 * p.where(M.ACTIVE).count() + 0.5), best=0.5, tiers=True, seed=5).select("pind", "class")


@query(f""", {quota_sql('400')}, b AS (SELECT p.*, q.n, q.quota, row_number() OVER (PARTITION BY class ORDER BY corr DESC, pind) AS r FROM ptcl p JOIN q USING (class) WHERE state > 0),
    e AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {shuffle_sql(2)}, pind) AS k FROM b WHERE r <= least(n, greatest(quota, floor(0.4 * n + 0.5)))) SELECT pind, class FROM e WHERE k <= quota""")
def sample_balanced_best(spark, d):
    return M.by_class(particles(spark, d), 400, best=0.4, seed=2).select("pind", "class")


@query(f""", {quota_sql('400')}, b AS (SELECT p.*, q.n, q.quota, row_number() OVER (PARTITION BY class ORDER BY corr, pind DESC) AS r FROM ptcl p JOIN q USING (class) WHERE state > 0),
    e AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {shuffle_sql(2)}, pind) AS k FROM b WHERE r <= least(n, greatest(quota, floor(0.4 * n + 0.5)))) SELECT pind, class FROM e WHERE k <= quota""")
def sample_balanced_inv(spark, d):
    return M.by_class(particles(spark, d), 400, worst=0.4, seed=2).select("pind", "class")


@query("SELECT pind, updatecnt + (class = 2)::INT AS updatecnt, CASE WHEN class = 2 THEN (SELECT max(sampled) + 1 FROM ptcl) ELSE sampled END AS sampled FROM ptcl")
def incr_sampled_updatecnt(spark, d):
    p = particles(spark, d)
    return M.marked(p, p.where("class = 2")).select("pind", "updatecnt", "sampled")


@query("SELECT pind, CASE WHEN class = 2 THEN 1 ELSE 0 END AS updatecnt FROM ptcl")
def set_updatecnt(spark, d):
    p = particles(spark, d)
    return M.set_updates(p, p.where("class = 2"), 1).select("pind", "updatecnt")


@query(f"""SELECT pind, class, (row_number() OVER (PARTITION BY class ORDER BY pind) - 1) % 3 + 1 AS part FROM (SELECT pind, class, row_number() OVER (PARTITION BY class ORDER BY {shuffle_sql(0)}, pind) AS k FROM ptcl WHERE state > 0)
    JOIN (WITH {quota_sql('300')} SELECT class, quota FROM q) USING (class) WHERE k <= quota""")
def sample_classes(spark, d):
    """The sampling verb: a balanced sample, dealt to three parts."""
    s = M.by_class(particles(spark, d), 300)
    return s.select("pind", "class", ((F.row_number().over(W.Window.partitionBy("class").orderBy("pind")) - 1) % 3 + 1).alias("part"))


@query(f"SELECT pind, row_number() OVER (ORDER BY {shuffle_sql(0)}, pind) AS place FROM ptcl")
def shuffle(spark, d):
    return M.shuffled_ids(particles(spark, d))


@query(f"SELECT pind, (row_number() OVER (ORDER BY {shuffle_sql(4)}, pind) - 1) % 5 + 1 AS label FROM ptcl")
def balanced(spark, d):
    return M.balanced_labels(particles(spark, d), 5, seed=4)


@query(f"SELECT pind, CASE WHEN r <= 0.5 THEN 2 WHEN r <= 0.8 THEN 3 WHEN r <= 1.0 THEN 1 ELSE 1 END AS which FROM (SELECT pind, {uniform_sql(6)} AS r FROM ptcl)")
def multinomal(spark, d):
    return particles(spark, d).select("pind", M.drawn_index([0.2, 0.5, 0.3], R.uniform(6)).alias("which"))


@query(f"SELECT pind, CASE WHEN r <= 1 / s THEN 2 WHEN r <= (1 + exp(-0.5)) / s THEN 4 ELSE 1 END AS which FROM (SELECT pind, {uniform_sql(7)} AS r, 1 + exp(-0.5) + exp(-1.0) AS s FROM ptcl)")
def sample_likelihood_dist(spark, d):
    return particles(spark, d).select("pind", M.likelihood_draw([1.5, 0.5, 4.0, 1.0, 3.0], 3, R.uniform(7)).alias("which"))


@query(", r AS (SELECT okey, nptcls, sum(nptcls) OVER (ORDER BY md5('0:' || okey), okey) AS cum FROM stk) SELECT okey, nptcls FROM (SELECT okey, nptcls, sum(nptcls) OVER (ORDER BY " + uniform_sql(0, "okey") + ", okey) AS cum FROM stk) WHERE cum - nptcls < 500")
def uniform_stack_sampling(spark, d):
    return M.stacks_up_to(stacks(particles(spark, d)).withColumn("cnt", F.lit(0)), 500)


@query(", c AS (SELECT okey, count(*) AS nptcls, sum(updatecnt) AS cnt FROM ptcl GROUP BY okey), k AS (SELECT okey, nptcls, ((1.0 + cnt - min(cnt) OVER ()) / (1.0 + max(cnt) OVER () - min(cnt) OVER ())) ** 0.1 - " + uniform_sql(0, "okey") + " AS v FROM c) SELECT okey, nptcls FROM (SELECT okey, nptcls, sum(nptcls) OVER (ORDER BY v, okey) AS cum FROM k) WHERE cum - nptcls < 500")
def biased_stack_sampling(spark, d):
    s = particles(spark, d).groupBy("okey").agg(F.count("*").alias("nptcls"), F.sum("updatecnt").alias("cnt"))
    return M.stacks_up_to(s, 500, bias=True)


@query(f"SELECT pind, (floor({uniform_sql(8)} * 100) + 1)::BIGINT AS number FROM ptcl")
def ran_iarr(spark, d):
    return particles(spark, d).select("pind", (F.floor(R.uniform(8) * 100) + 1).alias("number"))


# Edits


@query("SELECT pind, class FROM ptcl WHERE corr > 0.05")
def extract_subspace(spark, d):
    p = particles(spark, d)
    return E.masked(p, p.select("pind", (F.col("corr") > 0.05).alias("mask"))).select("pind", "class")


@query("SELECT * EXCLUDE (corr) FROM ptcl")
def delete_entry(spark, d):
    return E.without_columns(particles(spark, d), ["corr"])


@query("SELECT * EXCLUDE (sampled, updatecnt) FROM ptcl")
def clean_entry(spark, d):
    return E.without_columns(particles(spark, d), ["sampled", "updatecnt"])


@query("SELECT pind, CASE WHEN state = 1 THEN dfy * 2 ELSE corr END AS corr FROM ptcl")
def set_all(spark, d):
    p = particles(spark, d)
    return E.set_column(p, "corr", p.where("state = 1").select("pind", (F.col("dfy") * 2).alias("value"))).select("pind", "corr")


@query("SELECT pind, 7 AS class, 0.0::DOUBLE AS corr FROM ptcl")
def set_all2single(spark, d):
    return E.set_constant(E.set_constant(particles(spark, d), "class", 7), "corr", 0.0).select("pind", "class", "corr")


@query("SELECT pind, round(x * 0.5, 6) AS x, round(y * 0.5, 6) AS y FROM pose")
def mul_shifts(spark, d):
    return E.scaled_shifts(poses(particles(spark, d)), 0.5).select("pind", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT pind, round(x) + 0.0 AS x, round(y) + 0.0 AS y FROM (SELECT pind, round(x, 6) AS x, round(y, 6) AS y FROM pose)")
def round_shifts(spark, d):
    p = poses(particles(spark, d)).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})
    return E.rounded_shifts(p).select("pind", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"))


@query("SELECT pind, round(360 - e3, 6) AS e3 FROM pose")
def e3swapsgn(spark, d):
    return E.turned_inplane(poses(particles(spark, d))).select("pind", F.round("e3", 6).alias("e3"))


@query("SELECT pind, round(e3, 6) AS e1, round(e1, 6) AS e3 FROM pose")
def swape1e3(spark, d):
    return E.swapped_angles(poses(particles(spark, d))).select("pind", F.round("e1", 6).alias("e1"), F.round("e3", 6).alias("e3"))


@query("SELECT pind, updatecnt AS class FROM ptcl")
def proj2class(spark, d):
    return E.copied(particles(spark, d), "updatecnt", "class").select("pind", "class")


@query("SELECT pind, CASE WHEN dfx > 50000 THEN 0 ELSE state END AS state, CASE WHEN dfx > 50000 THEN 0.0 ELSE corr END AS corr FROM ptcl")
def reject(spark, d):
    p = particles(spark, d)
    return E.rejected(p, p.where("dfx > 50000")).select("pind", "state", "corr")


@query("SELECT false AS virgin, true AS valid, true AS isthere")
def is_virgin_field(spark, d):
    return E.has_values(poses(particles(spark, d)), ["e1", "e2", "e3", "x", "y"])


@query("SELECT imic, okey FROM mic WHERE mic_state > 0")
def write_mic_filetab(spark, d):
    return micrographs(spark, d).where("mic_state > 0").select("imic", "okey")


# Transfers


@query("SELECT pind, CASE WHEN c.icls IS NULL THEN 0 ELSE c.cls_state END AS state FROM ptcl LEFT JOIN cls c ON c.icls = class")
def map_cavgs_selection(spark, d):
    return X.class_selection([particles(spark, d)], classes(spark, d))[0].select("pind", "state")


@query("SELECT pind, round(x, 6) AS x, round(y, 6) AS y FROM pose")
def map2dshifts23d(spark, d):
    p = poses(particles(spark, d))
    blank = p.withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    return X.copied_by_row(blank, p, ["x", "y"]).select("pind", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT a.pind, CASE WHEN a.state > 0 THEN a.corr ELSE 0.0 END AS corr, CASE WHEN a.state > 0 THEN a.class ELSE 0 END AS class FROM ptcl a")
def transfer_2dparams(spark, d):
    p = particles(spark, d)
    blank = p.withColumns({"corr": F.lit(0.0), "class": F.lit(0).cast("long")})
    return X.copied_by_row(blank, p.where("state > 0"), ["corr", "class"]).select("pind", "corr", "class")


@query("SELECT pind, class FROM ptcl")
def transfer_class_assignment(spark, d):
    p = particles(spark, d)
    return X.copied_by_row(p.withColumn("class", F.lit(0).cast("long")), p, ["class"]).select("pind", "class")


def numbered_stacks(spark, d):
    return positions(stacks(particles(spark, d)), ["okey"], "istk")


NSTK = "nstk AS (SELECT *, row_number() OVER (ORDER BY okey) AS istk FROM stk)"


@query(f", {NSTK} SELECT imic, istk FROM mic JOIN nstk USING (okey) WHERE mic.nptcls > 0")
def get_mic2stk_inds(spark, d):
    return X.micrograph_stacks(micrographs(spark, d), numbered_stacks(spark, d))


@query(f", {NSTK} SELECT pind, istk, pind - fromp + 1 AS indstk, 'mic_' || lpad(okey::VARCHAR, 7, '0') AS micname FROM ptcl JOIN nstk USING (okey)")
def get_micname(spark, d):
    return X.micrograph_of(particles(spark, d), numbered_stacks(spark, d), micrographs(spark, d), F.concat(F.lit("mic_"), F.lpad(F.col("okey").cast("string"), 7, "0")))


@query("SELECT pind, CASE WHEN mic_state = 0 THEN 0 ELSE state END AS state FROM ptcl JOIN mic USING (okey)")
def report_state2mic(spark, d):
    return X.state_down(particles(spark, d), micrographs(spark, d), "mic_state").select("pind", "state")


@query("SELECT pind, CASE WHEN nptcls < 3 THEN 0 ELSE state END AS state FROM ptcl JOIN stk USING (okey)")
def report_state2stk(spark, d):
    p = particles(spark, d)
    s = stacks(p).withColumn("stk_state", F.when(F.col("nptcls") < 3, 0).otherwise(1))
    return X.state_down(p, s, "stk_state").select("pind", "state")


@query("SELECT pind, CASE WHEN state > 0 THEN dfx ELSE ogid * 1.5 END AS dfx FROM ptcl JOIN mic USING (okey)")
def get_ctfparams(spark, d):
    p = particles(spark, d).withColumn("dfx", F.when(F.col("state") > 0, F.col("dfx")))
    return X.optics_parameters(p, micrographs(spark, d).withColumn("dfx", F.col("ogid") * 1.5), ["dfx"])


NORMAL = "round(sin(radians({b})) * cos(radians({a})), 15)"
DOT = "round(sin(radians(r.e2)) * cos(radians(r.e1)) * sin(radians(p.e2)) * cos(radians(p.e1)) + sin(radians(r.e2)) * sin(radians(r.e1)) * sin(radians(p.e2)) * sin(radians(p.e1)) + cos(radians(r.e2)) * cos(radians(p.e2)), 9)"


@query(f"SELECT pind, iproj AS proj, round(acos(least(1, greatest(-1, dd))), 5) AS angle FROM (SELECT pind, iproj, dd, row_number() OVER (PARTITION BY pind ORDER BY dd DESC, iproj) AS k FROM (SELECT p.pind, r.iproj, {DOT} AS dd FROM pose p, dir r)) WHERE k = 1")
def set_projs(spark, d):
    return X.closest_direction(poses(particles(spark, d)), directions(spark, d)).select("pind", F.col("proj").cast("long").alias("proj"), F.round("angle", 5).alias("angle"))


@query(f"SELECT iproj, string_agg(j, ',' ORDER BY k) AS near FROM (SELECT p.iproj, r.iproj AS j, row_number() OVER (PARTITION BY p.iproj ORDER BY {DOT} DESC, r.iproj) AS k FROM dir p, dir r) WHERE k <= 4 GROUP BY iproj")
def nearest_proj_neighbors(spark, d):
    r = directions(spark, d)
    return X.near_directions(r, r, 4).select("iproj", F.array_join("near", ",").alias("near"))


@query(f"SELECT iproj, string_agg(j, ',' ORDER BY j) AS near FROM (SELECT p.iproj, r.iproj AS j, {DOT} AS dd FROM dir p, dir r) WHERE degrees(acos(least(1, greatest(-1, dd)))) <= 40 GROUP BY iproj")
def nearest_proj_neighbors_within(spark, d):
    r = directions(spark, d)
    return X.directions_within(r, r, 40.0).select("iproj", F.array_join("near", ",").alias("near"))


@query(f"SELECT pind, e1, e2 FROM (SELECT pind, r.e1, r.e2, row_number() OVER (PARTITION BY pind ORDER BY {DOT} DESC, iproj) AS k FROM pose p, dir r) WHERE k = 1")
def replace_with_closest(spark, d):
    return X.replaced_by_closest(poses(particles(spark, d)), directions(spark, d)).select("pind", "e1", "e2")


@query("SELECT page_id, url FROM pages WHERE split_part(url, '/', -1) NOT IN (SELECT split_part(url, '/', -1) FROM pages WHERE page_id % 2 = 0)", base=False)
def is_past(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return X.new_files(p, p.where("page_id % 2 = 0"), "url")


@query("SELECT i, j, ntile(4) OVER (ORDER BY i, j) AS part FROM (SELECT a.range AS i, b.range AS j FROM range(1, 61) a JOIN range(1, 61) b ON a.range < b.range)", base=False)
def split_pairs_in_parts(spark, d):
    return X.pair_parts(60, 4, spark)


# Angles


def m_sql(a: str, b: str, c: str) -> list[str]:
    sa, ca, sb, cb, sc, cc = (f"{f}(radians({x}))" for x in (a, b, c) for f in ("sin", "cos"))
    return [f"({x})" for x in (f"{cb}*{cc}*{ca}-{sc}*{sa}", f"{cb}*{cc}*{sa}+{sc}*{ca}", f"-{sb}*{cc}", f"-{cb}*{sc}*{ca}-{cc}*{sa}", f"{cc}*{ca}-{cb}*{sc}*{sa}", f"{sb}*{sc}", f"{sb}*{ca}", f"{sb}*{sa}", f"{cb}")]


def product_sql(a: list[str], b: list[str]) -> list[str]:
    return ["(" + "+".join(f"{a[3 * i + k]}*{b[3 * k + j]}" for k in range(3)) + ")" for i in range(3) for j in range(3)]


OTHER = ("30.0", "40.0", "50.0")


def other():
    return tuple(F.lit(float(x)) for x in OTHER)


def own():
    return tuple(F.col(c) for c in ("e1", "e2", "e3"))


@query("SELECT pind, " + ", ".join(f"round({x}, 6) + 0.0 AS r{i}" for i, x in enumerate(m_sql("e1", "e2", "e3"))) + " FROM pose")
def euler2m(spark, d):
    return poses(particles(spark, d)).select("pind", *((F.round(x, 6) + 0.0).alias(f"r{i}") for i, x in enumerate(G.matrix(own()))))


@query("SELECT pind, CASE WHEN e2 = 0 THEN round((e1 + e3) % 360, 4) % 360 ELSE round(e1 % 360, 4) % 360 END AS a, round(e2, 4) AS b, CASE WHEN e2 = 0 THEN 0 ELSE round(e3, 4) % 360 END AS c FROM pose")
def m2euler(spark, d):
    """The angles of each pose's matrix: its own angles again, and at the pole their sum."""
    a, b, c = G.angles(G.matrix(own()))
    wrap = lambda x: F.round(x, 4) % 360
    return poses(particles(spark, d)).select("pind", wrap(a).alias("a"), F.round(b, 4).alias("b"), wrap(c).alias("c"))


@query(f"SELECT pind, round(acos(greatest(-1, least(1, sin(radians(e2)) * cos(radians(e1)) * sin(radians({OTHER[1]})) * cos(radians({OTHER[0]})) + sin(radians(e2)) * sin(radians(e1)) * sin(radians({OTHER[1]})) * sin(radians({OTHER[0]})) + cos(radians(e2)) * cos(radians({OTHER[1]}))))), 5) AS dist, round(acos(greatest(-1, least(1, cos(radians(e3 - {OTHER[2]}))))), 5) AS inplane FROM pose")
def euler_dist(spark, d):
    return poses(particles(spark, d)).select("pind", F.round(G.distance(own(), other()), 5).alias("dist"), F.round(G.inplane_distance(own(), other()), 5).alias("inplane"))


_C = product_sql(m_sql(*OTHER), m_sql("e1", "e2", "e3"))


_POLE = ["cos(t)", "sin(t)", "0", "-sin(t)", "cos(t)", "0", "0", "0", "1"]


@query(
    "SELECT pind, " + ", ".join(f"round(CASE WHEN m8 >= 0.9999999 THEN {x} ELSE m{i} END, 5) + 0.0 AS r{i}" for i, x in enumerate(_POLE))
    + " FROM (SELECT *, atan2(m1, m4) AS t FROM (SELECT pind, " + ", ".join(f"{x} AS m{i}" for i, x in enumerate(_C)) + " FROM pose))"
)
def euler_compose(spark, d):
    """The matrix of the composed angles: the product of the matrices; next to the pole, where angles keep no tilt, a turn about it."""
    a, b, c = G.composed(own(), other())
    p = poses(particles(spark, d)).select("pind", a.alias("e1"), b.alias("e2"), c.alias("e3"))
    return p.select("pind", *((F.round(x, 5) + 0.0).alias(f"r{i}") for i, x in enumerate(G.matrix(own()))))


@query("SELECT pind, " + ", ".join(f"round({x}, 5) + 0.0 AS r{i}" for i, x in enumerate(m_sql("e1", "(180 + e2)", "(180 - e3)"))) + " FROM pose")
def euler_mirror(spark, d):
    a, b, c = G.mirrored(own())
    p = poses(particles(spark, d)).select("pind", a.alias("e1"), b.alias("e2"), c.alias("e3"))
    return p.select("pind", *((F.round(x, 5) + 0.0).alias(f"r{i}") for i, x in enumerate(G.matrix(own()))))


_D = product_sql(m_sql("e1", "e2", "e3"), [m_sql(*OTHER)[3 * j + i] for i in range(3) for j in range(3)])


@query(f"SELECT pind, round(sqrt({' + '.join(f'({x} - {int(i in (0, 4, 8))}) ** 2' for i, x in enumerate(_D))}), 5) AS frob, round(acos(greatest(-1, least(1, ({_D[0]} + {_D[4]} + {_D[8]} - 1) / 2))), 4) AS turn FROM pose")
def geodesic_dist(spark, d):
    return poses(particles(spark, d)).select("pind", F.round(G.frobenius(own(), other()), 5).alias("frob"), F.round(G.rotation_angle(own(), other()), 4).alias("turn"))


@query("SELECT pind, round(acos(greatest(-1, least(1, max(sin(radians(e2)) * sin(radians(40)) * cos(radians(e1 - 30 - k.range * 120)) + cos(radians(e2)) * cos(radians(40)))))), 5) AS dist FROM pose, range(0, 3) k GROUP BY pind")
def sym_dists(spark, d):
    return poses(particles(spark, d)).select("pind", F.round(G.symmetry_distance(own(), other(), 3), 5).alias("dist"))


@query("SELECT pind, round(e1 % 90, 6) AS e1 FROM pose")
def rotall_to_asym(spark, d):
    return poses(particles(spark, d)).select("pind", F.round(G.into_unit(own(), 4)[0], 6).alias("e1"))


@query(f"SELECT pind, round((e1 + 120 * floor({uniform_sql(9)} * 3)) % 360, 6) AS e1 FROM pose")
def symrandomize(spark, d):
    return poses(particles(spark, d)).select("pind", F.round(F.pmod(F.col("e1") + 120 * F.floor(R.uniform(9) * 3), F.lit(360.0)), 6).alias("e1"))


@query("SELECT pind, round(x + CASE WHEN class = 2 THEN 3 * cos(radians(e3)) - 1 * sin(radians(e3)) ELSE 0 END, 5) AS x, round(y + CASE WHEN class = 2 THEN 3 * sin(radians(e3)) + 1 * cos(radians(e3)) ELSE 0 END, 5) AS y FROM pose")
def add_shift2class(spark, d):
    x, y = G.shifted_by(F.col("x"), F.col("y"), F.col("e3"), 3.0, 1.0)
    own = F.col("class") == 2
    return poses(particles(spark, d)).select("pind", F.round(F.when(own, x).otherwise(F.col("x")), 5).alias("x"), F.round(F.when(own, y).otherwise(F.col("y")), 5).alias("y"))


@query("SELECT class, round(avg(x * cos(radians(e3)) - y * sin(radians(e3))), 5) AS dx, round(avg(x * sin(radians(e3)) + y * cos(radians(e3))), 5) AS dy FROM pose WHERE state > 0 GROUP BY class")
def calc_avg_offset2d(spark, d):
    c, s = F.cos(F.radians("e3")), F.sin(F.radians("e3"))
    return poses(particles(spark, d)).where("state > 0").groupBy("class").agg(F.round(F.avg(F.col("x") * c - F.col("y") * s), 5).alias("dx"), F.round(F.avg(F.col("x") * s + F.col("y") * c), 5).alias("dy"))


# Records and scalars


@query("""SELECT page_id, replace(url, ' ', '') AS nosp, lower(url) AS low, contains(url, 'http') AS has, regexp_extract_all(url, '.') IS NOT NULL AS any, rpad(page_id::VARCHAR, 6, ' ') || '|' AS pad, printf('%.3f', page_id / 7.0) AS num,
    page_id % 3 = 0 AS same FROM pages""", base=False)
def string_forms(spark, d):
    u = F.col("url")
    third = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" "), F.upper(u))).otherwise(F.lit("other"))
    return table(spark, d, "pages").select("page_id", T.without_spaces(u).alias("nosp"), F.lower(u).alias("low"), F.contains(u, F.lit("http")).alias("has"), F.lit(True).alias("any"), F.concat(T.padded(F.col("page_id").cast("string"), 6), F.lit("|")).alias("pad"), T.real_text(F.col("page_id") / 7.0, 3).alias("num"), T.same_text(u, third, any_case=True).alias("same"))


@query("SELECT pind, class + state AS total, 3 AS n, CASE WHEN okey % 2 = 0 THEN 2 ELSE 0 END AS place FROM ptcl")
def list_of_ints(spark, d):
    p = particles(spark, d)
    many = T.number_list(F.concat_ws(", ", F.col("class").cast("string"), F.col("state").cast("string"), F.lit("0")))
    words = F.array(F.lit("odd"), F.when(F.col("okey") % 2 == 0, F.lit("even")).otherwise(F.lit("none")))
    return p.select("pind", F.aggregate(many, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(many).cast("long").alias("n"), T.place_of(words, F.lit("even")).alias("place"))


@query("SELECT page_id, length(regexp_replace(url, '[^0-9]', '', 'g')) AS digits FROM pages", base=False)
def map_str_nrs(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(F.filter(T.digits_of(F.col("url")), lambda x: x)).cast("long").alias("digits"))


@query("SELECT page_id, row_number() OVER (ORDER BY upper(trim(url)), page_id) AS place FROM pages", base=False)
def lex_sort(spark, d):
    p = table(spark, d, "pages").select("page_id", F.upper(F.trim("url")).alias("_k"))
    return positions(p, ["_k", "page_id"], "place").drop("_k")


@query("SELECT pind, 'class=' || class || ' pind=' || pind || ' state=' || state AS line, class::VARCHAR AS class FROM ptcl")
def chash2str(spark, d):
    m = T.row_map(["pind", "state", "class"])
    return particles(spark, d).select("pind", T.map_text(m).alias("line"), F.try_element_at(T.sorted_map(m), F.lit("class")).alias("class"))


@query("""SELECT pind, '{"pind":' || pind || ',"class":' || class || ',"state":' || state || '}' AS json, (class + state)::DOUBLE AS total FROM ptcl""")
def ori2json(spark, d):
    v = T.row_vector(["class", "state"])
    return particles(spark, d).select("pind", T.row_json(["pind", "class", "state"]).alias("json"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("SELECT pind, gcd(okey + 12, 36)::BIGINT AS g, round(corr * 2 - dfy * 3, 9) AS cx, round(CASE WHEN corr < 1e-12 THEN 3.4028235e38 ELSE -ln(corr) END, 6) AS eu, round(1 - corr, 9) AS cc, round(0.1 + 0.4 * (1 + cos(pi() * least(updatecnt, 3) / 3)), 9) AS decay FROM ptcl")
def scalar_forms(spark, d):
    c = F.col("corr")
    x = T.cross([F.lit(1.0), c, F.col("dfy")], [F.lit(0.0), F.lit(3.0), F.lit(2.0)])[0]
    return particles(spark, d).select("pind", T.gcd(F.col("okey") + 12, F.lit(36)).alias("g"), F.round(x, 9).alias("cx"), F.round(T.correlation_distance(c, True), 6).alias("eu"), F.round(T.correlation_distance(c, False), 9).alias("cc"), F.round(C.cos_decay(F.col("updatecnt"), 3, 0.1, 0.9), 9).alias("decay"))


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0A-\x1F]', '', 'g'), '[ \t]+', ' ', 'g'), ' '), '[,;]'), lambda x: true), '|') AS parts FROM documents", base=False)
def parsestr(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(C.parse(F.col("text"), ",;"), "|").alias("parts"))


@query("SELECT class, round(CASE WHEN sum(corr * corr) > 0 AND sum(dfy * dfy) > 0 THEN sum(corr * dfy) / sqrt(sum(corr * corr) * sum(dfy * dfy)) ELSE 0 END, 6) AS r FROM ptcl GROUP BY class")
def norm_corr(spark, d):
    a, b = F.col("corr"), F.col("dfy")
    return particles(spark, d, False).groupBy("class").agg(F.round(C.norm_corr(F.sum(a * b), F.sum(a * a), F.sum(b * b)), 6).alias("r"))


# Scalings, histograms, tests


@query("""SELECT event_id, round(CASE WHEN mad > 0 THEN (value - med) / (1.4826 * mad) ELSE 0 END, 5) AS z FROM events JOIN
    (SELECT event_type, med, median(abs(value - med)) AS mad FROM events JOIN (SELECT event_type, median(value) AS med FROM events GROUP BY 1) USING (event_type) GROUP BY 1, 2) USING (event_type)""", base=False)
def robust_z_scores(spark, d):
    return V.robust_z(table(spark, d, "events"), "value", "event_type").select("event_id", F.round("robust_z", 5).alias("z"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    q AS (SELECT event_type, any_value(n) AS n, median(value) AS med, min(value) FILTER (k = ceil(n / 4.0)) AS q1, min(value) FILTER (k = ceil(3 * n / 4.0)) AS q3 FROM r GROUP BY 1)
    SELECT event_id, round(CASE WHEN n >= 4 AND q3 > q1 THEN (value - med) / (q3 - q1) ELSE value END, 5) AS scaled FROM events JOIN q USING (event_type)""", base=False)
def robust_scaling(spark, d):
    return V.robust_scaled(table(spark, d, "events"), "value", "event_type").select("event_id", F.round("scaled", 5).alias("scaled"))


@query("SELECT event_id, round((exp((value - lo) / (hi - lo)) - 1) / (exp(1.0::DOUBLE) - 1), 6) AS s FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)", base=False)
def normalize_sigm(spark, d):
    e = table(spark, d, "events")
    lim = F.broadcast(e.agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    return e.join(lim).select("event_id", F.round(V.sigmoid_share((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))), 6).alias("s"))


@query("SELECT n, r, round((SELECT sum(1.0::DOUBLE / k.range) FROM range(1, 13) k WHERE k.range >= r) / n, 9) AS w FROM (SELECT 12 AS n, range AS r FROM range(1, 13))", base=False)
def rank_centroid_weights(spark, d):
    return spark.range(1, 13).select(F.lit(12).alias("n"), F.col("id").alias("r")).select("n", "r", F.round(V.centroid_weight(F.col("n").cast("long"), F.col("r")), 9).alias("w"))


@query("SELECT round(abs(avg(value) FILTER (user_id % 2 = 0) - avg(value) FILTER (user_id % 2 = 1)) / sqrt(0.5 * (stddev_samp(value) FILTER (user_id % 2 = 0) ** 2 + stddev_samp(value) FILTER (user_id % 2 = 1) ** 2)), 6) AS smd FROM events", base=False)
def std_mean_diff(spark, d):
    return V.standard_difference(table(spark, d, "events"), "value", F.col("user_id") % 2 == 1)


H10 = "h AS (SELECT floor(value / 10)::INT AS bin, count(*) AS cnt FROM events GROUP BY 1)"


def _tens(spark, d, where="true"):
    return table(spark, d, "events").where(where).groupBy(F.floor(F.col("value") / 10).cast("int").alias("bin")).agg(F.count("*").alias("cnt"))


@query(f"""WITH {H10}, m AS (SELECT sum(cnt) AS n, sum((bin * 10 + 5) * cnt) / sum(cnt) AS mean FROM h), v AS (SELECT any_value(n) AS n, any_value(mean) AS mean, sum((bin * 10 + 5 - mean) ** 2 * cnt) / any_value(n) AS var, sum((bin * 10 + 5 - mean) ** 3 * cnt) / any_value(n) AS third FROM h, m)
    SELECT n::BIGINT AS n, round(mean, 6) AS mean, round(var, 6) AS var, round(third / var ** 1.5, 5) AS skew, (SELECT (bin * 10 + 5)::DOUBLE FROM h ORDER BY cnt DESC, bin LIMIT 1) AS hmode FROM v""", base=False)
def histogram_moments(spark, d):
    return V.histogram_moments(_tens(spark, d), F.col("bin") * 10 + F.lit(5.0))


@query(f"WITH {H10} SELECT bin, cnt FROM h", base=False)
def histogram_add(spark, d):
    return V.merged_histograms([_tens(spark, d, f"event_id % 3 = {k}") for k in range(3)])


@query("SELECT CASE WHEN value <= 17.5 THEN 1 WHEN value <= 42.5 THEN 2 WHEN value <= 80 THEN 3 ELSE 4 END AS bin, count(*) AS cnt FROM events GROUP BY 1", base=False)
def histogram_centres(spark, d):
    return V.centred_bins(table(spark, d, "events"), "value", [10.0, 25.0, 60.0, 100.0])


@query(f"WITH {H10}, s AS (SELECT bin, cnt, (cnt + 0.5 * (coalesce(lag(cnt) OVER (ORDER BY bin), 0) + coalesce(lead(cnt) OVER (ORDER BY bin), 0))) / 2.0 AS v FROM h) SELECT bin, round(v * sum(cnt) OVER () / sum(v) OVER (), 6) AS cnt FROM s", base=False)
def histogram_smooth(spark, d):
    return V.smoothed(_tens(spark, d), 0.5)


@query("SELECT round((value - lo) / (hi - lo) * 7)::INT AS level, count(*) AS cnt, round(avg(value), 6) AS mean FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1", base=False)
def quantize_vec(spark, d):
    return V.quantized(table(spark, d, "events"), "value", 8)


@query("""SELECT event_id, round(coalesce((-3 * lag(value, 2) OVER w + 12 * lag(value) OVER w + 17 * value + 12 * lead(value) OVER w - 3 * lead(value, 2) OVER w) / 35, value), 6) AS smooth FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""", base=False)
def savitzky_golay(spark, d):
    return V.savitzky_golay(table(spark, d, "events"), "value", "user_id", ["ts", "event_id"]).select("event_id", F.round("smooth", 6).alias("smooth"))


@query("SELECT event_id, CASE WHEN value <= 15 THEN 1 WHEN value <= 35 THEN 2 ELSE 3 END AS near, (value >= 10)::INT + (value >= 20)::INT + (value >= 50)::INT AS below FROM events", base=False)
def locate(spark, d):
    f = V.nearest_of(F.col("value"), [10.0, 20.0, 50.0])
    return table(spark, d, "events").select("event_id", f["near"].alias("near"), f["below"].alias("below"))


@query("""WITH l AS (SELECT min(value) AS lo, max(value) AS hi FROM events), h AS (SELECT least(39, round((value - lo) * 40 / (hi - lo)))::INT AS b, count(*) AS n FROM events, l GROUP BY 1)
    SELECT round(lo + b * (hi - lo) / 40, 6) AS mode FROM l, (SELECT b FROM h ORDER BY n DESC, b LIMIT 1)""", base=False)
def mode(spark, d):
    return V.mode_of(table(spark, d, "events"), "value", 40)


@query("SELECT state, round(median(dfx), 6) AS med FROM ptcl GROUP BY state")
def median_by_state(spark, d):
    return B.median_by(particles(spark, d, False), "dfx", ["state"]).select("state", F.round("med", 6).alias("med"))


@query("SELECT class, count(*) AS n, round(avg(dfx), 5) AS avg, round(stddev_samp(dfx), 5) AS sdev, round(median(dfx), 5) AS med, round(min(dfx), 5) AS lo, round(max(dfx), 5) AS hi FROM ptcl WHERE corr > 0.02 GROUP BY class")
def calc_stats(spark, d):
    """Masked statistics of each class."""
    p = particles(spark, d, False).where("corr > 0.02")
    s = p.groupBy("class").agg(F.count("*").alias("n"), F.round(F.avg("dfx"), 5).alias("avg"), F.round(F.stddev_samp("dfx"), 5).alias("sdev"), F.round(F.min("dfx"), 5).alias("lo"), F.round(F.max("dfx"), 5).alias("hi"))
    return s.join(B.median_by(p, "dfx", ["class"]), "class").withColumn("med", F.round("med", 5))


@query("SELECT count(*) AS n, round(count(*) FILTER (sampled = (SELECT max(sampled) FROM ptcl)) / count(*)::DOUBLE, 6) AS frac FROM ptcl WHERE state > 0 AND updatecnt > 0")
def get_update_frac(spark, d):
    p = particles(spark, d, False)
    return p.where("state > 0 and updatecnt > 0").join(F.broadcast(p.agg(F.max("sampled").alias("_latest")))).agg(F.count("*").alias("n"), F.round(F.count_if(F.col("sampled") == F.col("_latest")) / F.count("*"), 6).alias("frac"))


@query(f", n AS (SELECT pind, state, corr, iproj FROM (SELECT p.pind, p.state, p.corr, iproj, row_number() OVER (PARTITION BY pind ORDER BY {DOT} DESC, iproj) AS k FROM pose p, dir r) WHERE k = 1) SELECT iproj AS proj, count(*) AS pop, min(pind) AS first, max(pind) AS last FROM n WHERE state <> 0 GROUP BY 1")
def get_proj_sample_stats(spark, d):
    near = X.closest_direction(poses(particles(spark, d)), directions(spark, d)).where("state <> 0")
    return near.groupBy(F.col("proj").cast("long").alias("proj")).agg(F.count("*").alias("pop"), F.min("pind").alias("first"), F.max("pind").alias("last"))


@query(", v AS (SELECT pind, state, 1 AS w FROM ptcl WHERE state > 0) SELECT pind, state, 1.0::DOUBLE AS agreement FROM v")
def state_consensus(spark, d):
    """Three labellings that differ by a permutation of the states agree throughout."""
    p = particles(spark, d).where("state > 0").select("pind", "state")
    return X.state_votes([p, p.withColumn("state", 3 - F.col("state")), p], 2)


# Sets and shapes


@query("SELECT class, count(*) AS n FROM (SELECT CASE WHEN class = 2 THEN 1 ELSE class END AS class FROM ptcl) GROUP BY class")
def merge_classes(spark, d):
    return particles(spark, d, False).withColumn("class", F.when(F.col("class") == 2, 1).otherwise(F.col("class"))).groupBy("class").agg(F.count("*").alias("n"))


@query(f"SELECT p.pind, CASE WHEN h.k = 2 THEN 3 ELSE state END AS state FROM ptcl p LEFT JOIN (SELECT pind, ntile(2) OVER (ORDER BY {shuffle_sql(0)}, pind) AS k FROM ptcl WHERE state = 1) h USING (pind)")
def split_state(spark, d):
    return R.split_group(particles(spark, d), "state", 1).select("pind", "state")


@query("SELECT pind, class FROM ptcl WHERE state = 1 UNION ALL SELECT pind + (SELECT max(pind) FROM ptcl), class FROM ptcl WHERE state = 2")
def append_tables(spark, d):
    p = particles(spark, d).select("pind", "class", "state")
    n = p.agg(F.max("pind").alias("_n"))
    moved = p.where("state = 2").join(F.broadcast(n)).withColumn("pind", F.col("pind") + F.col("_n")).drop("_n")
    return S.append(p.where("state = 1"), moved).select("pind", "class")


@query("SELECT okey, nptcls, ntile(5) OVER (ORDER BY okey) AS part FROM stk")
def split_stk(spark, d):
    s = numbered_stacks(spark, d)
    parts = R.even_parts(s.withColumnRenamed("istk", "pind"), 5, s.count())
    return s.join(parts.withColumnRenamed("pind", "istk"), "istk").select("okey", "nptcls", "part")


@query(f"SELECT pind, r.e1 AS e1, r.e2 AS e2 FROM (SELECT pind, iproj FROM (SELECT p.pind, iproj, row_number() OVER (PARTITION BY pind ORDER BY {DOT} DESC, iproj) AS k FROM pose p, dir r) WHERE k = 1) n JOIN dir r USING (iproj)")
def discretize(spark, d):
    return X.replaced_by_closest(poses(particles(spark, d)), directions(spark, d)).select("pind", "e1", "e2")


@query("SELECT pind, round(x * 2, 6) AS x, round(y * 2, 6) AS y FROM pose")
def scale_projfile(spark, d):
    return S.scaled(poses(particles(spark, d)), ["x", "y"], 2.0).select("pind", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# Projects


def _project(spark, d) -> str:
    path = scratch(spark, "project")
    p = particles(spark, d)
    PR.write_segment(p, path, "ptcl2D")
    PR.write_segment(stacks(p), path, "stk", "okey")
    return path


@query("SELECT pind, class, corr FROM ptcl WHERE pind BETWEEN 100 AND 900")
def read_segment(spark, d):
    return PR.read_segment(spark, _project(spark, d), "ptcl2D", (100, 900), ["pind", "class", "corr"])


@query("SELECT 'stk' AS segment, count(*) AS n, min(okey) AS first, max(okey) AS last, 4 AS fields FROM stk UNION ALL SELECT 'ptcl2D', count(*), min(pind), max(pind), 10 FROM ptcl")
def get_segments_info(spark, d):
    path = _project(spark, d)
    return PR.segments_info(spark, path, {"stk": "okey"})


@query("SELECT row_number() OVER (ORDER BY pind) AS pind, class, okey FROM ptcl WHERE class IN (1, 3)")
def extract_subproj(spark, d):
    path, out = _project(spark, d), scratch(spark, "subproject")
    PR.subproject(spark, path, out, particles(spark, d).where("class in (1, 3)"))
    return PR.read_segment(spark, out, "ptcl2D", columns=["pind", "class", "okey"])


@query("SELECT segment, problem, n FROM (SELECT 'stk' AS segment, 'range' AS problem, count(*) AS n FROM stk WHERE okey % 7 = 0) WHERE n > 0")
def validate_project(spark, d):
    """Every seventh stack's size is off by one; the check finds these."""
    path = _project(spark, d)
    s = stacks(particles(spark, d)).withColumn("nptcls", F.col("nptcls") + F.when(F.col("okey") % 7 == 0, 1).otherwise(0))
    PR.write_segment(s, path, "stk", "okey")
    return PR.problems(spark, path)


@query("SELECT url, CASE WHEN starts_with(url, 'https://') THEN 'file://' || substr(url, 9) ELSE url END AS moved FROM pages", base=False)
def remap_project_paths(spark, d):
    p = table(spark, d, "pages").select("url", F.col("url").alias("moved"))
    return PR.remapped(p, "moved", "https:/", "file:/")


# Clusters


@query("""WITH e AS (SELECT label, vec_id, i.range AS p, embedding[i.range]::DOUBLE AS x FROM embeddings, range(1, 65) i), c AS (SELECT label, p, avg(x) AS m FROM e GROUP BY ALL),
    s AS (SELECT label, sqrt(avg(d)) AS s FROM (SELECT e.label, vec_id, sum((x - m) ** 2) AS d FROM e JOIN c USING (label, p) GROUP BY ALL) GROUP BY label),
    m AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.m - b.m) ** 2)) AS dist FROM c a JOIN c b ON a.p = b.p AND a.label <> b.label GROUP BY ALL)
    SELECT round(avg(r), 6) AS dbindex FROM (SELECT a, max((x.s + y.s) / dist) AS r FROM m JOIN s x ON x.label = a JOIN s y ON y.label = b GROUP BY a)""", base=False)
def db_index(spark, d):
    return K.davies_bouldin(table(spark, d, "embeddings").select("label", F.col("embedding").alias("v")), "label")
