"""Queries over predictors and their scores, on event paths: trips with id % 5 = 0 are held out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import distributions as D
from ..operators import models as M
from ..operators import score as S
from ..operators import windows as W
from ..sources import tables as T
from .path_queries import HNG, RAMP, TEST, TRAIN
from .registry import WIN, matched, ngrams, query

SIZE = 5


def data(spark, sf, length: int = 5):
    ev = T.event_paths(spark, sf)
    return ev.where(TRAIN), W.samples(ev.where(TEST), length)


def dense(predicted):
    """ctx, node, p of all nodes, for comparison with SQL."""
    nodes = F.explode(F.sequence(F.lit(0), F.lit(SIZE - 1))).alias("node")
    rows = predicted.select(*[c for c in predicted.columns if c not in ("ctx", "size", "d")], P.text(F.col("ctx")).alias("ctx"), "d", nodes)
    return rows.withColumn("p", F.round(D.at(F.col("d"), F.col("node")), 6)).drop("d")


def predicted(spark, sf, highest, rule):
    train, windows = data(spark, sf)
    return M.prepare(train, windows, highest).select("ctx", "size", rule.alias("d"))


BACK = f"WITH {WIN}, "
OUT = "SELECT array_to_string(ctx, '-') AS ctx, node, round(p, 6) AS p FROM d"
UNI = "uni AS (SELECT nxt AS node, count(*) / sum(count(*)) OVER () AS p FROM (SELECT path[i+1] AS nxt FROM (SELECT path, unnest(range(1, len(path))) AS i FROM train)) GROUP BY nxt)"
ONE = "one AS (SELECT ctxs.ctx, nodes.node, CASE WHEN t.n IS NULL THEN 0.2 ELSE coalesce(m.cnt, 0) / t.n END AS p FROM ctxs CROSS JOIN nodes LEFT JOIN m ON m.ctx = ctxs.ctx AND m.k = 1 AND m.nxt = nodes.node LEFT JOIN (SELECT DISTINCT ctx, n FROM m WHERE k = 1) t ON t.ctx = ctxs.ctx)"


def sql_backoff(k: int) -> str:
    return f"""{ngrams(k)}, {matched(k)}, {UNI}, best AS (SELECT ctx, max(k) AS k FROM m GROUP BY ctx),
d AS (SELECT c.ctx, nodes.node, CASE WHEN b.k IS NULL THEN coalesce(u.p, 0) ELSE coalesce(m.cnt, 0) / t.n END AS p FROM ctxs c CROSS JOIN nodes LEFT JOIN best b ON b.ctx = c.ctx
  LEFT JOIN m ON m.ctx = c.ctx AND m.k = b.k AND m.nxt = nodes.node LEFT JOIN (SELECT DISTINCT ctx, k, n FROM m) t ON t.ctx = c.ctx AND t.k = b.k LEFT JOIN uni u ON u.node = nodes.node)"""


@query(f"{BACK}{sql_backoff(2)} {OUT}")
def mc_backoff_k2(spark, sf):
    return dense(predicted(spark, sf, 2, M.backoff(2)))


@query(f"{BACK}{sql_backoff(3)} {OUT}")
def mc_backoff_k3(spark, sf):
    return dense(predicted(spark, sf, 3, M.backoff(3)))


@query(f"{BACK}{sql_backoff(5)} {OUT}")
def mc_backoff_k5(spark, sf):
    return dense(predicted(spark, sf, 5, M.backoff(5)))


SQL_HW = f"""{ngrams(3)}, {matched(3)}, h AS (SELECT ctx, k, any_value(n) AS n, -sum(cnt / n * log2(cnt / n)) AS h FROM m GROUP BY ctx, k),
w AS (SELECT ctx, k, n / (n + 8.0) / (h + 1e-6) AS w FROM h), wn AS (SELECT ctx, k, w / sum(w) OVER (PARTITION BY ctx) AS w FROM w),
d AS (SELECT c.ctx, nodes.node, coalesce(sum(wn.w * m.cnt / m.n), 0) AS p FROM ctxs c CROSS JOIN nodes LEFT JOIN m ON m.ctx = c.ctx AND m.nxt = nodes.node LEFT JOIN wn ON wn.ctx = m.ctx AND wn.k = m.k GROUP BY c.ctx, nodes.node)"""


@query(f"{BACK}{SQL_HW} {OUT}")
def hwmc_k3(spark, sf):
    return dense(predicted(spark, sf, 3, M.weighted(3)))


def all_orders(k: int, least: str) -> str:
    """ok(ctx, k, n) of usable orders, and one."""
    return f"{ngrams(k)}, {matched(k)}, {ONE}, ok AS (SELECT DISTINCT ctx, k, n FROM m WHERE {least})"


SQL_AKOM = f"""{all_orders(3, 'n >= 3')}, ws AS (SELECT ctx, k, n, k / sum(k) OVER (PARTITION BY ctx) AS w FROM ok),
mixed AS (SELECT ws.ctx, nodes.node, sum(ws.w * (coalesce(m.cnt, 0) + 1e-3) / (ws.n + 5e-3)) AS p FROM ws CROSS JOIN nodes LEFT JOIN m ON m.ctx = ws.ctx AND m.k = ws.k AND m.nxt = nodes.node GROUP BY ws.ctx, nodes.node),
d AS (SELECT one.ctx, one.node, CASE WHEN mixed.p IS NULL THEN one.p ELSE 0.6 * one.p + 0.4 * mixed.p END AS p FROM one LEFT JOIN mixed USING (ctx, node))"""


@query(f"{BACK}{SQL_AKOM} {OUT}")
def akom_k3(spark, sf):
    return dense(predicted(spark, sf, 3, M.all_k(3)))


SQL_CPT = f"""{ngrams(5)}, {matched(5)}, {ONE}, g AS (SELECT ctx, k, nxt, cnt, sum(cnt) OVER (PARTITION BY ctx, k) AS n FROM m WHERE cnt >= 2), best AS (SELECT ctx, max(k) AS k FROM g GROUP BY ctx),
d AS (SELECT one.ctx, one.node, CASE WHEN best.k IS NULL THEN one.p ELSE 0.5 * one.p + 0.5 * coalesce(g.cnt / g.n, 0) END AS p FROM one LEFT JOIN best ON best.ctx = one.ctx LEFT JOIN g ON g.ctx = one.ctx AND g.k = best.k AND g.nxt = one.node)"""


@query(f"{BACK}{SQL_CPT} {OUT}")
def cpt_plus(spark, sf):
    return dense(predicted(spark, sf, 5, M.noise_filtered(5)))


SQL_MOGEN = f"""{ngrams(1)}, {matched(1)}, {ONE}, {RAMP},
s3 AS (SELECT ctx, k, ctx[len(ctx)-k+1:] AS s FROM ctxs, (SELECT unnest(range(1, 4)) AS k)), r AS (SELECT s3.ctx, s3.k, nxt, cnt, sum(cnt) OVER (PARTITION BY s3.ctx, s3.k) AS n FROM s3 JOIN ramp ON ramp.k = s3.k AND ramp.ctx = s3.s),
best AS (SELECT ctx, max(k) AS k FROM r WHERE k = 1 OR n >= 3 GROUP BY ctx), t AS (SELECT DISTINCT ctx, k, n FROM r),
d AS (SELECT one.ctx, one.node, CASE WHEN best.k IS NULL THEN one.p WHEN best.k = 1 THEN 0.6 * one.p + 0.4 * (coalesce(r.cnt, 0) + 0.2) / (t.n + 1.0) ELSE (coalesce(r.cnt, 0) + 0.2) / (t.n + 1.0) END AS p
  FROM one LEFT JOIN best ON best.ctx = one.ctx LEFT JOIN t ON t.ctx = one.ctx AND t.k = best.k LEFT JOIN r ON r.ctx = one.ctx AND r.k = best.k AND r.nxt = one.node)"""


@query(f"{BACK}{SQL_MOGEN} {OUT}")
def mogen_predict(spark, sf):
    train, windows = data(spark, sf)
    return dense(M.prepare_rampup(train, windows, 3).select("ctx", "size", M.multi_order(3).alias("d")))


@query(f"{BACK}{sql_backoff(2)}, mc AS (SELECT * FROM d), {ONE} SELECT array_to_string(mc.ctx, '-') AS ctx, mc.node, round(0.3 * mc.p + 0.7 * one.p, 6) AS p FROM mc JOIN one USING (ctx, node)")
def jelinek_mercer(spark, sf):
    return dense(predicted(spark, sf, 2, M.interpolate(0.3, M.backoff(2), F.col("mc1"))))


# population and individual memory

E = "CASE WHEN {p} > 1e-8 THEN -({p}) * ln({p}) ELSE -1e-8 * ln(1e-8) END"


def clamped(p: str) -> str:
    return f"-greatest({p}, 1e-8) * ln(greatest({p}, 1e-8))"


SQL_POP = f"""ov AS (SELECT k, c[p:p+k-1] AS ctx, c[p+k] AS nxt, count(*) AS cnt FROM (SELECT c, k, unnest(range(1, 6 - k)) AS p FROM
  (SELECT path[i+1:i+5] AS c FROM (SELECT path, unnest(range(0, len(path) - 5)) AS i FROM train)), (SELECT unnest(range(1, 5)) AS k)) GROUP BY 1, 2, 3),
os AS (SELECT ctx, k, ctx[len(ctx)-k+1:] AS s FROM ctxs, (SELECT unnest(range(1, 5)) AS k)),
om AS (SELECT os.ctx, os.k, nxt, cnt, sum(cnt) OVER (PARTITION BY os.ctx, os.k) AS n FROM os JOIN ov ON ov.k = os.k AND ov.ctx = os.s), ot AS (SELECT DISTINCT ctx, k, n FROM om),
base AS (SELECT c.ctx, nodes.node, CASE WHEN ot.n IS NULL THEN 0.2 ELSE (coalesce(om.cnt, 0) + 1e-4) / (ot.n + 5e-4) END AS p FROM ctxs c CROSS JOIN nodes LEFT JOIN ot ON ot.ctx = c.ctx AND ot.k = 1 LEFT JOIN om ON om.ctx = c.ctx AND om.k = 1 AND om.nxt = nodes.node),
parts AS (SELECT os.ctx, os.k, base.node, coalesce(ot.n, 0) AS n, CASE WHEN os.k = 1 OR ot.n IS NULL THEN base.p ELSE coalesce(om.cnt, 0) / ot.n END AS p
  FROM os JOIN base ON base.ctx = os.ctx LEFT JOIN ot ON ot.ctx = os.ctx AND ot.k = os.k LEFT JOIN om ON om.ctx = os.ctx AND om.k = os.k AND om.nxt = base.node),
pw AS (SELECT ctx, k, any_value(n) / (any_value(n) + 8.0) / (sum({clamped('p')}) + 1e-8) AS w, 1 / (sum({clamped('p')}) + 1e-8) AS v FROM parts GROUP BY ctx, k),
pwn AS (SELECT ctx, k, CASE WHEN sum(w) OVER c > 1e-8 THEN w / sum(w) OVER c ELSE v / sum(v) OVER c END AS w FROM pw WINDOW c AS (PARTITION BY ctx)),
pop AS (SELECT ctx, node, sum(w * p) AS p FROM parts JOIN pwn USING (ctx, k) GROUP BY ctx, node)"""


@query(f"{BACK}{SQL_POP} SELECT array_to_string(ctx, '-') AS ctx, node, round(p, 6) AS p FROM pop")
def dmmc_population(spark, sf):
    train, windows = data(spark, sf)
    return dense(M.population(train, windows, 5, 10).select("ctx", "size", F.col("pop").alias("d")))


SQL_IND = f"""uc AS (SELECT DISTINCT user_id, ctx FROM win), us AS (SELECT user_id, ctx, k, ctx[len(ctx)-k+1:] AS s FROM uc, (SELECT unnest(range(1, 4)) AS k)),
im AS (SELECT us.user_id, us.ctx, us.k, h.nxt, h.cnt, sum(h.cnt) OVER (PARTITION BY us.user_id, us.ctx, us.k) AS n FROM us JOIN hng h ON h.user_id = us.user_id AND h.k = us.k AND h.ctx = us.s), it AS (SELECT DISTINCT user_id, ctx, k, n FROM im),
ip AS (SELECT us.user_id, us.ctx, us.k, nodes.node, coalesce(it.n, 0) AS n, CASE WHEN it.n IS NULL THEN 0.2 ELSE (coalesce(im.cnt, 0) + 0.2) / (it.n + 1) END AS p FROM us CROSS JOIN nodes LEFT JOIN it ON it.user_id = us.user_id AND it.ctx = us.ctx AND it.k = us.k
  LEFT JOIN im ON im.user_id = us.user_id AND im.ctx = us.ctx AND im.k = us.k AND im.nxt = nodes.node),
iw AS (SELECT user_id, ctx, k, any_value(n) / (any_value(n) + 8.0) / (sum({clamped('p')}) + 1e-8) AS w, 1 / (sum({clamped('p')}) + 1e-8) AS v FROM ip GROUP BY user_id, ctx, k),
iwn AS (SELECT user_id, ctx, k, CASE WHEN sum(w) OVER c > 1e-8 THEN w / sum(w) OVER c ELSE v / sum(v) OVER c END AS w FROM iw WINDOW c AS (PARTITION BY user_id, ctx)),
ind AS (SELECT user_id, ctx, node, sum(w * p) AS p FROM ip JOIN iwn USING (user_id, ctx, k) GROUP BY user_id, ctx, node),
sup AS (SELECT user_id, ctx, sum(n) AS n, max(CASE WHEN n > 0 THEN k ELSE 0 END) AS kmax FROM (SELECT DISTINCT user_id, ctx, k, n FROM ip) GROUP BY user_id, ctx)"""
USERS = f"WITH {HNG}, " + WIN.split("test AS (SELECT * FROM trip WHERE trip_id % 5 = 0),", 1)[1].strip() + ", "


def _individual(spark, sf):
    train, windows = data(spark, sf)
    own = W.history_ngrams(W.histories(train, "user_id", "trip_id", W.HISTORY), "user_id", 3)
    return train, windows, M.individual(own, windows, "user_id", M.unigram(train).select("size"), 3)


@query(f"{USERS}{SQL_IND} SELECT user_id, array_to_string(ctx, '-') AS ctx, node, round(p, 6) AS p FROM ind")
def dmmc_individual(spark, sf):
    _, _, ind = _individual(spark, sf)
    return dense(ind.select("user_id", "ctx", F.col("ind").alias("d")))


SQL_GATE = f"""hp AS (SELECT ctx, sum({clamped('p')}) AS h FROM pop GROUP BY ctx), hi AS (SELECT user_id, ctx, sum({clamped('p')}) AS h, max(p) AS peak FROM ind GROUP BY user_id, ctx),
cf AS (SELECT sup.user_id, sup.ctx, hi.h AS h_ind, hp.h AS h_pop, sup.n, sup.n / (sup.n + 5.0) * sup.kmax / 10 * sqrt(hi.peak) AS conf FROM sup JOIN hi USING (user_id, ctx) JOIN hp ON hp.ctx = sup.ctx),
gw AS (SELECT user_id, ctx, conf, n, h_ind, h_pop, ((1 + 5 * conf) / (h_ind + 1e-8)) / ((1 + 5 * conf) / (h_ind + 1e-8) + 1 / (h_pop + 1e-8)) AS a,
  ((1 + 5 * n / (n + 5.0)) / (h_ind + 1e-8)) / ((1 + 5 * n / (n + 5.0)) / (h_ind + 1e-8) + 1 / (h_pop + 1e-8)) AS shown FROM cf),
dm AS (SELECT ind.user_id, ind.ctx, ind.node, gw.a * ind.p + (1 - gw.a) * pop.p AS p FROM ind JOIN gw USING (user_id, ctx) JOIN pop ON pop.ctx = ind.ctx AND pop.node = ind.node)"""


def _gated(spark, sf):
    train, windows, ind = _individual(spark, sf)
    return windows, M.gate(M.population(train, windows, 5, 10), ind, 10)


@query(f"{USERS}{SQL_POP}, {SQL_IND}, {SQL_GATE} SELECT user_id, array_to_string(ctx, '-') AS ctx, node, round(p, 6) AS p FROM dm")
def dmmc_combined(spark, sf):
    return dense(_gated(spark, sf)[1].select("user_id", "ctx", F.col("mixed").alias("d")))


@query(f"{USERS}{SQL_POP}, {SQL_IND}, {SQL_GATE} SELECT user_id, array_to_string(ctx, '-') AS ctx, CAST(n AS BIGINT) AS n, round(conf, 6) AS conf, round(h_pop, 6) AS h_pop, round(h_ind, 6) AS h_ind, round(a, 6) AS a_ind, round(shown, 6) AS shown_ind FROM gw")
def dmmc_explain(spark, sf):
    """Weights in use and the shorter ones that explanations show."""
    g = _gated(spark, sf)[1]
    return g.select("user_id", P.text(F.col("ctx")).alias("ctx"), F.col("n").cast("bigint").alias("n"), *[F.round(c, 6).alias(c) for c in ("conf", "h_pop", "h_ind", "a_ind", "shown_ind")])


# scores

RULES = {"mc3": lambda: M.backoff(3), "hwmc3": lambda: M.weighted(3), "akom3": lambda: M.all_k(3), "cpt": lambda: M.noise_filtered(5)}


def score_sql(dist: str = "d", floor: str = "1e-300") -> str:
    return f"""tr AS (SELECT w.trip_id, w.user_id, w.pos, w.ctx, w.target, d.p AS pt FROM win w JOIN {dist} d ON d.ctx = w.ctx AND d.node = w.target),
sc AS (SELECT tr.trip_id, tr.user_id, tr.pos, any_value(tr.target) AS target, any_value(tr.pt) AS p_true, 1 + count(*) FILTER (WHERE round(d.p, 9) > round(tr.pt, 9)) AS rank,
  -ln(greatest(any_value(tr.pt), {floor})) AS nll, sum(d.p * d.p) - 2 * any_value(tr.pt) + 1 AS brier, arg_max(d.node, (round(d.p, 9), -d.node)) AS top1 FROM tr JOIN {dist} d ON d.ctx = tr.ctx GROUP BY tr.trip_id, tr.user_id, tr.pos)"""


AGG = """count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS acc1, round(avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS acc3, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS acc5,
round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg(nll), 6) AS nll, round(avg(brier), 6) AS brier, round(avg(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg5"""


def metrics_query(name: str, sql: str):
    @query(f"{BACK}{sql}, {score_sql()} SELECT {AGG} FROM sc")
    def run(spark, sf):
        _, windows = data(spark, sf)
        return S.metrics(S.scored(windows, predicted(spark, sf, 5 if name == "cpt" else 3, RULES[name]())))

    from .registry import ORACLES, QUERIES

    QUERIES[f"metrics_{name}"] = QUERIES.pop("run")
    ORACLES[f"metrics_{name}"] = ORACLES.pop("run")


for _name, _sql in (("mc3", sql_backoff(3)), ("hwmc3", SQL_HW), ("akom3", SQL_AKOM), ("cpt", SQL_CPT)):
    metrics_query(_name, _sql)


@query(f"{BACK}{SQL_HW}, {score_sql()} SELECT trip_id, pos, target, CAST(rank AS INTEGER) AS rank, top1 FROM sc")
def next_node_trace(spark, sf):
    """Target, best guess and optimistic rank of every window."""
    _, windows = data(spark, sf)
    return S.scored(windows, predicted(spark, sf, 3, M.weighted(3))).select("trip_id", "pos", "target", "rank", "top1")


@query(f"""{BACK}{SQL_HW}, {score_sql()} SELECT CAST(least(floor(p_true * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p_true), 6) AS mean_p, round(avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate FROM sc GROUP BY 1""")
def metrics_calibration(spark, sf):
    _, windows = data(spark, sf)
    return S.calibration(S.scored(windows, predicted(spark, sf, 3, M.weighted(3))))


@query(f"WITH {WIN} SELECT count(*) AS n, CAST(count(*) FILTER (WHERE target = ctx[5]) AS BIGINT) AS hits, round(avg(CASE WHEN target = ctx[5] THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, count(DISTINCT target) AS labels FROM win")
def persistence_baseline(spark, sf):
    return S.persistence(data(spark, sf)[1])


@query(f"""{BACK}{SQL_HW}, {score_sql()}, deg AS (SELECT path[i] AS node, count(DISTINCT path[i+1]) AS g FROM (SELECT path, unnest(range(1, len(path))) AS i FROM train) WHERE path[i] <> path[i+1] GROUP BY 1),
sel AS (SELECT sc.* FROM sc JOIN win USING (trip_id, pos) LEFT JOIN deg ON deg.node = win.ctx[5] WHERE coalesce(g, 0) >= 4) SELECT {AGG} FROM sel""")
def decision_node_metrics(spark, sf):
    """Scores where the current node has at least four successors in the training paths."""
    train, windows = data(spark, sf)
    edges = W.ngrams(train, 1).select(F.get("ctx", F.lit(0)).alias("source"), F.col("next").alias("target"))
    return S.metrics(S.scored(S.at_decisions(windows, edges, 4), predicted(spark, sf, 3, M.weighted(3))))


def scored_dm(model: str, alias: str) -> str:
    on = "d.user_id = w.user_id AND " if model != "pop" else ""
    return f"""{alias} AS (SELECT w.trip_id, w.pos, w.user_id, d.p AS pt, (SELECT 1) AS one, w.ctx, w.target FROM win w JOIN {model} d ON {on}d.ctx = w.ctx AND d.node = w.target),
r{alias} AS (SELECT t.trip_id, t.pos, any_value(t.user_id) AS user_id, 1 + count(*) FILTER (WHERE round(d.p, 9) > round(t.pt, 9)) AS rank, -ln(greatest(any_value(t.pt), 1e-8)) AS nll, arg_max(d.node, (round(d.p, 9), -d.node)) AS top1,
  sum(d.p * d.p) - 2 * any_value(t.pt) + 1 AS brier, any_value(t.target) AS target FROM {alias} t JOIN {model} d ON {on.replace('w.', 't.')}d.ctx = t.ctx GROUP BY t.trip_id, t.pos)"""


DM = f"{USERS}{SQL_POP}, {SQL_IND}, {SQL_GATE}, {scored_dm('dm', 'x')}"


@query(f"{DM} SELECT {AGG} FROM rx")
def metrics_dmmc(spark, sf):
    windows, g = _gated(spark, sf)
    return S.metrics(S.scored(windows, g.select("user_id", "ctx", "size", F.col("mixed").alias("d")), ["user_id"], 1e-8))


def _both(spark, sf):
    """trip_id, pos, user_id, target, best guesses and hits of both memories and of the mixture, a_ind."""
    windows, g = _gated(spark, sf)
    rows = windows.join(g, ["user_id", "ctx"])
    for name, d in (("pop", "pop"), ("ind", "ind"), ("mix", "mixed")):
        rows = rows.withColumn(f"{name}_hit", (D.top(S.rounded(F.col(d))) == F.col("target")).cast("int"))
    return rows.select("trip_id", "pos", "user_id", "pop_hit", "ind_hit", "mix_hit", "a_ind", "n")


BOTH = f"""{DM}, {scored_dm('pop', 'y')}, {scored_dm('ind', 'z')}, b AS (SELECT rx.trip_id, rx.pos, rx.user_id, CAST(ry.top1 = rx.target AS INTEGER) AS pop_hit, CAST(rz.top1 = rx.target AS INTEGER) AS ind_hit, CAST(rx.top1 = rx.target AS INTEGER) AS mix_hit, gw.a AS a_ind, gw.n
  FROM rx JOIN ry USING (trip_id, pos) JOIN rz USING (trip_id, pos) JOIN win ON win.trip_id = rx.trip_id AND win.pos = rx.pos JOIN gw ON gw.user_id = win.user_id AND gw.ctx = win.ctx)"""


@query(f"""{BOTH} SELECT count(*) AS n, CAST(sum(pop_hit) AS BIGINT) AS pop_right, CAST(sum(ind_hit) AS BIGINT) AS ind_right, CAST(count(*) FILTER (WHERE pop_hit = 0 AND ind_hit = 1) AS BIGINT) AS headroom,
CAST(count(*) FILTER (WHERE pop_hit = 1 OR ind_hit = 1) AS BIGINT) AS oracle_right, CAST(sum(mix_hit) - sum(pop_hit) AS BIGINT) AS net_gain FROM b""")
def memory_headroom(spark, sf):
    rows = _both(spark, sf)
    return rows.agg(
        F.count("*").alias("n"), F.sum("pop_hit").alias("pop_right"), F.sum("ind_hit").alias("ind_right"), F.count(F.when((F.col("pop_hit") == 0) & (F.col("ind_hit") == 1), 1)).alias("headroom"),
        F.count(F.when((F.col("pop_hit") == 1) | (F.col("ind_hit") == 1), 1)).alias("oracle_right"), (F.sum("mix_hit") - F.sum("pop_hit")).alias("net_gain"),
    )


@query(f"{BOTH} SELECT CAST(least(floor(round(a_ind, 9) * 40), 39) AS INTEGER) AS bin, count(*) AS n FROM b GROUP BY 1")
def alpha_histogram(spark, sf):
    return _both(spark, sf).groupBy(F.least(F.floor(F.round("a_ind", 9) * 40), F.lit(39)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query(f"{BOTH} SELECT CAST(least(floor(round(a_ind, 9) * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(pop_hit), 6) AS pop_acc, round(avg(ind_hit), 6) AS ind_acc, round(avg(mix_hit), 6) AS mix_acc FROM b GROUP BY 1")
def accuracy_by_alpha(spark, sf):
    return _both(spark, sf).groupBy(F.least(F.floor(F.round("a_ind", 9) * 10), F.lit(9)).cast("int").alias("bin")).agg(
        F.count("*").alias("n"), *[F.round(F.avg(f"{m}_hit"), 6).alias(f"{m}_acc") for m in ("pop", "ind", "mix")]
    )


@query(f"{BOTH} SELECT user_id, count(*) AS n, round(avg(a_ind), 6) AS mean_alpha, round(avg(CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS supported, round(avg(mix_hit) - avg(pop_hit), 6) AS gain FROM b GROUP BY user_id")
def per_user_gain(spark, sf):
    return _both(spark, sf).groupBy("user_id").agg(
        F.count("*").alias("windows"), F.round(F.avg("a_ind"), 6).alias("mean_alpha"), F.round(F.avg((F.col("n") > 0).cast("double")), 6).alias("supported"), F.round(F.avg("mix_hit") - F.avg("pop_hit"), 6).alias("gain")
    ).withColumnRenamed("windows", "n")
