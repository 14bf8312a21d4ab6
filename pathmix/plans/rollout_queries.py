"""Closed-loop queries, decoders, splits and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P
from ..operators import decode as C
from ..operators import distributions as D
from ..operators import models as M
from ..operators import rollout as O
from ..operators import splits as L
from ..operators import windows as W
from ..sources import tables as T
from .model_queries import SQL_HW
from .path_queries import TEST, TRAIN
from .registry import EV, GEO, LI, ROAD, WIN, matched, ngrams, query


def _seeds(spark, sf, length=5, steps=8):
    """Held-out trips longer than `length`: the first nodes as seed, up to `steps` that follow as truth."""
    test = W.at_least(T.event_paths(spark, sf).where(TEST), length + 1)
    truth = F.slice("path", length + 1, F.least(F.size("path") - length, F.lit(steps)))
    return test.select("trip_id", F.slice("path", 1, length).alias("ctx"), F.size(truth).alias("steps"), truth.alias("truth"))


def _backoff(train, k):
    table = M.counted(train, k).persist()
    return lambda contexts: W.match(contexts, table, k).select("ctx", F.when(F.size("found") > 0, D.from_counts(F.element_at("found", -1))).alias("d"))


ROLL = f"""WITH RECURSIVE {EV}, {ngrams(3)}, n3 AS (SELECT k, ctx, nxt, cnt, sum(cnt) OVER (PARTITION BY k, ctx) AS n FROM ng), best AS (SELECT k, ctx, arg_max(nxt, (cnt, -nxt)) AS node FROM ng GROUP BY 1, 2),
r(trip_id, ctx, truth, pred, i) AS (SELECT trip_id, path[:5], path[6:13], CAST([] AS INTEGER[]), 0 FROM test WHERE len(path) >= 6 UNION ALL
SELECT r.trip_id, list_append(r.ctx, coalesce(b3.node, b2.node, b1.node, r.ctx[len(r.ctx)])), truth, list_append(pred, coalesce(b3.node, b2.node, b1.node, r.ctx[len(r.ctx)])), i + 1 FROM r
 LEFT JOIN best b3 ON b3.k = 3 AND b3.ctx = r.ctx[len(r.ctx)-2:] LEFT JOIN best b2 ON b2.k = 2 AND b2.ctx = r.ctx[len(r.ctx)-1:] LEFT JOIN best b1 ON b1.k = 1 AND b1.ctx = r.ctx[len(r.ctx):] WHERE i < len(truth)),
f AS (SELECT trip_id, ctx, truth, pred FROM r WHERE i = len(truth)),
st AS (SELECT trip_id, s, truth[s] AS t, ctx[5+s-3:5+s-1] AS c, len(truth) AS n FROM (SELECT *, unnest(range(1, len(truth) + 1)) AS s FROM f)),
lv AS (SELECT st.*, CASE WHEN EXISTS (SELECT 1 FROM ng WHERE k = 3 AND ng.ctx = st.c) THEN 3 WHEN EXISTS (SELECT 1 FROM ng WHERE k = 2 AND ng.ctx = st.c[2:]) THEN 2 ELSE 1 END AS k FROM st),
rk AS (SELECT trip_id, s, any_value(lv.n) AS n, 1 + count(*) FILTER (WHERE a.cnt > coalesce(b.cnt, 0)) AS rank, coalesce(any_value(b.cnt), 0) / any_value(a.n) AS p FROM lv JOIN n3 a ON a.k = lv.k AND a.ctx = lv.c[4-lv.k:] LEFT JOIN n3 b ON b.k = lv.k AND b.ctx = lv.c[4-lv.k:] AND b.nxt = lv.t GROUP BY trip_id, s),
cu AS (SELECT *, sum(CAST(rank = 1 AS INTEGER)) OVER (PARTITION BY trip_id ORDER BY s) AS h FROM rk)"""


@query(f"{ROLL} SELECT trip_id, array_to_string(pred, '-') AS pred, array_to_string(truth, '-') AS truth FROM f")
def rollout_mc(spark, sf):
    train = T.event_paths(spark, sf).where(TRAIN)
    rolled = O.greedy(_seeds(spark, sf), _backoff(train, 3), 5)
    return rolled.select("trip_id", P.text(F.col("pred")).alias("pred"), P.text(F.col("truth")).alias("truth"))


SCORES = f"""{ROLL}, ps AS (SELECT f.trip_id, len(pred) AS steps, x.hits, x.hits3, x.rr, x.lead_run, x.horizon, x.nll, CAST(pred[len(pred)] = truth[len(truth)] AS INTEGER) AS endpoint,
 round(len(list_intersect(pred, truth)) / len(list_distinct(list_concat(pred, truth))), 6) AS jaccard, levenshtein(array_to_string(pred, ''), array_to_string(truth, '')) AS edits
 FROM f JOIN (SELECT trip_id, count(*) FILTER (WHERE rank = 1) AS hits, count(*) FILTER (WHERE rank <= 3) AS hits3, round(sum(1.0::DOUBLE / rank), 6) AS rr, coalesce(min(s) FILTER (WHERE rank <> 1) - 1, count(*)) AS lead_run,
 coalesce(max(s) FILTER (WHERE h / s >= 0.75), 0) AS horizon, round(avg(-ln(greatest(p, 1e-12))), 6) AS nll FROM cu GROUP BY trip_id) x USING (trip_id))"""


def _scores(spark, sf):
    train = T.event_paths(spark, sf).where(TRAIN)
    return O.path_scores(O.greedy(_seeds(spark, sf), _backoff(train, 3), 5))


@query(f"""{SCORES} SELECT trip_id, CAST(steps AS INTEGER) AS steps, CAST(hits AS INTEGER) AS hits, CAST(hits3 AS INTEGER) AS hits3, rr, CAST(lead_run AS INTEGER) AS lead_run, CAST(horizon AS INTEGER) AS horizon, endpoint, CAST(jaccard AS DOUBLE) AS jaccard, CAST(edits AS INTEGER) AS edits, nll FROM ps""")
def rollout_scores(spark, sf):
    """Leading and 75-percent horizons, endpoint, Jaccard and edit distance per path."""
    return _scores(spark, sf)


@query(f"""{SCORES} SELECT count(*) AS paths, CAST(sum(steps) AS BIGINT) AS tokens, round(sum(hits) / sum(steps), 6) AS ar1, round(sum(hits3) / sum(steps), 6) AS ar3, round(sum(rr) / sum(steps), 4) AS mrr, round(avg(endpoint), 6) AS endpoint,
round(avg(jaccard), 5) AS jaccard, round(avg(lead_run), 6) AS lead_run, round(avg(horizon), 6) AS horizon, round(avg(edits), 6) AS edits FROM ps""")
def ar_metrics(spark, sf):
    return O.ar_metrics(_scores(spark, sf))


BLENDED = f"""WITH RECURSIVE {EV}, nodes AS (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS node), ctxs AS (SELECT [a.node, b.node, c.node] AS ctx FROM nodes a, nodes b, nodes c), {SQL_HW},
best AS (SELECT ctx, arg_max(node, (round(p, 9), -node)) AS node FROM d GROUP BY ctx),
r(trip_id, ctx, pred, steps, i) AS (SELECT trip_id, path[3:5], CAST([] AS INTEGER[]), least(len(path) - 5, 4), 0 FROM test WHERE len(path) >= 6 UNION ALL
SELECT trip_id, list_append(r.ctx, best.node)[2:], list_append(pred, best.node), steps, i + 1 FROM r JOIN best ON best.ctx = r.ctx WHERE i < steps)
SELECT trip_id, array_to_string(pred, '-') AS pred FROM r WHERE i = steps"""
#: t(k, ctx, nxt, p): successors of the contexts of one and two nodes.
TWO = f"{EV}, {ngrams(2)}, t AS (SELECT k, ctx, nxt, cnt / sum(cnt) OVER (PARTITION BY k, ctx) AS p FROM ng)"


@query(BLENDED)
def rollout_blended(spark, sf):
    """The same loop with all orders weighted."""
    train = T.event_paths(spark, sf).where(TRAIN)
    rolled = O.greedy(_seeds(spark, sf, steps=4), lambda c: M.prepare(train, c, 3).select("ctx", M.weighted(3).alias("d")), 5)
    return rolled.select("trip_id", P.text(F.col("pred")).alias("pred"))


@query(f"""WITH RECURSIVE {TWO}, e AS (SELECT DISTINCT ctx FROM t WHERE k = 2),
r(trip_id, ctx, steps, pred, logp, i) AS (SELECT trip_id, path[4:5], least(len(path) - 5, 4), CAST([] AS INTEGER[]), 0.0::DOUBLE, 0 FROM test WHERE len(path) >= 6 UNION ALL
SELECT trip_id, ctx, steps, pred, logp, i FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY round(logp, 9) DESC, pred) AS place FROM (
 SELECT r.trip_id, [r.ctx[2], t.nxt] AS ctx, steps, list_append(pred, t.nxt) AS pred, logp + ln(t.p) AS logp, i + 1 AS i FROM r LEFT JOIN e ON e.ctx = r.ctx JOIN t ON (e.ctx IS NOT NULL AND t.k = 2 AND t.ctx = r.ctx) OR (e.ctx IS NULL AND t.k = 1 AND t.ctx = r.ctx[2:]) WHERE i < steps)) WHERE place <= 3)
SELECT trip_id, CAST(row_number() OVER (PARTITION BY trip_id ORDER BY round(logp, 9) DESC, pred) AS INTEGER) AS place, array_to_string(pred, '-') AS pred, round(logp, 6) AS logp FROM r WHERE i = steps""")
def beam_search(spark, sf):
    train = T.event_paths(spark, sf).where(TRAIN)
    out = O.beam(_seeds(spark, sf, steps=4), _backoff(train, 2), 5)
    return out.select("trip_id", "place", P.text(F.col("pred")).alias("pred"), F.round("logp", 6).alias("logp"))


@query(f"""WITH RECURSIVE {TWO}, o AS (SELECT k, ctx, list(nxt ORDER BY -round(p, 9), nxt) AS o FROM t GROUP BY k, ctx),
r(trip_id, d, path, ctx, reached, i) AS (SELECT trip_id, path[len(path)], [path[1]], [path[1], path[1]], path[1] = path[len(path)], 0 FROM test WHERE len(path) >= 6 UNION ALL
SELECT trip_id, d, CASE WHEN n IS NULL THEN path ELSE list_append(path, n) END, CASE WHEN n IS NULL THEN ctx ELSE [ctx[2], n] END, reached OR coalesce(n = d, false), i + 1 FROM (
 SELECT trip_id, d, path, ctx, reached, i, CASE WHEN reached THEN NULL WHEN len(b) >= 2 AND list_contains(path[greatest(len(path) - 8, 1):], b[1]) THEN b[2] ELSE b[1] END AS n FROM (
  SELECT r.*, coalesce(o2.o, o1.o) AS b FROM r LEFT JOIN o o2 ON o2.k = 2 AND o2.ctx = r.ctx LEFT JOIN o o1 ON o1.k = 1 AND o1.ctx = r.ctx[2:])) WHERE i < 6)
SELECT trip_id, array_to_string(path, '-') AS path, reached FROM r WHERE i = 6""")
def od_generation(spark, sf):
    ev = T.event_paths(spark, sf)
    pairs = W.at_least(ev.where(TEST), 6).select("trip_id", F.get("path", F.lit(0)).alias("origin"), F.element_at("path", -1).alias("destination"))
    out = O.between(pairs, _backoff(ev.where(TRAIN), 2), 2, 6)
    return out.select("trip_id", P.text(F.col("path")).alias("path"), "reached")


@query(f"WITH {EV} SELECT a.trip_id, round(len(list_intersect(a.path, b.path)) / len(list_distinct(list_concat(a.path, b.path))), 6)::DOUBLE AS jaccard FROM trip a JOIN trip b ON b.user_id = a.user_id AND b.trip_id = a.trip_id + 1")
def path_jaccard(spark, sf):
    """Each trip against the same user's next week."""
    ev = T.event_paths(spark, sf)
    other = ev.select((F.col("trip_id") - 1).alias("trip_id"), "user_id", F.col("path").alias("other"))
    return ev.join(other, ["trip_id", "user_id"]).select("trip_id", F.round(P.jaccard(F.col("path"), F.col("other")), 6).alias("jaccard"))


@query(f"WITH {EV} SELECT a.trip_id, CAST(levenshtein(array_to_string(a.path, ''), array_to_string(b.path, '')) AS INTEGER) AS edits, round(levenshtein(array_to_string(a.path, ''), array_to_string(b.path, '')) / greatest(len(a.path), len(b.path)), 6)::DOUBLE AS share FROM trip a JOIN trip b ON b.user_id = a.user_id AND b.trip_id = a.trip_id + 1")
def edit_distance(spark, sf):
    ev = T.event_paths(spark, sf)
    other = ev.select((F.col("trip_id") - 1).alias("trip_id"), "user_id", F.col("path").alias("other"))
    edits = P.edit_distance(F.col("path"), F.col("other"))
    return ev.join(other, ["trip_id", "user_id"]).select("trip_id", edits.alias("edits"), F.round(edits / F.greatest(F.size("path"), F.size("other")), 6).alias("share"))


# topology


@query(f"WITH {ROAD}, {GEO}, n AS (SELECT source, count(DISTINCT target) AS k FROM road GROUP BY 1) SELECT road.source AS node, target AS next, round(1 / k, 6)::DOUBLE AS p FROM road JOIN n USING (source)")
def neighbors_uniform(spark, sf):
    edges = T.road(spark, sf)
    ctx = T.coordinates(spark, sf).select(F.array("node").alias("ctx"))
    d = M.neighbours_uniform(ctx, edges, 100)
    return d.select(F.get("ctx", F.lit(0)).alias("node"), F.explode("d.p").alias("x")).select("node", F.col("x.node").alias("next"), F.round("x.p", 6).alias("p"))


TOPO = f"""WITH {ROAD}, {GEO}, first AS (SELECT node AS a, lead(node) OVER (PARTITION BY trip_id ORDER BY pos) AS b FROM li), mc AS (SELECT a, b, count(*) / sum(count(*)) OVER (PARTITION BY a) AS p FROM first WHERE b IS NOT NULL GROUP BY 1, 2)"""


def _first_order(spark, sf):
    edges = T.road(spark, sf).groupBy(F.col("source").alias("node")).agg(F.array_sort(F.collect_set("target")).alias("to"))
    table = W.rows_of(W.ngrams(T.supplier_paths(spark, sf), 1))
    rows = table.select(F.get("sfx", F.lit(0)).alias("node"), D.from_counts(F.struct("n", "nexts")).alias("d")).join(edges, "node", "left")
    return rows.join(F.broadcast(T.coordinates(spark, sf).agg(F.count("*").cast("int").alias("size"))))


@query(f"""{TOPO}, k AS (SELECT mc.a, mc.b, mc.p FROM mc JOIN road ON road.source = mc.a AND road.target = mc.b) SELECT a AS node, b AS next, round(p / sum(p) OVER (PARTITION BY a), 6) AS p FROM k""")
def topology_mask(spark, sf):
    """First-order predictions kept on road edges alone, for nodes that have such mass."""
    rows = _first_order(spark, sf).where("to is not null").withColumn("m", M.masked(F.col("d"), F.col("to"), F.col("size")))
    return rows.select("node", F.explode("m.p").alias("x")).where("x.p > 0").select("node", F.col("x.node").alias("next"), F.round("x.p", 6).alias("p"))


@query(f"""{TOPO}, n AS (SELECT source AS a, count(*) AS k FROM road GROUP BY 1), v AS (SELECT count(*) AS v FROM geo),
w AS (SELECT mc.a, mc.b, mc.p * (0.3 / v.v + CASE WHEN road.target IS NULL THEN 0 ELSE 0.7 / n.k END) AS p FROM mc JOIN n ON n.a = mc.a CROSS JOIN v LEFT JOIN road ON road.source = mc.a AND road.target = mc.b)
SELECT a AS node, b AS next, round(p / sum(p) OVER (PARTITION BY a), 6) AS p FROM w""")
def topology_prior(spark, sf):
    rows = _first_order(spark, sf).where("to is not null").withColumn("m", M.with_prior(F.col("d"), F.col("to"), F.col("size"), 0.7))
    return rows.select("node", F.explode("m.p").alias("x")).where("x.p > 0").select("node", F.col("x.node").alias("next"), F.round("x.p", 6).alias("p"))


# decoders


@query(f"""WITH {EV}, g AS (SELECT path[i:i+1] AS a, path[i+1:i+2] AS b FROM (SELECT path, unnest(range(1, len(path) - 1)) AS i FROM train)), p AS (SELECT a, b, count(*) / sum(count(*)) OVER (PARTITION BY a) AS p FROM g GROUP BY a, b)
SELECT array_to_string(a, '-') AS ctx, b[2] AS node, round(sum(p), 6) AS p FROM p GROUP BY a, b[2]""")
def decode_kgram(spark, sf):
    """A first-order model over pairs of nodes, decoded to nodes."""
    train = T.event_paths(spark, sf).where(TRAIN)
    vocab = W.kgram_vocabulary(train, 2)
    encoded = W.kgram_encode(train.select("trip_id", "path"), vocab, 2)
    table = W.ngrams(encoded, 1).select(F.get("ctx", F.lit(0)).alias("from"), F.col("next").alias("id"), "cnt")
    total = table.groupBy("from").agg(F.sum("cnt").alias("n"))
    p = table.join(total, "from").select("from", "id", (F.col("cnt") / F.col("n")).alias("p"))
    out = C.from_kgrams(p, vocab, ["from"]).join(vocab.withColumnRenamed("id", "from"), "from")
    return out.select(P.text(F.col("kgram")).alias("ctx"), "node", F.round("p", 6).alias("p"))


CAND = f"""WITH {ROAD}, {GEO}, t AS (SELECT trip_id, pos, node, lag(node) OVER w AS prev, lead(node) OVER w AS nxt FROM li WINDOW w AS (PARTITION BY trip_id ORDER BY pos)),
tr AS (SELECT * FROM t WHERE trip_id % 5 <> 0), sec AS (SELECT prev, node, nxt AS cand, count(*) AS c FROM tr WHERE prev IS NOT NULL AND nxt IS NOT NULL GROUP BY 1, 2, 3), fir AS (SELECT node, nxt AS cand, count(*) AS c FROM tr WHERE nxt IS NOT NULL GROUP BY 1, 2),
pri AS (SELECT node, count(*)::DOUBLE AS p FROM tr GROUP BY 1), rows AS (SELECT trip_id AS key, prev, node FROM t WHERE pos = 1 AND trip_id % 5 = 0 AND prev IS NOT NULL),
al AS (SELECT key, cand, c::DOUBLE AS p, 2 AS level FROM rows JOIN sec USING (prev, node) UNION ALL SELECT key, cand, c::DOUBLE, 1 FROM rows JOIN fir USING (node) UNION ALL
 SELECT key, target, coalesce(pri.p, 0), 0 FROM rows JOIN road ON road.source = rows.node LEFT JOIN pri ON pri.node = road.target),
ca AS (SELECT key, cand, level, p / nullif(sum(p) OVER (PARTITION BY key), 0) AS p FROM (SELECT *, max(level) OVER (PARTITION BY key) AS top FROM al) WHERE level = top)"""


def _candidates(spark, sf):
    paths = T.supplier_paths(spark, sf)
    train, ask = paths.where("trip_id % 5 <> 0"), paths.where("trip_id % 5 = 0")
    second = W.ngrams(train, 2, 2).select(F.get("ctx", F.lit(0)).alias("prev"), F.get("ctx", F.lit(1)).alias("node"), "next", "cnt")
    first = W.ngrams(train, 1).select(F.get("ctx", F.lit(0)).alias("node"), "next", "cnt")
    road = T.road(spark, sf).select(F.col("source").alias("node"), F.col("target").alias("next"))
    prior = W.steps(train).groupBy("node").agg(F.count("*").cast("double").alias("p"))
    rows = ask.where(F.size("path") >= 2).select(F.col("trip_id").alias("key"), F.get("path", F.lit(0)).alias("prev"), F.get("path", F.lit(1)).alias("node"))
    return C.candidates(rows, second, first, road, prior)


@query(f"{CAND} SELECT key, cand, level, round(p, 6) AS p FROM ca")
def candidates_fallback(spark, sf):
    return _candidates(spark, sf).select("key", "cand", "level", F.round("p", 6).alias("p"))


@query(f"""{CAND}, cl AS (SELECT key, c AS cluster, (1.0::DOUBLE + (key + c) % 4) / 10 AS mass FROM (SELECT DISTINCT key FROM rows), (SELECT unnest(range(0, 7)) AS c)),
j AS (SELECT ca.key, cand AS node, ca.p AS share, coalesce(mass, 0) * ca.p / nullif(sum(ca.p) OVER (PARTITION BY ca.key, cand % 7), 0) AS raw FROM ca LEFT JOIN cl ON cl.key = ca.key AND cl.cluster = cand % 7)
SELECT key, node, round(coalesce(coalesce(raw, 0) / nullif(sum(coalesce(raw, 0)) OVER (PARTITION BY key), 0), share) + 1e-9, 6) AS p FROM j""")
def decode_cluster(spark, sf):
    """Cluster mass (a fixed pattern here) shared out over the candidates."""
    cands = _candidates(spark, sf)
    keys = cands.select("key").distinct()
    mass = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("cluster")).withColumn("p", (1.0 + (F.col("key") + F.col("cluster")) % 4) / 10)
    clusters = T.coordinates(spark, sf).select("node", (F.col("node") % 7).alias("cluster"))
    return C.from_clusters(mass, cands, clusters).select("key", "node", F.round(F.col("p") + 1e-9, 6).alias("p"))


@query(f"""WITH {LI}, {GEO}, v AS (SELECT node, count(*) AS n FROM li GROUP BY 1), pr AS (SELECT geo.node, geo.node % 7 AS cluster, (coalesce(n, 0) + 1)::DOUBLE / sum(coalesce(n, 0) + 1) OVER (PARTITION BY geo.node % 7) AS s FROM geo LEFT JOIN v USING (node))
SELECT k AS key, node, round(s * (1 + (k + cluster) % 3) / 13 + 1e-9, 6) AS p FROM pr, (SELECT unnest(range(0, 4)) AS k)""")
def decode_cluster_dense(spark, sf):
    """Cluster mass over all nodes of each cluster, for contexts without candidates."""
    visits = W.steps(T.supplier_paths(spark, sf)).groupBy("node").agg(F.count("*").alias("n"))
    share = F.coalesce("n", F.lit(0)) + 1
    clusters = T.coordinates(spark, sf).select("node", (F.col("node") % 7).alias("cluster"))
    prior = clusters.join(visits, "node", "left").select("node", (share / F.sum(share).over(Window.partitionBy("cluster"))).alias("p"))
    mass = spark.range(4).select(F.col("id").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("cluster")).withColumn("p", (1 + (F.col("key") + F.col("cluster")) % 3) / 13)
    return C.dense_clusters(mass, clusters, prior).select("key", "node", F.round(F.col("p") + 1e-9, 6).alias("p"))


@query(f"""{SCORES}, q AS (SELECT f.trip_id, (SELECT avg(CASE WHEN f.pred[i] = f.truth[i] THEN 1.0::DOUBLE ELSE 0 END) FROM range(1, len(f.truth) + 1) t(i)) AS acc, f.pred = f.truth AS exact FROM f)
SELECT count(*) AS paths, round(avg(acc), 6) AS node_accuracy, round(stddev_pop(acc), 6) AS node_accuracy_std, CAST(count(*) FILTER (WHERE exact) AS BIGINT) AS exact_matches, round(avg(edits / steps), 6) AS edit_share FROM q JOIN ps USING (trip_id)""")
def full_path_evaluation(spark, sf):
    """Node accuracy, exact matches and normalised edit distance of greedy continuations."""
    train = T.event_paths(spark, sf).where(TRAIN)
    rolled = O.greedy(_seeds(spark, sf), _backoff(train, 3), 5)
    same = F.zip_with("pred", "truth", lambda a, b: (a == b).cast("double"))
    rows = rolled.select((D.total(same, lambda x: x) / F.size("truth")).alias("acc"), (F.col("pred") == F.col("truth")).alias("exact"), (P.edit_distance(F.col("pred"), F.col("truth")) / F.greatest(F.size("pred"), F.size("truth"))).alias("edits"))
    return rows.agg(
        F.count("*").alias("paths"), F.round(F.avg("acc"), 6).alias("node_accuracy"), F.round(F.stddev_pop("acc"), 6).alias("node_accuracy_std"), F.count(F.when(F.col("exact"), 1)).alias("exact_matches"),
        F.round(F.avg("edits"), 6).alias("edit_share"),
    )


# splits

KEY = "(({c} * 2654435761 + {s}) % 1000003 + 1000003) % 1000003"
S42 = 42 * 40503


@query(f"""WITH {EV}, o AS (SELECT trip_id, row_number() OVER (ORDER BY {KEY.format(c='trip_id', s=S42)}, trip_id) - 1 AS i, count(*) OVER () AS n FROM trip)
SELECT trip_id, CASE WHEN i < greatest(floor(n * 0.2), 1) THEN 'test' WHEN i < greatest(floor(n * 0.2), 1) + greatest(floor(n * 0.2), 1) THEN 'val' ELSE 'train' END AS split FROM o""")
def split_trips(spark, sf):
    return L.by_trip(T.event_paths(spark, sf)).select("trip_id", "split")


@query(f"""WITH {EV}, t AS (SELECT user_id, trip_id, count(*) OVER (PARTITION BY user_id) AS t, row_number() OVER (PARTITION BY user_id ORDER BY {KEY.format(c='trip_id', s=S42)}, trip_id) AS r FROM trip),
u AS (SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY {KEY.format(c='user_id', s=S42)}, user_id) AS i FROM (SELECT DISTINCT user_id FROM t WHERE t >= 3)) WHERE i <= 100),
x AS (SELECT trip_id, row_number() OVER (ORDER BY {KEY.format(c='trip_id', s=43 * 40503)}, trip_id) - 1 AS i, count(*) OVER () AS n FROM t WHERE user_id NOT IN (SELECT user_id FROM u))
SELECT trip_id, CASE WHEN r <= greatest(floor(t * 0.1), 1) THEN 'test' ELSE 'history' END AS split FROM t WHERE user_id IN (SELECT user_id FROM u) UNION ALL SELECT trip_id, CASE WHEN i < greatest(floor(n * 0.1), 1) THEN 'val' ELSE 'train' END FROM x""")
def split_user_aware(spark, sf):
    return L.by_user(T.event_paths(spark, sf)).select("trip_id", "split")


@query(f"WITH {EV}, o AS (SELECT trip_id, row_number() OVER (ORDER BY {KEY.format(c='trip_id', s=S42)}, trip_id) - 1 AS i, count(*) OVER () AS n FROM trip) SELECT trip_id FROM o WHERE i < greatest(floor(n * 0.3), 1)")
def subsample(spark, sf):
    return L.subsample(T.event_paths(spark, sf), "trip_id", 0.3).select("trip_id")


@query(f"WITH {EV}, o AS (SELECT trip_id, row_number() OVER (ORDER BY {KEY.format(c='trip_id', s=S42)}, trip_id) AS i FROM trip) SELECT trip_id FROM o WHERE i <= 200")
def window_cap(spark, sf):
    """A bounded, repeatable evaluation sample."""
    return L.first_by_key(T.event_paths(spark, sf), "trip_id", 200).select("trip_id")


@query(f"WITH {EV} SELECT trip_id, CAST({KEY.format(c='trip_id', s=S42)} % 5 AS INTEGER) AS fold FROM trip")
def kfold(spark, sf):
    return L.folds(T.event_paths(spark, sf), "trip_id").select("trip_id", "fold")


@query(f"WITH {LI}, o AS (SELECT trip_id, path, row_number() OVER (ORDER BY trip_id) - 1 AS i FROM op) SELECT trip_id, array_to_string(path[:20], '-') AS path FROM o WHERE i % 50 = 0")
def systematic_sample(spark, sf):
    """The reduced data set: every fiftieth trip, its first twenty nodes."""
    return L.every(T.supplier_paths(spark, sf), "trip_id").select("trip_id", P.text(F.slice("path", 1, 20)).alias("path"))


@query(f"WITH {EV} SELECT trip_id FROM trip WHERE len(path) >= 6 INTERSECT SELECT trip_id FROM trip WHERE len(list_filter(path, lambda x, i: i = 1 OR x <> path[i-1])) >= 5")
def fair_pool(spark, sf):
    """Trips that every encoding can use."""
    ev = T.event_paths(spark, sf)
    return W.at_least(ev, 6).select("trip_id").intersect(ev.where(F.size(P.collapse_runs(F.col("path"))) >= 5).select("trip_id"))
