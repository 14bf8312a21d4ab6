"""Queries over paths: parsing, cleaning, encodings, windows and counts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P
from ..operators import windows as W
from ..sources import tables as T
from .registry import EV, LI, WIN, ngrams, query

TRAIN = "pmod(trip_id, 5) <> 0"
TEST = "pmod(trip_id, 5) = 0"


def txt(column: str = "path"):
    return P.text(F.col(column))


@query(f"WITH {EV} SELECT trip_id, user_id, CAST(len(path) AS INTEGER) AS n_nodes, array_to_string(path, '-') AS path FROM trip WHERE len(path) >= 6")
def trips_min_length(spark, sf):
    return W.at_least(T.event_paths(spark, sf), 6).select("trip_id", "user_id", F.size("path").alias("n_nodes"), txt().alias("path"))


@query(f"WITH {LI} SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT DISTINCT node FROM li)")
def vocab(spark, sf):
    return W.vocabulary(T.supplier_paths(spark, sf))


@query(f"WITH {EV} SELECT trip_id, user_id, CAST(pos AS INTEGER) AS pos, node FROM ev")
def steps(spark, sf):
    return T.event_steps(spark, sf)


@query(f"WITH {WIN} SELECT trip_id, user_id, pos, array_to_string(ctx, '-') AS ctx, target FROM win")
def samples_l5(spark, sf):
    return W.samples(T.event_paths(spark, sf).where(TEST), 5).withColumn("ctx", txt("ctx"))


@query(f"""WITH {LI}, t AS (SELECT trip_id, array_to_string(path, ' , ') || ' ,, ' AS q FROM op)
SELECT trip_id, CAST(len(p) AS INTEGER) AS n_nodes, CAST(list_sum(p) AS BIGINT) AS node_sum FROM (SELECT trip_id, list_transform(list_filter(string_split(q, ','), lambda x: trim(x) <> ''), lambda x: CAST(trim(x) AS INTEGER)) AS p FROM t)""")
def path_parse(spark, sf):
    """Comma-joined text with blanks, back to arrays."""
    rows = T.supplier_paths(spark, sf).select("trip_id", F.concat(P.text(F.col("path"), " , "), F.lit(" ,, ")).alias("q_path"))
    parsed = rows.withColumn("p", P.parse_text(F.col("q_path")))
    return parsed.select("trip_id", F.size("p").alias("n_nodes"), F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("node_sum"))


@query(f"WITH {LI} SELECT trip_id, array_to_string(path, '-') AS path FROM op")
def path_parse_literal(spark, sf):
    """List literals, back to arrays."""
    rows = T.supplier_paths(spark, sf).select("trip_id", F.concat(F.lit("["), P.text(F.col("path"), ", "), F.lit("]")).alias("route_taken"))
    return rows.select("trip_id", P.text(P.parse_literal(F.col("route_taken"))).alias("path"))


RUNS = "list_filter(path, lambda x, i: i = 1 OR x <> path[i-1])"


@query(f"WITH {EV} SELECT trip_id, array_to_string({RUNS}, '-') AS path FROM trip")
def dedupe_consecutive(spark, sf):
    return T.event_paths(spark, sf).select("trip_id", P.text(P.collapse_runs(F.col("path"))).alias("path"))


@query(f"""WITH RECURSIVE {LI}, e(trip_id, path, i, acc) AS (SELECT trip_id, path, 0, CAST([] AS INTEGER[]) FROM op UNION ALL
SELECT trip_id, path, i + 1, CASE WHEN list_contains(acc, path[i+1]) THEN acc[:list_position(acc, path[i+1])] ELSE list_append(acc, path[i+1]) END FROM e WHERE i < len(path))
SELECT trip_id, array_to_string(acc, '-') AS path FROM e WHERE i = len(path)""")
def loop_erase(spark, sf):
    return T.supplier_paths(spark, sf).select("trip_id", P.text(P.erase_loops(F.col("path"))).alias("path"))


@query(f"WITH {EV} SELECT count(*) AS trips, count(*) FILTER (WHERE len({RUNS}) < 2) AS degenerate, CAST(sum(len(path) - len({RUNS})) AS BIGINT) AS dropped_nodes FROM trip")
def degenerate_trips(spark, sf):
    short = F.size(P.collapse_runs(F.col("path")))
    return T.event_paths(spark, sf).agg(F.count("*").alias("trips"), F.count(F.when(short < 2, 1)).alias("degenerate"), F.sum(F.size("path") - short).alias("dropped_nodes"))


@query(f"WITH {LI} SELECT array_to_string(g, '-') AS kgram, row_number() OVER (ORDER BY g) - 1 AS id FROM (SELECT DISTINCT path[i:i+1] AS g FROM (SELECT path, unnest(range(1, len(path))) AS i FROM op))")
def kgram_vocab(spark, sf):
    return W.kgram_vocabulary(T.supplier_paths(spark, sf), 2).select(txt("kgram").alias("kgram"), "id")


KG = EV + """, kv AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS id FROM (SELECT DISTINCT path[i:i+1] AS g FROM (SELECT path, unnest(range(1, len(path))) AS i FROM train))),
enc AS (SELECT trip_id, i, id, g FROM (SELECT trip_id, path[i:i+1] AS g, i FROM (SELECT trip_id, path, unnest(range(1, len(path))) AS i FROM test)) JOIN kv USING (g))"""


def _kgram_encoded(spark, sf):
    ev = T.event_paths(spark, sf)
    vocab_ = W.kgram_vocabulary(ev.where(TRAIN), 2)
    return W.kgram_encode(ev.where(TEST).select("trip_id", "path"), vocab_, 2), vocab_


@query(f"WITH {KG} SELECT trip_id, string_agg(CAST(id AS VARCHAR), '-' ORDER BY i) AS ids FROM enc GROUP BY trip_id")
def kgram_encode(spark, sf):
    return _kgram_encoded(spark, sf)[0].select("trip_id", txt().alias("ids"))


@query(f"WITH {KG} SELECT trip_id, array_to_string(list_concat(first(g ORDER BY i), list_transform(list(g ORDER BY i)[2:], lambda x: x[2])), '-') AS path FROM enc GROUP BY trip_id")
def kgram_decode(spark, sf):
    encoded, vocab_ = _kgram_encoded(spark, sf)
    return W.kgram_decode(encoded, vocab_).select("trip_id", txt().alias("path"))


@query(f"""WITH {LI}, known AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT DISTINCT node FROM li WHERE trip_id % 5 <> 0))
SELECT trip_id, string_agg(CAST(idx AS VARCHAR), '-' ORDER BY pos) AS path FROM li JOIN known USING (node) GROUP BY trip_id""")
def categorical_encode(spark, sf):
    """Dense ids from the training trips; nodes that those never visit are dropped."""
    paths = T.supplier_paths(spark, sf)
    return W.encode(paths, W.vocabulary(paths.where(TRAIN))).select("trip_id", txt().alias("path"))


@query(f"WITH {LI} SELECT trip_id, string_agg(CAST(node % 7 AS VARCHAR), '-' ORDER BY pos) AS path FROM li GROUP BY trip_id")
def cluster_encode(spark, sf):
    """Nodes to clusters through a dimension table; lengths stay."""
    paths = T.supplier_paths(spark, sf)
    dim = T.coordinates(spark, sf).select("node", (F.col("node") % 7).cast("bigint").alias("idx"))
    return W.encode(paths, dim).select("trip_id", txt().alias("path"))


@query(f"""WITH {LI}, known AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT DISTINCT node FROM li WHERE trip_id % 5 <> 0)), t AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY pos DESC) AS r FROM li)
SELECT trip_id, string_agg(CAST(idx AS VARCHAR), '-' ORDER BY pos) AS ctx FROM t LEFT JOIN known USING (node) WHERE r <= 3 GROUP BY trip_id""")
def context_encode(spark, sf):
    """The last three nodes of each path as dense ids; null where none is known."""
    paths = T.supplier_paths(spark, sf)
    tails = paths.select("trip_id", P.tail(F.col("path"), 3).alias("path"))
    encoded = W.encode(tails, W.vocabulary(paths.where(TRAIN)))
    return tails.select("trip_id").join(encoded, "trip_id", "left").select("trip_id", txt().alias("ctx"))


@query(f"WITH {EV} SELECT trip_id, array_to_string(path[greatest(len(path)-4,1):], '-') AS tail FROM trip")
def last_frame(spark, sf):
    return T.event_paths(spark, sf).select("trip_id", P.text(P.tail(F.col("path"), 5)).alias("tail"))


@query(f"WITH {EV} SELECT trip_id, user_id, CAST(pos AS INTEGER) AS pos, node, lead(node) OVER w AS next1, lead(node, 2) OVER w AS next2 FROM ev WINDOW w AS (PARTITION BY trip_id ORDER BY pos)")
def bigram_lags(spark, sf):
    return W.lags(T.event_paths(spark, sf))


HIST = EV + f", hist AS (SELECT user_id, list_reverse(list_reverse(flatten(list(path ORDER BY trip_id)))[:{W.HISTORY}]) AS nodes FROM train GROUP BY user_id)"


@query(f"WITH {HIST} SELECT user_id, array_to_string(nodes, '-') AS nodes FROM hist")
def user_history(spark, sf):
    return W.histories(T.event_paths(spark, sf).where(TRAIN), "user_id", "trip_id", W.HISTORY).select("user_id", txt("nodes").alias("nodes"))


HNG = HIST + """, hng AS (SELECT user_id, k, nodes[i-k+1:i] AS ctx, nodes[i+1] AS nxt, count(*) AS cnt
  FROM (SELECT user_id, nodes, unnest(range(1, len(nodes))) AS i FROM hist), (SELECT unnest(range(1, 4)) AS k) WHERE k <= i GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {HNG} SELECT user_id, CAST(k AS INTEGER) AS k, array_to_string(ctx, '-') AS ctx, nxt AS next, cnt FROM hng")
def history_windows(spark, sf):
    own = W.history_ngrams(W.histories(T.event_paths(spark, sf).where(TRAIN), "user_id", "trip_id", W.HISTORY), "user_id", 3)
    return own.select("user_id", "k", txt("ctx").alias("ctx"), "next", "cnt")


@query(f"WITH {HNG} SELECT user_id, CAST(k AS INTEGER) AS k, array_to_string(ctx, '-') AS ctx FROM hng GROUP BY user_id, k, hng.ctx")
def history_kgrams(spark, sf):
    own = W.history_ngrams(W.histories(T.event_paths(spark, sf).where(TRAIN), "user_id", "trip_id", W.HISTORY), "user_id", 3)
    return own.select("user_id", "k", "ctx").distinct().select("user_id", "k", txt("ctx").alias("ctx"))


@query(f"""WITH {HNG}, w AS (SELECT DISTINCT user_id, path[i+1:i+5] AS ctx FROM (SELECT *, unnest(range(0, len(path) - 5)) AS i FROM test)),
s AS (SELECT user_id, ctx, k, ctx[len(ctx)-k+1:] AS s FROM w, (SELECT unnest(range(1, 4)) AS k))
SELECT s.user_id, array_to_string(s.ctx, '-') AS ctx, CAST(coalesce(max(h.k), 0) AS INTEGER) AS k FROM s LEFT JOIN (SELECT DISTINCT user_id, k, ctx FROM hng) h ON h.user_id = s.user_id AND h.k = s.k AND h.ctx = s.s GROUP BY s.user_id, s.ctx""")
def longest_suffix_match(spark, sf):
    ev = T.event_paths(spark, sf)
    own = W.history_ngrams(W.histories(ev.where(TRAIN), "user_id", "trip_id", W.HISTORY), "user_id", 3)
    contexts = W.samples(ev.where(TEST), 5).select("user_id", "ctx").distinct()
    return W.longest_match(contexts, W.rows_of(own, ["user_id"]), 3, ["user_id"]).select("user_id", txt("ctx").alias("ctx"), "k")


@query(f"WITH {EV}, o AS (SELECT trip_id, row_number() OVER (ORDER BY trip_id) - 1 AS i, count(*) OVER () AS n FROM trip) SELECT trip_id, CAST((i // greatest(n // 14, 1)) % 14 AS INTEGER) AS day FROM o")
def day_assignment(spark, sf):
    """Trips in equal blocks over 14 days."""
    trips = W.ranked(T.event_paths(spark, sf).select("trip_id").distinct(), "trip_id", "i")
    n = trips.agg(F.count("*").alias("n"))
    return trips.join(F.broadcast(n)).select("trip_id", F.expr("cast(pmod(i div greatest(n div 14, 1L), 14) as int)").alias("day"))


@query(f"WITH {EV}, x AS (SELECT trip_id, len(path) AS n FROM trip) SELECT trip_id, round(1 / (SELECT sum(exp(-0.5 * j)) FROM range(0, n) t(j)), 6) AS newest FROM x")
def decay_weights(spark, sf):
    return T.event_paths(spark, sf).select("trip_id", F.round(F.element_at(P.decay(F.col("path")), -1), 6).alias("newest"))


@query(f"""WITH {EV}, r AS (SELECT trip_id, 1.0 * pos AS x, CASE WHEN pos = 0 THEN path[:2] ELSE path[pos+1:pos+2] END AS seg FROM (SELECT trip_id, path, unnest(range(0, len(path) - 1)) AS pos FROM trip WHERE len(path) > 1))
SELECT trip_id, array_to_string(path, '-') AS path FROM trip WHERE len(path) > 1""")
def route_stitch(spark, sf):
    """Segments between neighbours, concatenated back into the path."""
    paths = W.at_least(T.event_paths(spark, sf), 2)
    return paths.select("trip_id", P.text(P.stitch(P.kgrams(F.col("path"), 2))).alias("path"))


# counts


@query(f"WITH {EV}, {ngrams(3)} SELECT CAST(k AS INTEGER) AS k, array_to_string(ctx, '-') AS ctx, nxt AS next, cnt FROM ng")
def ngram_counts(spark, sf):
    return W.ngrams(T.event_paths(spark, sf).where(TRAIN), 3).select("k", txt("ctx").alias("ctx"), "next", "cnt")


@query(f"""WITH {EV}, w AS (SELECT path[i+1:i+5] AS c FROM (SELECT path, unnest(range(0, len(path) - 5)) AS i FROM train))
SELECT CAST(k AS INTEGER) AS k, array_to_string(c[p:p+k-1], '-') AS ctx, c[p+k] AS next, count(*) AS cnt
FROM (SELECT c, k, unnest(range(1, 6 - k)) AS p FROM w, (SELECT unnest(range(1, 5)) AS k)) GROUP BY 1, 2, 3""")
def ngram_counts_overlap(spark, sf):
    """Counts over overlapping windows, from the closed form; the SQL makes the windows."""
    return W.overlap_ngrams(T.event_paths(spark, sf).where(TRAIN), 5, 10).select("k", txt("ctx").alias("ctx"), "next", "cnt")


RAMP = """ramp AS (SELECT least(i, 3) AS k, path[i-least(i,3)+1:i] AS ctx, path[i+1] AS nxt, count(*) AS cnt FROM (SELECT path, unnest(range(1, len(path))) AS i FROM train) GROUP BY 1, 2, 3),
term AS (SELECT least(len(path), 3) AS k, path[len(path)-least(len(path),3)+1:] AS ctx, count(*) AS cnt FROM train GROUP BY 1, 2), start AS (SELECT path[1] AS node, count(*) AS cnt FROM train GROUP BY 1)"""


@query(f"""WITH {EV}, {RAMP} SELECT 'move' AS kind, CAST(k AS INTEGER) AS k, array_to_string(ctx, '-') AS ctx, nxt AS next, cnt FROM ramp
UNION ALL SELECT 'end', CAST(k AS INTEGER), array_to_string(ctx, '-'), NULL, cnt FROM term UNION ALL SELECT 'start', 0, '', node, cnt FROM start""")
def rampup_counts(spark, sf):
    start, moves, ends = W.rampup(T.event_paths(spark, sf).where(TRAIN), 3)
    none = F.lit(None).cast("int")
    return (
        moves.select(F.lit("move").alias("kind"), "k", txt("ctx").alias("ctx"), "next", "cnt")
        .unionByName(ends.select(F.lit("end").alias("kind"), "k", txt("ctx").alias("ctx"), none.alias("next"), "cnt"))
        .unionByName(start.select(F.lit("start").alias("kind"), F.lit(0).alias("k"), F.lit("").alias("ctx"), F.col("node").alias("next"), "cnt"))
    )


@query(f"WITH {LI}, p AS (SELECT node AS a, lead(node) OVER (PARTITION BY trip_id ORDER BY pos) AS b FROM li) SELECT DISTINCT a AS source, b AS target FROM p WHERE b IS NOT NULL")
def observed_edges(spark, sf):
    return W.ngrams(T.supplier_paths(spark, sf), 1).select(F.get("ctx", F.lit(0)).alias("source"), F.col("next").alias("target")).distinct()


MC1 = EV + ", " + ngrams(2)


@query(f"WITH {MC1} SELECT ctx[1] AS node, nxt AS next, cnt, CAST(sum(cnt) OVER (PARTITION BY ctx) AS BIGINT) AS total FROM ng WHERE k = 1")
def mc1_table(spark, sf):
    one = W.ngrams(T.event_paths(spark, sf).where(TRAIN), 1)
    return one.select(F.get("ctx", F.lit(0)).alias("node"), "next", "cnt", F.sum("cnt").over(Window.partitionBy("ctx")).alias("total"))


@query(f"WITH {MC1} SELECT ctx[1] AS prev, ctx[2] AS node, nxt AS next, cnt FROM ng WHERE k = 2")
def bigram_table(spark, sf):
    return W.ngrams(T.event_paths(spark, sf).where(TRAIN), 2, 2).select(F.get("ctx", F.lit(0)).alias("prev"), F.get("ctx", F.lit(1)).alias("node"), "next", "cnt")


@query(f"""WITH {LI}, e AS (SELECT node AS a, lead(node) OVER (PARTITION BY trip_id ORDER BY pos) AS b FROM li), c AS (SELECT a, b, count(*) AS n FROM e WHERE b IS NOT NULL GROUP BY 1, 2),
p AS (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS p FROM c) SELECT b AS node, round(sum(p) / (SELECT count(DISTINCT node) FROM li), 6) AS mean_p FROM p GROUP BY b""")
def column_mean(spark, sf):
    """Mean over all rows of the row-normalised first-order matrix, rows without counts included."""
    paths = T.supplier_paths(spark, sf)
    one = W.ngrams(paths, 1)
    p = one.withColumn("p", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("ctx")))
    size = paths.select(F.explode("path").alias("node")).agg(F.countDistinct("node").alias("v"))
    sums = p.groupBy(F.col("next").alias("node")).agg(F.sum("p").alias("s"))
    return sums.join(F.broadcast(size)).select("node", F.round(F.col("s") / F.col("v"), 6).alias("mean_p"))


@query(f"WITH {LI} SELECT node, count(*) AS visits FROM li GROUP BY node")
def node_prior(spark, sf):
    return W.steps(T.supplier_paths(spark, sf)).groupBy("node").agg(F.count("*").alias("visits"))


@query(f"""WITH {LI}, c AS (SELECT CAST(s_suppkey AS INTEGER) AS node, s_suppkey % 7 AS cluster, coalesce(n, 0) AS n FROM supplier LEFT JOIN (SELECT node, count(*) AS n FROM li GROUP BY node) v ON v.node = s_suppkey)
SELECT node, cluster, round((n + 1) / sum(n + 1) OVER (PARTITION BY cluster), 6) AS p FROM c""")
def within_cluster_prior(spark, sf):
    visits = W.steps(T.supplier_paths(spark, sf)).groupBy("node").agg(F.count("*").alias("n"))
    rows = T.coordinates(spark, sf).select("node", (F.col("node") % 7).cast("bigint").alias("cluster")).join(visits, "node", "left")
    share = F.coalesce("n", F.lit(0)) + 1
    return rows.select("node", "cluster", F.round(share / F.sum(share).over(Window.partitionBy("cluster")), 6).alias("p"))


@query(f"WITH {EV}, {ngrams(3)} SELECT CAST(k AS INTEGER) AS k, count(DISTINCT ctx) AS contexts, count(*) AS entries, CAST(sum(cnt) AS BIGINT) AS evidence FROM ng GROUP BY k")
def evidence_totals(spark, sf):
    rows = W.rows_of(W.ngrams(T.event_paths(spark, sf).where(TRAIN), 3))
    return rows.groupBy("k").agg(F.count("*").alias("contexts"), F.sum(F.size("nexts")).cast("bigint").alias("entries"), F.sum("n").alias("evidence"))
