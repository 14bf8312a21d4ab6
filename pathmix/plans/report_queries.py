"""Queries over metric records, trip tables, orders, the hidden Markov predictor and online memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import paths as P
from ..operators import iohmm as H
from ..operators import orders as N
from ..operators import prepare as R
from ..operators import report as B
from ..operators import windows as W
from ..sources import tables as T
from ..streaming import memory as S
from .model_queries import AGG, SQL_AKOM, SQL_CPT, SQL_HW, SQL_MOGEN, data, dense, score_sql, sql_backoff
from .path_queries import RAMP, TRAIN
from .registry import EV, GEO, LI, ROAD, WIN, query
from .rollout_queries import KEY, S42

REC = """rec0 AS (SELECT l_returnflag AS dataset, l_linenumber % 3 AS split, CASE l_suppkey % 4 WHEN 0 THEN 'MC2' WHEN 1 THEN 'MC10P' WHEN 2 THEN 'HWMC5' ELSE 'MC5' END AS model, round(avg(l_discount), 8) AS acc1, round(avg(l_tax), 8) AS nll FROM lineitem GROUP BY 1, 2, 3),
rec AS (SELECT dataset, split, model, 'acc1' AS metric, acc1 AS value FROM rec0 UNION ALL SELECT dataset, split, model, 'nll', nll FROM rec0),
mean AS (SELECT dataset, model, metric, avg(value) AS mean, CASE WHEN count(value) > 1 THEN stddev_pop(value) END AS std, count(value) AS splits FROM rec GROUP BY 1, 2, 3),
cross_ AS (SELECT model, metric, avg(mean) AS mean, CASE WHEN count(mean) > 1 THEN stddev_pop(mean) END AS std, count(mean) AS datasets FROM mean GROUP BY 1, 2)"""


def records(spark, sf):
    """Metric records: here shares over line items stand for metrics of four models on three datasets and splits."""
    x = T.read(spark, sf, "lineitem")
    model = F.when(F.col("l_suppkey") % 4 == 0, "MC2").when(F.col("l_suppkey") % 4 == 1, "MC10P").when(F.col("l_suppkey") % 4 == 2, "HWMC5").otherwise("MC5")
    rows = x.groupBy(F.col("l_returnflag").alias("dataset"), (F.col("l_linenumber") % 3).alias("split"), model.alias("model")).agg(F.round(F.avg("l_discount"), 8).alias("acc1"), F.round(F.avg("l_tax"), 8).alias("nll"))
    return rows.unpivot(["dataset", "split", "model"], ["acc1", "nll"], "metric", "value")


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query(f"WITH {REC} SELECT dataset, model, metric, round(mean, 6) AS mean, round(std, 6) AS std, splits FROM mean")
def split_mean_std(spark, sf):
    return B.over_splits(records(spark, sf)).select("dataset", "model", "metric", *r6("mean", "std"), "splits")


@query(f"WITH {REC} SELECT model, metric, round(mean, 6) AS mean, round(std, 6) AS std, datasets FROM cross_")
def dataset_mean(spark, sf):
    return B.over_datasets(records(spark, sf)).select("model", "metric", *r6("mean", "std"), "datasets")


@query(f"WITH {REC} SELECT model, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS n FROM rec GROUP BY 1, 2")
def pooled_mean(spark, sf):
    return B.pooled(records(spark, sf)).select("model", "metric", *r6("mean", "std"), "n")


@query(f"WITH {REC} SELECT model, round(max(mean) FILTER (WHERE metric = 'acc1'), 6) AS acc1, round(max(mean) FILTER (WHERE metric = 'nll'), 6) AS nll, round(max(mean) FILTER (WHERE metric = 'nll') / ln(2), 6) AS ic_bits FROM cross_ GROUP BY model")
def comparison_pivot(spark, sf):
    return B.wide(B.over_datasets(records(spark, sf)), ["acc1", "nll"]).select("model", *r6("acc1", "nll", "ic_bits"))


@query(f"WITH {REC} SELECT regexp_replace(model, '[0-9]+P?$', '') AS family, arg_min(model, (-mean, model)) AS model, round(max(mean), 6) AS mean FROM cross_ WHERE metric = 'acc1' GROUP BY 1")
def best_per_family(spark, sf):
    return B.best_per_family(B.over_datasets(records(spark, sf))).select("family", "model", *r6("mean"))


@query(f"WITH {REC} SELECT model, metric, abs(mean - CASE WHEN metric = 'nll' THEN min(mean) OVER w ELSE max(mean) OVER w END) <= 1e-12 AS best FROM cross_ WINDOW w AS (PARTITION BY metric)")
def best_cells(spark, sf):
    return B.marked(B.over_datasets(records(spark, sf))).select("model", "metric", "best")


@query(f"WITH {REC} SELECT model, metric, count(*) AS n, round(min(value), 6) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS high FROM rec GROUP BY 1, 2")
def box_groups(spark, sf):
    return B.boxes(records(spark, sf)).select("model", "metric", "n", *r6("low", "q1", "median", "q3", "high"))


@query(f"WITH {REC} SELECT model, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS low, round(max(value), 6) AS high, CAST(arg_max(split, (value, -split)) AS INTEGER) AS best_split FROM rec GROUP BY 1, 2")
def kfold_summary(spark, sf):
    return B.fold_summary(records(spark, sf)).select("model", "metric", *r6("mean", "std", "low", "high"), "best_split")


@query(f"""WITH {REC}, m AS (SELECT DISTINCT model, CASE regexp_replace(model, '[0-9]+P?$', '') WHEN 'MC' THEN 1 WHEN 'HWMC' THEN 0 ELSE 99 END AS g, regexp_replace(model, '[0-9]+P?$', '') AS f, CAST(regexp_extract(model, '([0-9]+)P?$', 1) AS INTEGER) AS o FROM rec)
SELECT model, CAST(row_number() OVER (ORDER BY g, f, o, model) AS INTEGER) AS place FROM m""")
def model_order(spark, sf):
    return B.ordered(records(spark, sf).select("model").distinct(), {"HWMC": 0, "MC": 1}).select("model", "place")


@query(f"WITH {REC}, n AS (SELECT * FROM rec WHERE model = 'MC2'), o AS (SELECT dataset, split, model, metric, value + 1 AS value FROM rec WHERE dataset <> 'N' OR model <> 'MC5') SELECT dataset, CAST(split AS INTEGER) AS split, model, metric, round(value, 6) AS value FROM n UNION ALL SELECT dataset, CAST(split AS INTEGER), model, metric, round(value, 6) FROM o WHERE (dataset, model) NOT IN (SELECT dataset, model FROM n)")
def merge_results(spark, sf):
    rec = records(spark, sf)
    old = rec.where("dataset <> 'N' or model <> 'MC5'").withColumn("value", F.col("value") + 1)
    return B.merged(old, rec.where("model = 'MC2'")).select("dataset", "split", "model", "metric", *r6("value"))


# trips


TRIPS = f"""{LI}, {GEO}, legs AS (SELECT trip_id, pos, node, lead(node) OVER (PARTITION BY trip_id ORDER BY pos) AS b FROM li),
kms AS (SELECT trip_id, coalesce(sum(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2))))), 0) AS km FROM legs JOIN geo x ON x.node = legs.node LEFT JOIN geo y ON y.node = b GROUP BY trip_id),
t AS (SELECT op.trip_id, op.path, km, trip_id % 500 AS u, CASE WHEN km > 0 THEN km / 30.0::DOUBLE * 60 ELSE 10.0::DOUBLE END AS minutes, TIMESTAMP '2024-10-21 06:00:00' + to_days(CAST(trip_id % 14 AS INTEGER)) + to_hours(6 + trip_id % 18) + to_minutes(trip_id * 7 % 60) AS dep FROM op JOIN kms USING (trip_id))"""


@query(f"""WITH {TRIPS} SELECT printf('user_%05d', u) AS user_id, CAST(dep AS DATE) AS date, CASE WHEN u % 10 = 0 THEN 'driver' ELSE 'passenger' END AS role, 1000000 + trip_id AS orig_trip_id, path[1] AS origin_node, path[len(path)] AS destination_node,
array_to_string(path, ',') AS q_path, CASE WHEN u % 10 = 0 THEN 3 ELSE 0 END AS capacity, CASE WHEN u % 10 = 0 THEN 1.5::DOUBLE END AS tau, dep AS earliest_departure FROM t""")
def trip_table(spark, sf):
    """Synthetic trip columns; lengths and durations are compared in trip_statistics."""
    return _trips(spark, sf).select("user_id", "date", "role", "orig_trip_id", "origin_node", "destination_node", "q_path", "capacity", F.col("tau").cast("double").alias("tau"), "earliest_departure")


def _trips(spark, sf):
    c = T.coordinates(spark, sf)
    paths = T.supplier_paths(spark, sf)
    legs = W.lags(paths).select("trip_id", "node", F.col("next1").alias("b")).join(c, "node").join(c.select(F.col("node").alias("b"), F.col("lon").alias("x2"), F.col("lat").alias("y2")), "b", "left")
    km = legs.groupBy("trip_id").agg(F.coalesce(F.sum(G.haversine_km(F.col("lon"), F.col("lat"), F.col("x2"), F.col("y2"))), F.lit(0.0)).alias("km"))
    return R.trip_table(paths.join(km, "trip_id"), F.col("km"))


@query(f"""WITH {TRIPS} SELECT count(*) AS trips, count(DISTINCT u) AS users, CAST(count(*) FILTER (WHERE u % 10 = 0) AS BIGINT) AS drivers, round(avg(km), 2) AS mean_km, round(max(km), 2) AS max_km, round(avg(minutes), 1) AS mean_min, CAST(count(DISTINCT CAST(dep AS DATE)) AS BIGINT) AS dates FROM t""")
def trip_statistics(spark, sf):
    t = _trips(spark, sf)
    return t.agg(
        F.count("*").alias("trips"), F.countDistinct("user_id").alias("users"), F.count(F.when(F.col("role") == "driver", 1)).alias("drivers"), F.round(F.avg("q_km"), 2).alias("mean_km"),
        F.round(F.max("q_km"), 2).alias("max_km"), F.round(F.avg("trip_duration_min"), 1).alias("mean_min"), F.countDistinct("date").alias("dates"),
    )


@query(f"WITH {EV} SELECT user_id, count(*) AS trips, CAST(sum(len(path)) AS BIGINT) AS steps, CAST(max(len(path)) AS INTEGER) AS longest, count(DISTINCT path) AS routes FROM trip GROUP BY user_id")
def user_summary(spark, sf):
    return T.event_paths(spark, sf).groupBy("user_id").agg(F.count("*").alias("trips"), F.sum(F.size("path")).alias("steps"), F.max(F.size("path")).alias("longest"), F.countDistinct("path").alias("routes"))


@query(f"WITH {EV} SELECT trip_id, user_id, CAST(len(path) AS INTEGER) AS n FROM trip QUALIFY row_number() OVER (ORDER BY len(path) DESC, trip_id) = 1")
def longest_path(spark, sf):
    return T.event_paths(spark, sf).select("trip_id", "user_id", F.size("path").alias("n")).orderBy(F.desc("n"), "trip_id").limit(1)


@query(f"""WITH {TRIPS}{ROAD[len(LI):]}, q AS (SELECT u, path[1] AS a, path[len(path)] AS b, array_to_string(path, ',') AS text, path FROM t)
SELECT 'missing_columns' AS "check", CAST(0 AS BIGINT) AS bad
UNION ALL SELECT 'null_user_id', count(*) FILTER (WHERE u IS NULL) FROM q UNION ALL SELECT 'null_role', count(*) FILTER (WHERE u IS NULL) FROM q
UNION ALL SELECT 'null_origin_node', count(*) FILTER (WHERE a IS NULL) FROM q UNION ALL SELECT 'null_destination_node', count(*) FILTER (WHERE b IS NULL) FROM q UNION ALL SELECT 'null_q_path', count(*) FILTER (WHERE text IS NULL) FROM q
UNION ALL SELECT 'ends_differ', count(*) FILTER (WHERE CAST(string_split(text, ',')[1] AS INTEGER) <> a OR CAST(string_split(text, ',')[-1] AS INTEGER) <> b) FROM q
UNION ALL SELECT 'short_paths', count(*) FILTER (WHERE len(path) < 2) FROM q UNION ALL SELECT 'unknown_nodes', count(*) FROM (SELECT unnest(path) AS node FROM q) WHERE node NOT IN (SELECT node FROM geo)
UNION ALL SELECT 'implausible_places', count(*) FILTER (WHERE NOT (lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90)) FROM geo UNION ALL SELECT 'unknown_sources', count(*) FROM road WHERE source NOT IN (SELECT node FROM geo)""")
def validate_trips(spark, sf):
    """Every check of a trip table against its network."""
    c = T.coordinates(spark, sf)
    return R.validate(_trips(spark, sf), c, T.road(spark, sf))


@query()
def converted_trips(spark, sf):
    """Raw cells, snapped, routed, stitched and freed of loops."""
    road = T.road(spark, sf)
    raw = T.supplier_paths(spark, sf).select("trip_id", F.concat("path", F.array(F.lit(0), F.lit(0))).alias("cells"))
    mapping = T.coordinates(spark, sf).select(F.col("node").alias("cell"), "node")
    return R.converted(raw, mapping, road).select("trip_id", P.text(F.col("path")).alias("path"))


@query()
def transition_routing(spark, sf):
    """Transition counts spread over routed edges."""
    from ..operators import graph

    road = T.road(spark, sf)
    one = W.ngrams(T.supplier_paths(spark, sf), 1).select(F.get("ctx", F.lit(0)).alias("source"), F.col("next").alias("target"), F.col("cnt").alias("n")).where("source <> target")
    return R.edge_counts(graph.routes(road, one, ("n",)).where("path is not null"))


# orders


@query(f"""WITH RECURSIVE {LI}, e AS (SELECT DISTINCT a, b FROM (SELECT node AS a, lead(node) OVER (PARTITION BY trip_id ORDER BY pos) AS b FROM li) WHERE b IS NOT NULL),
w(k, node, w) AS (SELECT 1, b, count(*)::DOUBLE FROM e GROUP BY b UNION ALL SELECT k, node, w FROM (SELECT w.k + 1 AS k, e.b AS node, sum(w.w) AS w FROM w JOIN e ON e.a = w.node WHERE w.k < 3 GROUP BY w.k, e.b))
SELECT CAST(k AS INTEGER) AS k, sum(w) AS walks FROM w GROUP BY k""")
def mogen_dof(spark, sf):
    """Walks of each length over the observed edges."""
    one = W.ngrams(T.supplier_paths(spark, sf), 1)
    return N.walks_of_length(one.select(F.get("ctx", F.lit(0)).alias("source"), F.col("next").alias("target")), 3)


def _ll(k: int) -> str:
    ramp = RAMP.replace("GROUP BY 1, 2, 3", "GROUP BY ALL").replace(", 3)", f", {k})").replace(",3)", f",{k})").replace("ramp AS", f"ramp{k} AS").replace("term AS", f"term{k} AS").replace("start AS", f"start{k} AS")
    return ramp + f""", tot{k} AS (SELECT k, ctx, sum(cnt) AS n FROM (SELECT k, ctx, cnt FROM ramp{k} UNION ALL SELECT k, ctx, cnt FROM term{k}) GROUP BY 1, 2),
ll{k} AS (SELECT {k} AS k, (SELECT sum(cnt * ln((cnt + 0.2) / (t + 1.0))) FROM start{k}, (SELECT sum(cnt) AS t FROM start{k})) + (SELECT sum(cnt * ln((cnt + 0.2) / (n + 1.2))) FROM ramp{k} JOIN tot{k} USING (k, ctx)) + (SELECT sum(cnt * ln((cnt + 0.2) / (n + 1.2))) FROM term{k} JOIN tot{k} USING (k, ctx)) AS ll)"""


@query(f"""WITH {EV}, {_ll(1)}, {_ll(2)}, {_ll(3)}, a AS (SELECT * FROM ll1 UNION ALL SELECT * FROM ll2 UNION ALL SELECT * FROM ll3), s AS (SELECT k, ll, (pow(5, k + 2) - 25) / 4 AS dof FROM a)
SELECT CAST(k AS INTEGER) AS k, round(dof, 3) AS dof, round(ll, 3) AS ll, round(dof - ll, 3) AS score, k = (SELECT arg_min(k, dof - ll) FROM s) AS chosen FROM s""")
def mogen_aic(spark, sf):
    """All 25 pairs of the five nodes occur, so walks of k steps number 5^(k+1)."""
    train = T.event_paths(spark, sf).where(TRAIN)
    one = W.ngrams(train, 1).select(F.get("ctx", F.lit(0)).alias("source"), F.col("next").alias("target"))
    return N.criterion(train, one, 3, 5).select("k", *[F.round(c, 3).alias(c) for c in ("dof", "ll", "score")], "chosen")


@query()
def iohmm_predict(spark, sf):
    train, windows = data(spark, sf)
    model = H.HiddenMarkov(10, 50).fit(train, 5)
    return dense(H.predict(train, model, windows))


# online memory


@query(f"WITH {EV} SELECT user_id, trip_id, CAST(pos AS INTEGER) AS pos, array_to_string(list(node) OVER (PARTITION BY user_id ORDER BY trip_id, pos ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '-') AS memory FROM ev")
def online_memory_batch(spark, sf):
    rows = S.batch(T.event_steps(spark, sf), 6, order=("trip_id", "pos"))
    return rows.select("user_id", "trip_id", "pos", F.when(F.size("memory") > 0, P.text(F.col("memory"))).alias("memory"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type AS node, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf):
    """Event-time windows; the same function runs on streams."""
    rows = T.read(spark, sf, "events").select("ts", F.col("event_type").alias("node"))
    return S.windowed_counts(rows.withColumn("ts", F.col("ts").cast("timestamp")), length="6 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS end, count(*) AS n FROM s GROUP BY user_id, s""")
def user_sessions(spark, sf):
    rows = T.read(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return S.sessions(rows, "12 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def _records_sql() -> str:
    """One row of scores per fold and predictor, as records."""
    fold = f"CAST({KEY.format(c='trip_id', s=S42)} % 2 AS INTEGER)"
    rows = []
    for split in (0, 1):
        base = EV.split("train AS")[0] + f"train AS (SELECT * FROM trip WHERE {fold} <> {split}), test AS (SELECT * FROM trip WHERE {fold} = {split})" + WIN[len(EV) :]
        for name, sql in (("mc3", sql_backoff(3)), ("hwmc3", SQL_HW), ("akom3", SQL_AKOM), ("cpt5", SQL_CPT), ("mogen3", SQL_MOGEN)):
            rows.append(f"(WITH {base}, {sql}, {score_sql()} SELECT 'events' AS dataset, {split} AS split, '{name}' AS model, {AGG} FROM sc)")
    return f"WITH r AS ({' UNION ALL '.join(rows)}) SELECT dataset, split, model, metric, value FROM r UNPIVOT (value FOR metric IN (acc1, acc3, acc5, mrr, nll, brier, ndcg5))"


@query(_records_sql())
def evaluation_records(spark, sf):
    """All count-based predictors over two folds: what the reports above aggregate."""
    from ..operators import registry, splits

    folded = splits.folds(T.event_paths(spark, sf), "trip_id", 2)
    out = None
    for split in (0, 1):
        train, test = (folded.where(F.col("fold") != split), folded.where(F.col("fold") == split))
        part = registry.evaluate(train.drop("fold"), W.samples(test.drop("fold"), 5), ["mc3", "hwmc3", "akom3", "cpt5", "mogen3"], "events", split)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("value", F.round("value", 6))
