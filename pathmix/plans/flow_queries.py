"""Queries over selections of records, traces, samples and small expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import distributions as D
from ..operators import flow
from ..operators import graph as R
from ..operators import models as M
from ..operators import report as B
from ..operators import score as S
from ..operators import splits as L
from ..sources import tables as T
from .model_queries import BACK, data, predicted, score_sql, sql_backoff
from .path_queries import TRAIN
from .registry import EV, WIN, query
from .report_queries import REC, records
from .rollout_queries import KEY, S42


@query(f"WITH {REC} SELECT * FROM rec WHERE split IN (0, 2)")
def selected_splits(spark, sf):
    return B.of_splits(records(spark, sf), [0, 2])


@query(f"WITH {REC} SELECT 'set_' || dataset AS dataset, split, model, metric, value FROM rec WHERE dataset IN ('A', 'N')")
def selected_networks(spark, sf):
    """Data sets are named set_A, set_N and set_R."""
    return B.of_networks(records(spark, sf).withColumn("dataset", F.concat(F.lit("set_"), "dataset")), ["A", "N"])


@query(f"WITH {REC} SELECT * FROM rec")
def selected_networks_none(spark, sf):
    """No data set bears the name, so all are kept."""
    return B.of_networks(records(spark, sf), ["none"])


@query(f"WITH {REC} SELECT * FROM rec WHERE dataset <> 'A'")
def without_embeddings(spark, sf):
    """The models of one data set are marked as encoded by embeddings."""
    marked = records(spark, sf).withColumn("model", F.when(F.col("dataset") == "A", F.concat("model", F.lit("_ge"))).otherwise(F.col("model")))
    return B.without_embeddings(marked)


@query(f"WITH {EV} SELECT trip_id, round(max(node) + ln(sum(exp(node - m))), 6) AS lse FROM (SELECT trip_id, node, max(node) OVER (PARTITION BY trip_id) AS m FROM ev) GROUP BY trip_id")
def log_sum_exp(spark, sf):
    values = F.transform("path", lambda x: x.cast("double"))
    return T.event_paths(spark, sf).select("trip_id", F.round(D.log_sum_exp(values), 6).alias("lse"))


@query(r"SELECT c_custkey, regexp_replace(c_name || '/' || c_custkey || ' é', '[^\p{L}\p{N}_-]', '_', 'g') AS name FROM customer")
def safe_names(spark, sf):
    name = F.concat("c_name", F.lit("/"), F.col("c_custkey").cast("string"), F.lit(" é"))
    return T.read(spark, sf, "customer").select("c_custkey", B.safe_name(name).alias("name"))


@query("""WITH x AS (SELECT s_suppkey AS node, CASE s_suppkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN 'Infinity'::DOUBLE ELSE s_suppkey * 0.5::DOUBLE END AS v FROM supplier),
m AS (SELECT avg(v) AS m FROM x WHERE isfinite(v)) SELECT node, round(CASE WHEN isfinite(v) THEN v ELSE m END, 6) AS v FROM x, m""")
def imputed_features(spark, sf):
    r = F.col("s_suppkey") % 7
    v = F.when(r == 1, float("nan")).when(r == 2, float("inf")).when(r > 2, F.col("s_suppkey") * 0.5)
    rows = T.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), v.cast("double").alias("v"))
    return R.imputed(rows, ["v"]).select("node", F.round("v", 6).alias("v"))


@query(f"WITH {EV} SELECT user_id, array_to_string(flatten(list(path ORDER BY {KEY.format(c='trip_id', s=S42)}, trip_id)), '-') AS nodes FROM train GROUP BY user_id")
def shuffled_history(spark, sf):
    own = L.shuffled_histories(T.event_paths(spark, sf).where(TRAIN), "user_id", "trip_id")
    return own.select("user_id", P.text(F.col("nodes")).alias("nodes"))


@query(f"WITH {WIN}, k AS (SELECT trip_id, pos, trip_id % 1000003 * 1009 + pos AS c FROM win) SELECT trip_id, pos, CASE WHEN {KEY.format(c='c', s=S42)} < 200000 THEN 'test' ELSE 'train' END AS split FROM k")
def window_split(spark, sf):
    return L.by_window(data(spark, sf)[1]).select("trip_id", "pos", "split")


@query(f"WITH {EV} SELECT trip_id, array_to_string(path, '-') AS path FROM trip ORDER BY {KEY.format(c='trip_id', s=S42)}, trip_id LIMIT 1")
def random_path(spark, sf):
    return L.pick(T.event_paths(spark, sf), "trip_id").select("trip_id", P.text(F.col("path")).alias("path"))


@query(f"""{BACK}{sql_backoff(3)}, {score_sql()} SELECT trip_id, string_agg(CAST(target AS VARCHAR), '-' ORDER BY pos) AS truth, string_agg(CAST(top1 AS VARCHAR), '-' ORDER BY pos) AS pred FROM sc GROUP BY trip_id""")
def teacher_forced(spark, sf):
    """What back-off makes of every true context of a trip, beside what really follows."""
    _, windows = data(spark, sf)
    traced = flow.forced(flow.next_nodes(S.scored(windows, predicted(spark, sf, 3, M.backoff(3)))))
    return traced.select("trip_id", P.text(F.col("true")).alias("truth"), P.text(F.col("pred")).alias("pred"))
