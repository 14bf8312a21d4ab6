"""The plans behind the queries: what they read, and that counts and predictions stay inside the engine."""

import re

import pytest

from pathmix import catalog

JVM_ONLY = [n for n in sorted(catalog.QUERIES) if n not in {
    "beam_search", "od_generation", "rollout_blended", "rollout_mc", "rollout_scores", "ar_metrics", "full_path_evaluation",  # loops write their steps
    "shortest_paths", "transition_routing", "converted_trips", "unroutable_pairs", "clean_routes",  # routes run per source
    "iohmm_predict", "node_clusters", "node_embedding", "bfs_hops", "shortest_costs", "pagerank", "nearest_node", "mapping_statistics", "mogen_dof", "mogen_aic",
}]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JVM_ONLY)
def test_no_python_and_no_products(spark, sf, name):
    text = plan(catalog.QUERIES[name](spark, sf))
    assert not re.search(r"Python|Pandas|Arrow|CartesianProduct", text)


@pytest.mark.parametrize(("name", "columns"), [("ngram_counts", 4), ("metrics_hwmc3", 4), ("node_prior", 7), ("network_extent", 1), ("windowed_counts", 2)])
def test_scans_read_what_they_need(spark, sf, name, columns):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(catalog.QUERIES[name](spark, sf)))
    assert schemas and all(s.count(":") <= columns for s in schemas)


def test_count_tables_prune_orders(spark, sf, tmp_path):
    from pathmix.operators import windows as W
    from pathmix.sources import files, tables

    files.write_counts(W.ngrams(tables.event_paths(spark, sf), 3), str(tmp_path / "c"))
    text = plan(files.read_counts(spark, str(tmp_path / "c"), 1))
    assert re.search(r"PartitionFilters: \[[^\]]*k#\d+ <= 1", text)


def test_one_join_per_prediction(spark, sf):
    """All orders of a prediction come from one equi-join of suffixes; nothing joins per order."""
    one, many = (plan(catalog.QUERIES[n](spark, sf)) for n in ("mc_backoff_k2", "mc_backoff_k5"))
    assert len(re.findall("Join ", one)) == len(re.findall("Join ", many))
