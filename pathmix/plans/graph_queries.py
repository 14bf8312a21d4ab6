"""Queries over the supplier graph and its coordinates."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F


from ..functions import geo as G
from ..functions import paths as P
from ..operators import graph as R
from ..operators import windows as W
from ..operators.settled import cut
from ..sources import tables as T
from .registry import GEO, LI, ROAD, query

KM = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))))"
UND = "und AS (SELECT DISTINCT source, target FROM (SELECT source, target FROM road UNION ALL SELECT target, source FROM road) WHERE source <> target)"


def km(a: str, b: str) -> str:
    return KM.format(x1=f"{a}.lon", y1=f"{a}.lat", x2=f"{b}.lon", y2=f"{b}.lat")


def parts(spark, sf):
    return T.road(spark, sf), T.coordinates(spark, sf)


@query(f"WITH {ROAD} SELECT source, target, length FROM road")
def road_edges(spark, sf):
    return T.road(spark, sf)


@query(f"WITH {ROAD}, {UND} SELECT source, target FROM und")
def undirected_neighbors(spark, sf):
    return R.undirected(T.road(spark, sf))


@query(f"WITH {ROAD}, {GEO} SELECT geo.node, count(DISTINCT target) AS degree FROM geo LEFT JOIN road ON road.source = geo.node GROUP BY geo.node")
def out_degree(spark, sf):
    return R.out_degree(*parts(spark, sf))


@query(f"""WITH {ROAD}, {GEO}, o AS (SELECT source AS node, count(*) AS o FROM road GROUP BY 1), i AS (SELECT target AS node, count(*) AS i FROM road GROUP BY 1)
SELECT node, round(coalesce(i, 0) / (max(coalesce(i, 0)) OVER () + 1e-6), 6) AS in_degree, round(coalesce(o, 0) / (max(coalesce(o, 0)) OVER () + 1e-6), 6) AS out_degree FROM geo LEFT JOIN o USING (node) LEFT JOIN i USING (node)""")
def degree_features(spark, sf):
    return R.degree_features(*parts(spark, sf)).select("node", F.round("in_degree", 6).alias("in_degree"), F.round("out_degree", 6).alias("out_degree"))


@query(f"""WITH {ROAD}, {GEO}, {UND}, d AS (SELECT source AS node, count(*) AS d FROM und GROUP BY 1),
t AS (SELECT a.source AS node, count(*) AS t FROM und a JOIN und b ON b.source = a.source AND a.target < b.target JOIN und c ON c.source = a.target AND c.target = b.target GROUP BY 1)
SELECT node, round(CASE WHEN coalesce(d, 0) < 2 THEN 0.0 ELSE 2.0::DOUBLE * coalesce(t, 0) / (d * (d - 1)) END, 6) AS coefficient FROM geo LEFT JOIN d USING (node) LEFT JOIN t USING (node)""")
def clustering_coefficient(spark, sf):
    return R.clustering(*parts(spark, sf)).select("node", F.round("coefficient", 6).alias("coefficient"))


@query(f"""WITH RECURSIVE {ROAD}, {GEO}, n AS (SELECT count(*)::DOUBLE AS n FROM geo), o AS (SELECT source, count(*) AS k FROM road GROUP BY 1),
pr(node, r, step) AS (SELECT node, 1 / n, 0 FROM geo, n UNION ALL
SELECT node, r, step FROM (SELECT geo.node, 0.15 / (SELECT n FROM n) + 0.85 * (coalesce((SELECT sum(p.r / o.k) FROM pr p JOIN o ON o.source = p.node JOIN road e ON e.source = p.node WHERE e.target = geo.node), 0)
  + coalesce((SELECT sum(p.r) FROM pr p WHERE p.node NOT IN (SELECT source FROM o)), 0) / (SELECT n FROM n)) AS r, (SELECT max(step) FROM pr) + 1 AS step FROM geo) WHERE step <= 10)
SELECT node, round(r, 8) AS rank FROM pr WHERE step = 10""")
def pagerank(spark, sf):
    edges, nodes = parts(spark, sf)
    return R.pagerank(edges, nodes, 10).select("node", F.round("rank", 8).alias("rank"))


PAIRS = "trip_ends AS (SELECT DISTINCT path[1] AS source, path[len(path)] AS target FROM op)"


def _pairs(spark, sf):
    """Where trips begin and end: every such pair."""
    return T.supplier_paths(spark, sf).select(F.get("path", F.lit(0)).alias("source"), F.element_at("path", -1).alias("target")).distinct()


@query(f"""WITH RECURSIVE {ROAD}, {GEO}, {UND}, {PAIRS}, b(source, node, hops) AS (SELECT DISTINCT source, source, 0 FROM trip_ends UNION SELECT b.source, und.target, b.hops + 1 FROM b JOIN und ON und.source = b.node WHERE b.hops < 30)
, m AS (SELECT source, node, min(hops) AS hops FROM b GROUP BY 1, 2) SELECT p.source, p.target, CAST(coalesce(m.hops, 31) AS INTEGER) AS hops FROM trip_ends p LEFT JOIN m ON m.source = p.source AND m.node = p.target""")
def bfs_hops(spark, sf):
    edges, _ = parts(spark, sf)
    return R.hops(edges, _pairs(spark, sf))


SP = f"""WITH RECURSIVE {ROAD}, {GEO}, {PAIRS}, b(source, node, cost, step) AS (SELECT DISTINCT source, source, 0, 0 FROM trip_ends UNION ALL
SELECT source, node, cost, step FROM (SELECT source, node, min(cost) AS cost, max(step) AS step FROM (SELECT b.source, road.target AS node, b.cost + road.length AS cost, b.step + 1 AS step FROM b JOIN road ON road.source = b.node WHERE b.step < 25 UNION ALL SELECT source, node, cost, step + 1 FROM b WHERE b.step < 25) GROUP BY source, node)),
m AS (SELECT source, node, min(cost) AS cost FROM b GROUP BY 1, 2) SELECT p.source, p.target, CAST(m.cost AS DOUBLE) AS cost FROM trip_ends p LEFT JOIN m ON m.source = p.source AND m.node = p.target"""


@query(SP)
def shortest_paths(spark, sf):
    """Costs of routes; the paths themselves are tested against plain Python."""
    edges, _ = parts(spark, sf)
    return R.routes(edges, _pairs(spark, sf), paths=False)


@query(SP.replace("SELECT p.source, p.target, CAST(m.cost AS DOUBLE) AS cost FROM trip_ends p LEFT JOIN m ON m.source = p.source AND m.node = p.target", "SELECT source, CAST(node AS INTEGER) AS node, CAST(cost AS DOUBLE) AS cost FROM m"))
def shortest_costs(spark, sf):
    """The same to every node that a source reaches, by relaxing frontiers."""
    edges, _ = parts(spark, sf)
    return R.shortest_costs(edges, _pairs(spark, sf).select("source").distinct())


@query(f"WITH {GEO} SELECT a.node AS a, b.node AS b, round({km('a', 'b')}, 6) AS km FROM geo a JOIN geo b ON a.node < b.node AND b.node - a.node <= 3")
def haversine_pairs(spark, sf):
    c = T.coordinates(spark, sf)
    other = c.select(F.col("node").alias("b"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    rows = c.select(F.explode(F.sequence(F.col("node") + 1, F.col("node") + 3)).alias("b"), F.col("node").alias("a"), "lon", "lat").join(other, "b")
    return rows.select("a", "b", F.round(G.haversine_km(F.col("lon"), F.col("lat"), F.col("x2"), F.col("y2")), 6).alias("km"))


@query(f"""WITH {GEO} SELECT a.node AS a, b.node AS b, round(2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)), 6) AS km, round(111320.0 * sqrt(pow((b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)), 2) + pow(b.lat - a.lat, 2)), 3) AS flat_m,
round((t - floor(t)), 6) AS bearing FROM geo a JOIN geo b ON b.node = a.node + 1, LATERAL (SELECT pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h,
atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon))) / (2 * pi()) AS t)""")
def geo_variants(spark, sf):
    c = T.coordinates(spark, sf)
    other = c.select(F.col("node").alias("b"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    rows = c.select(F.col("node").alias("a"), (F.col("node") + 1).alias("b"), "lon", "lat").join(other, "b")
    args = [F.col(x) for x in ("lon", "lat", "x2", "y2")]
    return rows.select("a", "b", F.round(G.haversine_atan_km(*args), 6).alias("km"), F.round(G.flat_metres(*args), 3).alias("flat_m"), F.round(G.bearing(*args), 6).alias("bearing"))


LEGS = f"""WITH {LI}, {GEO}, legs AS (SELECT trip_id, node AS a, lead(node) OVER (PARTITION BY trip_id ORDER BY pos) AS b FROM li)"""


@query(f"{LEGS} SELECT trip_id, round(sum({km('x', 'y')}), 4) AS km FROM legs JOIN geo x ON x.node = a LEFT JOIN geo y ON y.node = b GROUP BY trip_id")
def path_length_km(spark, sf):
    """Length of each path; a path of one node has none."""
    c = T.coordinates(spark, sf)
    rows = W.lags(T.supplier_paths(spark, sf)).select("trip_id", "node", F.col("next1").alias("b"))
    rows = rows.join(c, "node").join(c.select(F.col("node").alias("b"), F.col("lon").alias("x2"), F.col("lat").alias("y2")), "b", "left")
    return rows.groupBy("trip_id").agg(F.round(F.sum(G.haversine_km(F.col("lon"), F.col("lat"), F.col("x2"), F.col("y2"))), 4).alias("km"))


@query(f"""WITH {GEO}, p AS (SELECT c_custkey AS point, c_custkey * 29 % 340 - 170 + 0.25::DOUBLE AS lon, c_custkey * 13 % 150 - 75 + 0.25::DOUBLE AS lat FROM customer)
SELECT point, arg_min(geo.node, (round({km('p', 'geo')}, 9), geo.node)) AS node, round(min({km('p', 'geo')}), 6) AS km FROM p, geo GROUP BY point""")
def nearest_node(spark, sf):
    c = F.col("c_custkey")
    points = T.read(spark, sf, "customer").select(c.alias("point"), (c * 29 % 340 - 170 + 0.25).alias("lon"), (c * 13 % 150 - 75 + 0.25).alias("lat"))
    return R.nearest(points, T.coordinates(spark, sf), 20.0).select("point", "node", F.round("km", 6).alias("km"))


@query(f"WITH {GEO} SELECT a.node AS a, b.node AS b FROM geo a JOIN geo b ON a.node < b.node AND abs(a.lon - b.lon) < 15 AND abs(a.lat - b.lat) < 15 AND (abs(a.lon - b.lon) > 1e-4 OR abs(a.lat - b.lat) > 1e-4)")
def proximity_edges(spark, sf):
    """Neighbours within a box."""
    dx, dy = F.abs(F.col("x1") - F.col("x2")), F.abs(F.col("y1") - F.col("y2"))
    return R.close_pairs(T.coordinates(spark, sf), 15.0, (dx < 15) & (dy < 15) & ((dx > 1e-4) | (dy > 1e-4))).select("a", "b")


D13 = "sqrt(pow((b.lon - a.lon) * 111.32, 2) + pow((b.lat - a.lat) * 111.32 * cos(radians(a.lat)), 2))"


@query(f"WITH {GEO}, e AS (SELECT a.node AS a, b.node AS b, {D13} AS d FROM geo a JOIN geo b ON a.node < b.node WHERE abs(a.lon - b.lon) < 20 AND abs(a.lat - b.lat) < 20) SELECT a AS source, b AS target, round(d, 4) AS km FROM e WHERE d > 0.01 AND d < 1500 UNION ALL SELECT b, a, round(d, 4) FROM e WHERE d > 0.01 AND d < 1500")
def grid_edges(spark, sf):
    """Grid network: neighbours within a distance, both directions; the cosine sits on the north-south leg, as given."""
    d = F.sqrt(F.pow((F.col("x2") - F.col("x1")) * 111.32, F.lit(2)) + F.pow((F.col("y2") - F.col("y1")) * 111.32 * F.cos(F.radians("y1")), F.lit(2)))
    box = (F.abs(F.col("x1") - F.col("x2")) < 20) & (F.abs(F.col("y1") - F.col("y2")) < 20)
    e = R.close_pairs(T.coordinates(spark, sf), 20.0, box).withColumn("d", d).where("d > 0.01 and d < 1500").select("a", "b", F.round("d", 4).alias("km"))
    return e.toDF("source", "target", "km").union(e.select("b", "a", "km"))


@query(f"WITH {GEO} SELECT min(lon) AS west, max(lon) AS east, min(lat) AS south, max(lat) AS north, greatest(0.05 * (max(lon) - min(lon)), 0.05) AS pad_lon, greatest(0.05 * (max(lat) - min(lat)), 0.05) AS pad_lat, bool_and(lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90) AS plausible FROM geo")
def network_extent(spark, sf):
    c = T.coordinates(spark, sf)
    pad = lambda x: F.greatest(0.05 * (F.max(x) - F.min(x)), F.lit(0.05))
    return c.agg(
        F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"), pad("lon").alias("pad_lon"), pad("lat").alias("pad_lat"),
        F.bool_and(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)).alias("plausible"),
    )


@query(f"WITH {ROAD}, {GEO} SELECT source, target, x.lon AS x1, x.lat AS y1, y.lon AS x2, y.lat AS y2 FROM road JOIN geo x ON x.node = source JOIN geo y ON y.node = target")
def network_segments(spark, sf):
    edges, c = parts(spark, sf)
    return edges.select("source", "target").join(c.toDF("source", "x1", "y1"), "source").join(c.toDF("target", "x2", "y2"), "target")


@query(f"WITH {ROAD}, {GEO}, e AS (SELECT source, target, length FROM road UNION ALL SELECT target, source, length FROM road) SELECT source, target, CAST(min(length) AS DOUBLE) AS length FROM e WHERE source IN (SELECT node FROM geo) AND target IN (SELECT node FROM geo) GROUP BY 1, 2")
def routing_graph(spark, sf):
    return R.routing(*parts(spark, sf))


@query(f"""WITH {LI}, p AS (SELECT trip_id, min_by(node, pos) AS o, max_by(node, pos) AS d FROM li GROUP BY trip_id), {GEO}
SELECT count(*) FILTER (WHERE o NOT IN (SELECT node FROM geo WHERE node % 10 <> 0)) AS missing_origin, count(*) FILTER (WHERE d NOT IN (SELECT node FROM geo WHERE node % 10 <> 0)) AS missing_destination FROM p""")
def endpoint_check(spark, sf):
    """Trips whose ends aren't in the network (here without every tenth node)."""
    nodes = T.coordinates(spark, sf).where("node % 10 <> 0").select("node")
    trips = T.supplier_paths(spark, sf).select("trip_id", F.get("path", F.lit(0)).alias("o"), F.element_at("path", -1).alias("d"))
    a = trips.join(nodes, trips["o"] == nodes["node"], "left_anti").agg(F.count("*").alias("missing_origin"))
    b = trips.join(nodes, trips["d"] == nodes["node"], "left_anti").agg(F.count("*").alias("missing_destination"))
    return a.join(b)


@query(f"""WITH {ROAD}, {GEO}, {UND}, d AS (SELECT source AS node, count(*) AS d FROM und GROUP BY 1), o AS (SELECT source AS node, count(*) AS o FROM road GROUP BY 1), i AS (SELECT target AS node, count(*) AS i FROM road GROUP BY 1),
t AS (SELECT a.source AS node, count(*) AS t FROM und a JOIN und b ON b.source = a.source AND a.target < b.target JOIN und c ON c.source = a.target AND c.target = b.target GROUP BY 1)
SELECT node, round(coalesce(i, 0) / (max(coalesce(i, 0)) OVER () + 1e-6), 6) AS in_degree, round(coalesce(o, 0) / (max(coalesce(o, 0)) OVER () + 1e-6), 6) AS out_degree,
round(CASE WHEN coalesce(d, 0) < 2 THEN 0.0 ELSE 2.0::DOUBLE * coalesce(t, 0) / (d * (d - 1)) END, 6) AS coefficient FROM geo LEFT JOIN o USING (node) LEFT JOIN i USING (node) LEFT JOIN d USING (node) LEFT JOIN t USING (node)""")
def combined_features(spark, sf):
    edges, c = parts(spark, sf)
    rows = R.degree_features(edges, c).join(R.clustering(edges, c), "node")
    return rows.select("node", *[F.round(x, 6).alias(x) for x in ("in_degree", "out_degree", "coefficient")])


@query(f"""WITH {GEO}, p AS (SELECT c_custkey AS point, c_custkey * 29 % 340 - 170 + 0.25::DOUBLE AS lon, c_custkey * 13 % 150 - 75 + 0.25::DOUBLE AS lat FROM customer),
n AS (SELECT point, min({km('p', 'geo')}) AS km FROM p, geo GROUP BY point) SELECT count(*) AS points, round(avg(km), 4) AS mean_km, round(min(km), 4) AS min_km, round(max(km), 4) AS max_km FROM n""")
def mapping_statistics(spark, sf):
    """How far points lie from the nodes they are mapped to."""
    c = F.col("c_custkey")
    points = T.read(spark, sf, "customer").select(c.alias("point"), (c * 29 % 340 - 170 + 0.25).alias("lon"), (c * 13 % 150 - 75 + 0.25).alias("lat"))
    n = R.nearest(points, T.coordinates(spark, sf), 20.0)
    return n.agg(F.count("*").alias("points"), *[F.round(f("km"), 4).alias(a) for f, a in ((F.avg, "mean_km"), (F.min, "min_km"), (F.max, "max_km"))])


@query(SP.replace("SELECT p.source, p.target, CAST(m.cost AS DOUBLE) AS cost FROM trip_ends p LEFT JOIN m ON m.source = p.source AND m.node = p.target", "SELECT count(*) AS pairs, CAST(count(*) FILTER (WHERE m.cost IS NULL) AS BIGINT) AS unroutable FROM trip_ends p LEFT JOIN m ON m.source = p.source AND m.node = p.target"))
def unroutable_pairs(spark, sf):
    edges, _ = parts(spark, sf)
    return R.routes(edges, _pairs(spark, sf), paths=False).agg(F.count("*").alias("pairs"), F.count(F.when(F.col("cost").isNull(), 1)).alias("unroutable"))


@query()
def clean_routes(spark, sf):
    """Undirected routes between ends of edges with the coordinates of every step: source, target, pos, x1, y1, x2, y2."""
    edges, c = parts(spark, sf)
    edges = cut(edges)  # read as the graph and as its pairs
    found = R.routes(R.routing(edges, c), edges).where("path is not null")
    legs = found.select("source", "target", F.posexplode(P.kgrams(F.col("path"), 2)).alias("pos", "leg"))
    legs = legs.select("source", "target", "pos", F.get("leg", F.lit(0)).alias("a"), F.get("leg", F.lit(1)).alias("b"))
    return legs.join(c.toDF("a", "x1", "y1"), "a").join(c.toDF("b", "x2", "y2"), "b").drop("a", "b")


@query("""WITH q AS (SELECT vec_id AS point, embedding AS e FROM embeddings WHERE vec_id % 20 = 0)
SELECT point, arg_min(vec_id, (round(list_distance(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 9), vec_id)) AS node FROM embeddings, q WHERE vec_id <> point GROUP BY point""")
def embedding_decode(spark, sf):
    """The vector nearest to each one whose id is divisible by 20, among all others."""
    e = T.read(spark, sf, "embeddings").select("vec_id", "embedding")
    return R.nearest_vectors(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding")


@query()
def node_clusters(spark, sf):
    """k-means over coordinates and degrees."""
    edges, c = parts(spark, sf)
    rows = c.join(R.degree_features(edges, c), "node")
    return R.kmeans(rows, ["lon", "lat", "in_degree", "out_degree"], 8)


@query()
def node_embedding(spark, sf):
    """Skip-gram vectors over random walks: node and length of its vector."""
    edges, c = parts(spark, sf)
    return R.embed(R.walks(edges, c, 4, 12), 8).select("node", F.size(vector_to_array("vector")).alias("dims"))


@query(f"""WITH {LI}, t AS (SELECT node AS a, lead(node) OVER (PARTITION BY trip_id ORDER BY pos) AS b FROM li), c AS (SELECT a, b, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY 1, 2)
SELECT a AS source, b AS target, n FROM c QUALIFY row_number() OVER (ORDER BY n DESC, a, b) <= 15""")
def top_links(spark, sf):
    one = W.ngrams(T.supplier_paths(spark, sf), 1)
    return one.select(F.get("ctx", F.lit(0)).alias("source"), F.col("next").alias("target"), F.col("cnt").alias("n")).orderBy(F.desc("n"), "source", "target").limit(15)


@query(f"WITH {LI}, c AS (SELECT node, count(*) AS n FROM li GROUP BY 1) SELECT node, n FROM c QUALIFY row_number() OVER (ORDER BY n DESC, node) <= 15")
def top_nodes(spark, sf):
    return W.steps(T.supplier_paths(spark, sf)).groupBy("node").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(15)


@query(f"WITH {LI}, t AS (SELECT node AS a, lead(node) OVER (PARTITION BY trip_id ORDER BY pos) AS b FROM li) SELECT a AS node, count(*) AS n FROM t WHERE a = b GROUP BY 1")
def self_loops(spark, sf):
    one = W.ngrams(T.supplier_paths(spark, sf), 1)
    return one.where(F.get("ctx", F.lit(0)) == F.col("next")).select(F.col("next").alias("node"), F.col("cnt").alias("n"))


@query(f"WITH {ROAD}, {GEO} SELECT geo.node, round(CASE WHEN s = 0 AND c = 0 THEN NULL ELSE t - floor(t) END, 6) % 1 AS turn FROM geo JOIN (SELECT source, sum(sin(a)) AS s, sum(cos(a)) AS c, atan2(sum(sin(a)), sum(cos(a))) / (2 * pi()) AS t FROM (SELECT source, atan2(CAST(target - source AS DOUBLE), 1.0) AS a FROM road) GROUP BY source) ON source = geo.node")
def mean_bearing(spark, sf):
    """Circular mean of the id bearings of each node's successors."""
    edges = T.road(spark, sf)
    return edges.groupBy(F.col("source").alias("node")).agg((F.round(G.circular_mean(G.id_bearing(F.col("source"), F.col("target"))), 6) % 1).alias("turn"))
