"""Where queries are registered, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


#: Shared parts of the SQL: event paths, a split of them into train and test, supplier paths, the road graph.
EV = """ev AS (SELECT trip_id, user_id, node, row_number() OVER (PARTITION BY trip_id ORDER BY ts, event_id) - 1 AS pos FROM (
  SELECT user_id * 100 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS trip_id, user_id, ts, event_id,
    CAST(list_position(['click','error','purchase','signup','view'], event_type) - 1 AS INTEGER) AS node FROM events)),
trip AS (SELECT trip_id, user_id, list(node ORDER BY pos) AS path FROM ev GROUP BY trip_id, user_id),
train AS (SELECT * FROM trip WHERE trip_id % 5 <> 0), test AS (SELECT * FROM trip WHERE trip_id % 5 = 0)"""
WIN = EV + """,
win AS (SELECT trip_id, user_id, CAST(i + 5 AS INTEGER) AS pos, path[i+1:i+5] AS ctx, path[i+6] AS target FROM (SELECT *, unnest(range(0, len(path) - 5)) AS i FROM test)),
ctxs AS (SELECT DISTINCT ctx FROM win), nodes AS (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS node)"""
LI = """li AS (SELECT l_orderkey AS trip_id, CAST(l_suppkey AS INTEGER) AS node, CAST(l_quantity AS INTEGER) AS q,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS pos FROM lineitem),
op AS (SELECT trip_id, list(node ORDER BY pos) AS path FROM li GROUP BY trip_id)"""
ROAD = LI + """,
pairs AS (SELECT node AS source, lead(node) OVER (PARTITION BY trip_id ORDER BY pos) AS target, q FROM li),
road AS (SELECT source, target, min(q) AS length FROM pairs WHERE source <> target AND (source * 31 + target * 17) % 20 = 0 GROUP BY source, target)"""
GEO = "geo AS (SELECT CAST(s_suppkey AS INTEGER) AS node, s_suppkey * 37 % 360 - 180 + 0.5::DOUBLE AS lon, s_suppkey * 17 % 170 - 85 + 0.5::DOUBLE AS lat FROM supplier)"


def ngrams(k: int, of: str = "train", low: int = 1) -> str:
    """ng(k, ctx, nxt, cnt)."""
    return f"""ng AS (SELECT k, path[i-k+1:i] AS ctx, path[i+1] AS nxt, count(*) AS cnt
  FROM (SELECT path, unnest(range(1, len(path))) AS i FROM {of}), (SELECT unnest(range({low}, {k} + 1)) AS k) WHERE k <= i GROUP BY 1, 2, 3)"""


def matched(k: int) -> str:
    """m(ctx, k, nxt, cnt, n): every successor of every suffix of up to k nodes."""
    return f"""sfx AS (SELECT ctx, k, ctx[len(ctx)-k+1:] AS s FROM ctxs, (SELECT unnest(range(1, {k} + 1)) AS k) WHERE k <= len(ctx)),
m AS (SELECT sfx.ctx, sfx.k, nxt, cnt, sum(cnt) OVER (PARTITION BY sfx.ctx, sfx.k) AS n FROM sfx JOIN ng ON ng.k = sfx.k AND ng.ctx = sfx.s)"""
