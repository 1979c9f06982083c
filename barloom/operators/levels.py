"""Levels of all ten types and the sweeps of them: swing and equal levels beside those of ranges, days and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.operators.folds import bucketed
from barloom.operators.structure import LEVEL_PARTS, SIX_LEVELS, SWEEPS, swings_sql
from barloom.plans.sql import with_tables
from barloom.runtime import cut
from barloom.sources.frames import FRAMES

#: Bars on either side of the swings that levels are made of.
K = 3
_SWINGS = f"WITH {swings_sql('bars_1h', K)} SELECT symbol, kind, i, conf, price FROM swings"

#: A bucket's first swing is a level if a bar before it has reached its price, so that two bars have; its second makes an equal level.
_SWING_LEVELS = """
reached AS (
  SELECT symbol, i, max(h) OVER w AS top, min(l) OVER w AS bottom FROM {bars_1h} WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
swing_levels AS (
  SELECT b.symbol, b.conf AS creation, b.anchor AS price, concat('swing_', b.kind) AS level_type, b.kind AS side, 0 AS specificity FROM {bucketed} b JOIN reached r ON r.symbol = b.symbol AND r.i = b.i
  WHERE b.rank = 1 AND ((b.kind = 'high' AND r.top >= b.anchor) OR (b.kind = 'low' AND r.bottom <= b.anchor))
  UNION ALL SELECT symbol, conf AS creation, anchor AS price, concat('equal_', kind, 's') AS level_type, kind AS side, 2 AS specificity FROM {bucketed} WHERE rank = 2)"""
_ALL = f"{LEVEL_PARTS}, {_SWING_LEVELS}, levels AS ({SIX_LEVELS} UNION ALL SELECT * FROM swing_levels)"
SQL = {
    "all_levels": f"WITH {_ALL} SELECT symbol, creation, price, level_type, CAST(specificity AS BIGINT) AS specificity, row_number() OVER (PARTITION BY symbol ORDER BY creation, price, level_type) AS seq FROM levels",
    "all_sweeps": f"WITH {_ALL}, {SWEEPS} SELECT symbol, i, i + 1 AS conf, side, price, level_type, creation, next_close FROM sweeps",
}


def _with_buckets(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = cut(FRAMES["bars_1h"][0](spark, sf_dir), "bars")
        buckets = cut(bucketed(spark.sql(_SWINGS, bars_1h=bars)), "buckets")
        return spark.sql(SQL[name], bars_1h=bars, bucketed=buckets)

    return query


#: The same buckets by recursion over the swings of a kind, with all anchors carried along.
_RECURSION = f"""{swings_sql('bars_1h', K)},
seq AS (SELECT symbol, kind, i, conf, price, CAST(round(price * 100) AS BIGINT) AS cents, row_number() OVER (PARTITION BY symbol, kind ORDER BY conf, i) AS k FROM swings),
run AS (
  SELECT symbol, kind, k, i, conf, price, [cents] AS anchors, 1 AS b FROM seq WHERE k = 1
  UNION ALL SELECT symbol, kind, k, i, conf, price, CASE WHEN hit = 0 THEN list_append(anchors, cents) ELSE anchors END AS anchors, CASE WHEN hit = 0 THEN len(anchors) + 1 ELSE hit END AS b
  FROM (SELECT q.*, r.anchors, coalesce(list_position(list_transform(r.anchors, lambda a: abs(q.cents - a) * 1000 <= a), true), 0) AS hit FROM run r JOIN seq q ON q.symbol = r.symbol AND q.kind = r.kind AND q.k = r.k + 1)),
bucketed AS MATERIALIZED (
  SELECT symbol, kind, i, conf, price, CAST(b - 1 AS BIGINT) AS bucket, anchors[b]::DOUBLE / 100 AS anchor, row_number() OVER (PARTITION BY symbol, kind, b ORDER BY k) AS rank FROM run)"""


def _oracle(body: str) -> str:
    sql = with_tables(f"WITH {_RECURSION}, {body.replace('{bucketed}', 'bucketed')}")
    return "WITH RECURSIVE " + sql.removeprefix("WITH ")


QUERIES = {name: _with_buckets(name) for name in SQL}
ORACLES = {name: _oracle(sql.removeprefix("WITH ")) for name, sql in SQL.items()} | {
    "liquidity_levels": _oracle("""final AS (
  SELECT symbol, kind, bucket, anchor AS price, count(*) AS members, max(conf) FILTER (WHERE rank = 2) AS created FROM bucketed GROUP BY symbol, kind, bucket, anchor)
SELECT * FROM final WHERE members > 1"""),
}
