"""Queries written once as SQL over the base tables, planned by Catalyst and checked by DuckDB.

``{bars_1h}`` and the like stand for base tables. The two dialects differ only in
the names that ``_SPARK`` lists.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.runtime import cut
from barloom.sources.frames import FRAMES

#: DuckDB's name -> Spark's.
_SPARK = {"unnest(generate_series(": "explode(sequence(", "list_extract(": "element_at(", "quantile_cont(": "percentile(", "list_sort(": "array_sort(", "list(": "collect_list(", "skewness(": "skewness(", "bool_and(": "bool_and("}
_TABLE = re.compile(r"\{(\w+)\}")


def frames_of(sql: str) -> list[str]:
    return sorted(set(_TABLE.findall(sql)))


def spark_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    text = sql
    for a, b in _SPARK.items():
        text = text.replace(a, b)

    uses = {n: len(re.findall(rf"\{{{n}\}}", sql)) for n in frames_of(sql)}

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {n: FRAMES[n][0](spark, sf_dir) for n in uses}
        # A table that is read several times is made from the ticks once.
        return spark.sql(text, **{n: cut(f, n) if uses[n] > 2 else f for n, f in frames.items()})

    return query


def with_tables(sql: str) -> str:
    """DuckDB SQL of a query with its base tables before it."""
    names: list[str] = []

    def need(n: str) -> None:
        for d in FRAMES[n][1]:
            need(d)
        if n not in names:
            names.append(n)

    for n in frames_of(sql):
        need(n)
    body = _TABLE.sub(r"\1", sql).strip()
    tables = ",\n".join(f"{n} AS MATERIALIZED ({FRAMES[n][2]})" for n in names)
    if body.upper().startswith("WITH "):
        return f"WITH {tables},\n{body[5:]}"
    return f"WITH {tables}\n{body}"


def register(queries: dict[str, str]) -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    return {n: spark_query(q) for n, q in queries.items()}, {n: with_tables(q) for n, q in queries.items()}
