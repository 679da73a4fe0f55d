"""Queries register here by name, with the DuckDB SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def expanded(sql: str) -> str:
    """SQL with every micro(x), a value to 6 places in plain floating point, written out (see functions.nulls.micro)."""
    while (at := sql.find("micro(")) >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}(floor(({sql[at + 6 : end - 1]}) * 1e6 + 0.5) / 1e6){sql[end:]}"
    return sql


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = expanded(oracle)
        return f

    return add
