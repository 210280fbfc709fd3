"""A small decorator that pairs a query with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable


def register(queries: dict, oracles: dict) -> Callable:
    def named(sql: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return keep

    return named


def table(spark, sf_dir: str, name: str):
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
