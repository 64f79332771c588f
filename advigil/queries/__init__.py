"""Registered queries: every operator run over the star-schema tables.

A query is a function ``(spark, folder) -> DataFrame``. Doubles are rounded to six
decimals and nested values are shown as text, so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from advigil.plans.star_schema import StarSchema

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> dict[str, Query]:
    from advigil.queries import fields, files, groups, review, statistics, tables

    found: dict[str, Callable[[StarSchema], DataFrame]] = {}
    for module in (files, fields, groups, statistics, review, tables):
        overlap = set(found) & set(module.QUERIES)
        if overlap:
            raise ValueError(f"registered twice: {sorted(overlap)}")
        found.update(module.QUERIES)

    def bind(run: Callable[[StarSchema], DataFrame]) -> Query:
        return lambda spark, folder: run(StarSchema(spark, folder))

    return {name: bind(run) for name, run in found.items()}
