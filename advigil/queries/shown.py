"""How values are shown in query results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from advigil.functions.numbers import round_half_even


def collector(queries: dict):
    """Decorator that registers a function under its name."""

    def add(run):
        queries[run.__name__] = run
        return run

    return add


def joined(items: Column, separator: str = "|") -> Column:
    return F.array_join(items, separator)


def points(series: Column) -> Column:
    """``2026Q1=3;2026Q2=5``."""
    return F.array_join(
        F.transform(series, lambda p: F.concat(p["quarter"], F.lit("="), p["count"].cast("bigint").cast("string"))),
        ";",
    )


def flat(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, text arrays joined, whole numbers as bigint."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            c = round_half_even(c, 6)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = joined(c)
        elif isinstance(f.dataType, T.IntegerType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)
