"""Data set files. Ordered text output is written as ordered part files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_dataset(df: DataFrame, path: str, partition: str | None = "report_quarter") -> None:
    """Columnar output, one folder per quarter where the frame has one."""
    writer = df.write.mode("overwrite")
    if partition and partition in df.columns:
        writer = writer.partitionBy(partition)
    writer.parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """List columns as ``|`` joined text."""
    return df.select(
        *[
            F.array_join(F.col(f.name), "|").alias(f.name)
            if isinstance(f.dataType, T.ArrayType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_dataset_csv(df: DataFrame, path: str) -> None:
    """CSV sorted by all columns; read in file name order the parts are one sorted file."""
    rows = flat(df)
    writer = rows.orderBy(*rows.columns).write.mode("overwrite").options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    writer.csv(path)


def write_records_json(df: DataFrame, path: str) -> None:
    """One record per line with sorted keys; nulls are written."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)
