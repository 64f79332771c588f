"""Readers of signal, metric and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advigil import fixed_values as V
from advigil.functions.numbers import to_numeric
from advigil.functions.scores import parse_trend_data
from advigil.functions.text import null_if_blank, parse_reactions_cell, strip
from advigil.schemas import METRICS_FILE, SIGNAL
from advigil.sources.faers import path_exists
from advigil.sources.split_text import json_elements


def scan_signals_json(spark: SparkSession, path: str) -> DataFrame:
    """Signals from JSON: one record per line, or files that each hold one array.

    An array is read by all its splits, on one line or many. Only the first character is looked at
    beforehand, and whether the first line of records is whole.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(F.left(strip("value"), F.lit(1)).alias("c"))
    first = pieces.filter("c <> ''").limit(1).collect()
    start = first[0].c if first else ""
    if start == "[":
        elements = json_elements(spark, path)
        return elements.select(F.from_json("value", SIGNAL).alias("r")).select("r.*")
    lines = spark.read.text(path).select(F.right(strip("value"), F.lit(1)).alias("c"))
    if start == "{" and lines.filter("c <> ''").limit(1).collect()[0].c == "}":
        return spark.read.schema(SIGNAL).json(path)
    raise ValueError(f"expected signal records in {path}")


def empty_metrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], METRICS_FILE).withColumn(
        "trend_data", parse_trend_data(F.col("trend_data"))
    )


def scan_metrics_csv(spark: SparkSession, path: str | None) -> DataFrame:
    """Seven metric columns by signal id; empty when the file or its key is absent."""
    if path is None or not path_exists(spark, path):
        return empty_metrics(spark)
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    if "signal_id" not in raw.columns:
        return empty_metrics(spark)
    out = []
    for field in METRICS_FILE.fields:
        column = F.col(field.name) if field.name in raw.columns else F.lit(None).cast("string")
        if field.name == "trend_data":
            column = parse_trend_data(column)
        elif field.name != "signal_id":
            column = to_numeric(column)
        out.append(column.alias(field.name))
    return raw.select(*out)


def scan_reports_csv(spark: SparkSession, path: str, quarter: str) -> DataFrame:
    """Report rows of an exported file; blank cells are null, quarter and source default.

    Seriousness is carried when the file has it.
    """
    raw = spark.read.option("header", True).option("escape", '"').csv(path)

    def text(name: str):
        column = F.col(name) if name in raw.columns else F.lit(None).cast("string")
        return null_if_blank(strip(column))

    codes = F.filter(F.split(F.coalesce(text("seriousness_codes"), F.lit("")), r"\|"), lambda x: x != "")
    return raw.select(
        strip("report_id").alias("report_id"),
        strip("drug_name").alias("drug_name"),
        parse_reactions_cell(F.col("reactions")).alias("reactions"),
        to_numeric(text("patient_age")).alias("patient_age"),
        text("patient_sex").alias("patient_sex"),
        text("event_date").alias("event_date"),
        F.coalesce(text("seriousness"), F.lit(V.UNKNOWN_SERIOUSNESS)).alias("seriousness"),
        codes.alias("seriousness_codes"),
        F.coalesce(text("report_quarter"), F.lit(quarter)).alias("report_quarter"),
        F.coalesce(text("source"), F.lit(V.SOURCE_MARKER)).alias("source"),
    )


def column_alias_fill(rows: DataFrame) -> DataFrame:
    """Accept the short names drug, event, report_count and release_id."""
    aliases = {
        "drug_name": "drug",
        "event_name": "event",
        "supporting_report_count": "report_count",
        "dataset_version": "release_id",
    }
    out = rows
    for name, short in aliases.items():
        if name not in out.columns and short in out.columns:
            out = out.withColumn(name, F.col(short))
        elif short not in out.columns and name in out.columns:
            out = out.withColumn(short, F.col(name))
    return out
