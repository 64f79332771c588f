"""Flattening of saved lookup responses (drug labels and adverse events)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advigil.fixed_values import WARNING_LENGTH

LABEL_SCHEMA = (
    "meta struct<results: struct<total: bigint>>, results array<struct<"
    "openfda: struct<brand_name: array<string>, generic_name: array<string>, "
    "manufacturer_name: array<string>, product_type: array<string>, route: array<string>, "
    "substance_name: array<string>>, purpose: array<string>, warnings: array<string>>>"
)
EVENT_SCHEMA = (
    "meta struct<results: struct<total: bigint>>, results array<struct<"
    "safetyreportid: string, receivedate: string, serious: string, seriousnessdeath: string, "
    "patient: struct<patientonsetage: string, patientsex: string, "
    "drug: array<struct<medicinalproduct: string>>, "
    "reaction: array<struct<reactionmeddrapt: string>>>>>"
)


def read_saved(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved response pages, one JSON document per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _total() -> Column:
    return F.coalesce(F.col("meta.results.total"), F.size("results").cast("bigint"))


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def flatten_labels(pages: DataFrame) -> DataFrame:
    """One row per label with its name arrays, first type, purpose and warning."""
    r = pages.filter(F.col("results").isNotNull()).select(
        _total().alias("total"), F.explode("results").alias("r")
    )
    names = ["brand_name", "generic_name", "manufacturer_name", "route", "substance_name"]

    def first(c: str) -> Column:
        return F.try_element_at(F.col(c), F.lit(1))

    return r.select(
        "total",
        *[_list(f"r.openfda.{n}").alias(n) for n in names],
        first("r.openfda.product_type").alias("product_type"),
        first("r.purpose").alias("purpose"),
        first("r.warnings").alias("warnings"),
        F.substring(first("r.warnings"), 1, WARNING_LENGTH).alias("warnings_preview"),
    )


def flatten_events(pages: DataFrame) -> DataFrame:
    """One row per event report; absent values are empty text, blank names are left out."""
    r = pages.filter(F.col("results").isNotNull()).select(
        _total().alias("total"), F.explode("results").alias("r")
    )

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    def names(c: str, field: str) -> Column:
        values = F.transform(F.col(c), lambda x: x[field])
        kept = F.filter(values, lambda x: F.coalesce(x, F.lit("")) != "")
        return F.coalesce(kept, F.array().cast("array<string>"))

    return r.select(
        "total",
        text("r.safetyreportid").alias("safetyreportid"),
        text("r.receivedate").alias("receivedate"),
        text("r.serious").alias("serious"),
        text("r.seriousnessdeath").alias("seriousnessdeath"),
        text("r.patient.patientonsetage").alias("patient_age"),
        text("r.patient.patientsex").alias("patient_sex"),
        names("r.patient.drug", "medicinalproduct").alias("drugs"),
        names("r.patient.reaction", "reactionmeddrapt").alias("reactions"),
    )
