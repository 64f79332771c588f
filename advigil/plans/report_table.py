"""The report-event table: reports laid out by pair, which support, quality and duplicates read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advigil.functions.text import strip
from advigil.operators.duplicates import is_complete
from advigil.operators.support import block_sex

KEYS = ["drug_name", "event_name", "block"]


def report_event_rows(pairs: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per report, drug and event with the fields of its case.

    ``block`` places a row within its pair: by the fields that potential duplicates agree on, or by
    the report where one of them is missing. A pair with a large share of all reports is so spread.
    """
    fields = cases.select("primaryid", "patient_age", "patient_sex", "event_date", "report_quarter")
    rows = pairs.select("primaryid", "drug_name", "event_name").join(fields, "primaryid")
    alike = F.xxhash64(F.col("patient_age").cast("double"), block_sex(F.col("patient_sex")), strip("event_date"))
    block = F.when(is_complete(), alike).otherwise(F.xxhash64("primaryid"))
    return rows.select(F.col("primaryid").alias("report_id"), "drug_name", "event_name", block.alias("block"), *fields.columns[1:])


def write_report_events(rows: DataFrame, path: str, name: str | None = None, buckets: int | None = None) -> DataFrame:
    """Write the rows bucketed and sorted by pair and block, and read them as a bucketed table.

    Groups by pair and block need no shuffle of the reports then; groups by pair shuffle sums only. ``name`` is the
    table's name in the catalog; without one it gets a name of its own, and the caller drops it.
    """
    spark = rows.sparkSession
    name = name or f"report_events_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(buckets, *KEYS)
    dealt.write.bucketBy(buckets, *KEYS).sortBy(*KEYS).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)
