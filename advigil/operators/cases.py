"""Case versions, deleted cases and typed demographics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from advigil.functions import demographics as demo_fn
from advigil.policy import DETECTION, DetectionPolicy


def zero_fill(text: Column, width: int) -> Column:
    """Left fill with zeros that never shortens a longer text."""
    text = text.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def latest_case_versions(demo: DataFrame, tie_break: tuple[str, ...] = ()) -> DataFrame:
    """The row with the highest version of each case, ties to the largest report id.

    ``tie_break`` names columns that decide between repeated rows of one report
    version. It is empty by default so that unused columns can be pruned.

    ``row_number() = 1`` lets Spark keep only the best row of each case before the
    shuffle (window group limit), so a case with very many rows ships one row per
    map task. Without a version column nothing is removed.
    """
    if "caseversion" not in demo.columns:
        return demo
    best = W.partitionBy("caseid").orderBy(
        zero_fill(F.col("caseversion"), 10).desc(),
        zero_fill(F.col("primaryid"), 20).desc(),
        *[F.desc(c) for c in tie_break],
    )
    return (
        demo.withColumn("_version_order", F.row_number().over(best))
        .filter("_version_order = 1")
        .drop("_version_order")
    )


def exclude_deleted_cases(cases: DataFrame, deleted: DataFrame) -> DataFrame:
    """Cases whose id is not on the deletion list (column ``caseid``)."""
    return cases.join(deleted.select("caseid"), "caseid", "left_anti")


def restrict_to_cases(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Rows whose report survived case handling."""
    return rows.join(cases.select("primaryid"), "primaryid", "left_semi")


def case_version_stats(demo: DataFrame) -> DataFrame:
    """Rows in, kept and excluded, distinct cases before and after; one row."""
    total = F.count(F.lit(1))
    distinct = F.count_distinct("caseid")
    kept = distinct if "caseversion" in demo.columns else total
    return demo.agg(
        total.alias("total_input_rows"),
        distinct.alias("unique_caseids_before"),
        kept.alias("unique_caseids_after"),
        kept.alias("rows_retained"),
        (total - kept).alias("rows_excluded"),
    ).withColumn(
        "case_version_policy", F.lit("latest" if "caseversion" in demo.columns else "no_dedup")
    )


def deleted_case_stats(cases: DataFrame, deleted: DataFrame, apply: bool) -> DataFrame:
    """Size of the deletion list, matched cases and excluded rows; one row."""
    sides = deleted.select("caseid", F.lit(0).alias("rows")).unionByName(
        cases.groupBy("caseid").agg(F.count(F.lit(1)).cast("int").alias("rows"))
    )
    per_case = sides.groupBy("caseid").agg(
        F.max((F.col("rows") == 0).cast("int")).alias("listed"), F.sum("rows").alias("rows")
    )
    matched = F.coalesce(F.sum(F.when(F.col("listed") == 1, F.col("rows"))), F.lit(0))
    return per_case.agg(
        F.coalesce(F.sum("listed"), F.lit(0)).alias("deleted_ids_available"),
        (matched if apply else F.lit(0).cast("bigint")).alias("deleted_ids_matched_in_demo"),
        (matched if apply else F.lit(0).cast("bigint")).alias("rows_excluded"),
    )


def type_demo(
    demo: DataFrame, quarter: str | Column, policy: DetectionPolicy = DETECTION
) -> DataFrame:
    """Report ids with parsed age, sex and date, the quarter and the source marker."""
    quarter = F.lit(quarter) if isinstance(quarter, str) else quarter
    return demo.select(
        "primaryid",
        "caseid",
        "caseversion",
        F.col("primaryid").alias("report_id"),
        demo_fn.parse_event_date(F.col("event_dt")).alias("event_date"),
        demo_fn.parse_age_years(F.col("age"), F.col("age_cod"), policy.dec_years).alias("patient_age"),
        demo_fn.parse_sex(F.col("sex")).alias("patient_sex"),
        quarter.alias("report_quarter"),
        F.lit(policy.source).alias("source"),
    )


def demo_audit(typed: DataFrame) -> DataFrame:
    """Rows and unparsed fields of a typed frame; one row."""
    return typed.agg(
        F.count(F.lit(1)).alias("demo_rows"),
        F.count_if(F.col("event_date").isNull()).alias("event_date_missing_or_invalid"),
        F.count_if(F.col("patient_age").isNull()).alias("age_missing_or_invalid"),
        F.count_if(F.col("patient_sex").isNull()).alias("sex_not_f_or_m"),
    )
