"""Normalised report records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advigil import fixed_values as V
from advigil.functions.text import strip, trimmed_upper
from advigil.operators.pairs import report_events, suspect_drugs
from advigil.policy import DETECTION, DetectionPolicy


def reactions_per_report(pairs: DataFrame) -> DataFrame:
    """Sorted distinct events of each report.

    The array is a field of the report record. It is built from rows that are
    already distinct, so it holds at most one entry per term of the vocabulary.
    """
    return (
        pairs.select("primaryid", "event_name")
        .distinct()
        .groupBy("primaryid")
        .agg(F.sort_array(F.collect_list("event_name")).alias("reactions"))
    )


def reactions_in_order(reac: DataFrame, position: str) -> DataFrame:
    """Distinct events of each report in order of first appearance."""
    first = (
        reac.select(
            strip("primaryid").alias("primaryid"),
            trimmed_upper(F.col("pt")).alias("event_name"),
            F.col(position).alias("_pos"),
        )
        .filter("primaryid <> '' and event_name <> ''")
        .groupBy("primaryid", "event_name")
        .agg(F.min("_pos").alias("_pos"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("_pos", "event_name")))
    return first.groupBy("primaryid").agg(
        F.transform(ordered, lambda x: x["event_name"]).alias("reactions")
    )


def _grouped_codes(rows: DataFrame) -> DataFrame:
    """Sorted distinct serious codes of every report: one flag per code, which Spark combines by hash on the map side."""
    codes = sorted(V.SERIOUS_OUTCOMES)
    flags = rows.groupBy("primaryid").agg(*[F.max(F.coalesce(F.col("_code") == c, F.lit(False))).alias(f"_{c}") for c in codes])
    listed = F.array(*[F.when(F.col(f"_{c}"), F.lit(c)) for c in codes])
    return flags.select("primaryid", F.array_compact(listed).alias("seriousness_codes"))


def _classified(grouped: DataFrame) -> DataFrame:
    return grouped.withColumn(
        "seriousness",
        F.when(F.size("seriousness_codes") > 0, V.SERIOUS).otherwise(V.NON_SERIOUS),
    ).select("primaryid", "seriousness", "seriousness_codes")


def seriousness(outc: DataFrame) -> DataFrame:
    """Class and sorted serious codes of every report with an outcome row.

    At most seven distinct codes survive the filter, so the set stays small.
    """
    return _classified(_grouped_codes(outc.select("primaryid", trimmed_upper(F.col("outc_cod")).alias("_code"))))


def seriousness_ingest(outc: DataFrame) -> DataFrame:
    """As ``seriousness``, but rows with a blank id or code do not count as outcomes."""
    usable = outc.select(
        strip("primaryid").alias("primaryid"), trimmed_upper(F.col("outc_cod")).alias("outc_cod")
    ).filter("primaryid <> '' and outc_cod <> ''")
    return seriousness(usable)


def with_seriousness(reports: DataFrame, classes: DataFrame, key: str = "primaryid") -> DataFrame:
    """Reports with their class; without an outcome row it is Unknown."""
    classes = classes.withColumnRenamed("primaryid", key)
    return (
        reports.join(classes, key, "left")
        .withColumn("seriousness", F.coalesce("seriousness", F.lit(V.UNKNOWN_SERIOUSNESS)))
        .withColumn(
            "seriousness_codes",
            F.coalesce("seriousness_codes", F.array().cast("array<string>")),
        )
    )


def with_case_fields(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Left lookup of age, sex and date by report."""
    return rows.join(
        cases.select("primaryid", "patient_age", "patient_sex", "event_date", "report_quarter"),
        "primaryid",
        "left",
    )


def normalized_reports(
    pairs: DataFrame, cases: DataFrame, outc: DataFrame, policy: DetectionPolicy = DETECTION
) -> DataFrame:
    """One record per (report, analysed drug) out of stored pairs. All joins are on the report id."""
    rows = (
        pairs.select("primaryid", "drug_name")
        .distinct()
        .join(reactions_per_report(pairs), "primaryid")
    )
    return _records(rows, cases, outc, policy)


def reports_of_tables(
    drug: DataFrame, reac: DataFrame, cases: DataFrame, outc: DataFrame, policy: DetectionPolicy = DETECTION
) -> DataFrame:
    """``normalized_reports`` straight from the tables: drugs and events of a report meet as one
    row per drug and one list of events, never as their product."""
    return reports_of_sides(suspect_drugs(drug, cases, policy), report_events(reac, cases), cases, outc, policy)


def reports_of_sides(
    drugs: DataFrame, events: DataFrame, cases: DataFrame, outc: DataFrame, policy: DetectionPolicy = DETECTION
) -> DataFrame:
    """``reports_of_tables`` out of ``suspect_drugs`` and ``report_events``, which are read twice each."""
    drugs = drugs.select("primaryid", F.col("caseid").alias("_case"), "drug_name")
    events = events.select("primaryid", "caseid", "event_name")
    same_case = (F.col("d.primaryid") == F.col("e.primaryid")) & (F.col("_case") >= F.col("caseid")) & (F.col("_case") <= F.col("caseid"))
    d, e = drugs.alias("d"), events.alias("e")
    with_events = d.join(e, same_case, "left_semi").select("primaryid", "drug_name").distinct()
    with_drugs = e.join(d, same_case, "left_semi").select("primaryid", "event_name")
    return _records(with_events.join(reactions_per_report(with_drugs), "primaryid"), cases, outc, policy)


def _records(rows: DataFrame, cases: DataFrame, outc: DataFrame, policy: DetectionPolicy) -> DataFrame:
    """Report records of (report, drug, reactions)."""
    full = with_seriousness(with_case_fields(rows, cases), seriousness(outc))
    return full.select(
        F.col("primaryid").alias("report_id"),
        "drug_name",
        "reactions",
        "patient_age",
        "patient_sex",
        "event_date",
        "seriousness",
        "seriousness_codes",
        "report_quarter",
        F.lit(policy.source).alias("source"),
    )


def primary_drug(drug: DataFrame, position: str) -> DataFrame:
    """First primary-suspect drug of each report, else its first drug."""
    named = drug.select(
        strip("primaryid").alias("primaryid"),
        trimmed_upper(F.col("drugname")).alias("drug_name"),
        trimmed_upper(F.col("role_cod")).alias("role"),
        F.col(position).alias("_pos"),
    ).filter("primaryid <> '' and drug_name <> ''")
    key = F.struct(
        F.when(F.col("role").isin("PS", "1"), 0).otherwise(1).alias("later"),
        F.col("_pos"),
        F.col("drug_name"),
    )
    return (
        named.groupBy("primaryid")
        .agg(F.min(key).alias("first"))
        .select("primaryid", F.col("first.drug_name").alias("drug_name"))
    )


def first_demo_per_report(demo: DataFrame, position: str) -> DataFrame:
    """First row of each report in file order."""
    fields = ["age", "age_cod", "sex", "event_dt"]
    trimmed = demo.select(
        strip("primaryid").alias("primaryid"),
        F.col(position).alias("_pos"),
        *[strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in fields],
    ).filter("primaryid <> ''")
    return (
        trimmed.groupBy("primaryid")
        .agg(F.min(F.struct("_pos", *fields)).alias("first"))
        .select("primaryid", *[F.col(f"first.{c}").alias(c) for c in fields])
    )
