"""Batch job: report files of one quarter to candidate signals and report records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advigil.functions.text import has_no_drug_name
from advigil.operators.cases import (
    case_version_stats,
    deleted_case_stats,
    demo_audit,
    exclude_deleted_cases,
    latest_case_versions,
    type_demo,
)
from advigil.operators.contingency import disproportionality, pair_counts
from advigil.operators.detection import (
    candidate_signals_export,
    detect_signals,
    detection_stats,
    in_detection_order,
)
from advigil.operators.pairs import pair_stats, pair_universe
from advigil.operators.reports import normalized_reports
from advigil.policy import DETECTION, DetectionPolicy
from advigil.schemas import RAW
from advigil.sinks.files import write_dataset, write_dataset_csv, write_records_json
from advigil.sinks.records import REPORT_CONTRACT, SIGNAL_CONTRACT, validate_records
from advigil.sinks.runs import (
    ledger_rows,
    ledger_total,
    manifest_files,
    quality_ledger,
    reconciliation,
    run_manifest,
)
from advigil.sources.faers import BAD_ROW, POS, load_stats, path_exists, scan_quarters, table_path


@dataclass(frozen=True)
class DetectionOutput:
    pairs: str
    pair_counts: str
    metrics: str
    signals: str
    reports: str
    ledger: str
    manifest: str
    reconciliation: str


# Columns of each file that a later stage reads.
USED = {
    "DEMO": ("primaryid", "caseid", "caseversion", "event_dt", "age", "age_cod", "sex"),
    "DRUG": ("primaryid", "caseid", "drug_seq", "role_cod", "drugname", "raw_row"),
    "REAC": ("primaryid", "caseid", "pt"),
    "OUTC": ("primaryid", "caseid", "outc_cod"),
}


def stage_tables(
    spark: SparkSession, tables: dict[str, DataFrame], output: str
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The records of every file as narrow columnar tables: the good ones, and all with their fault.

    The text is parsed once; later stages and the load statistics read only the columns they
    need. Drug rows without a name keep a digest of the whole row, because the audit counts them as
    distinct rows.
    """
    staged, records = dict(tables), {}
    drug = tables["DRUG"]
    nameless = has_no_drug_name(F.col("drugname"))
    whole = F.sha2(F.to_json(F.struct(*RAW["DRUG"].names)), 256)
    tables = {**tables, "DRUG": drug.withColumn("raw_row", F.when(nameless, whole))}
    for kind, columns in USED.items():
        path = f"{output.rstrip('/')}/staged/{kind.lower()}"
        write_dataset(tables[kind].select(*columns, "report_quarter", POS, BAD_ROW), path)
        records[kind] = spark.read.parquet(path)
        staged[kind] = records[kind].filter(F.col(BAD_ROW).isNull()).drop(BAD_ROW)
    return staged, records


def quarter_load_stats(spark: SparkSession, folder: str, quarters: list[str], records: dict[str, DataFrame]) -> DataFrame:
    """Load statistics of every present file of the quarters, from their staged records."""
    out = None
    for quarter in quarters:
        for kind in RAW:
            if path_exists(spark, table_path(folder, kind, quarter)):
                own = records[kind].filter(F.col("report_quarter") == quarter)
                stats = load_stats(own, kind).withColumn("quarter", F.lit(quarter))
                out = stats if out is None else out.unionByName(stats)
    return out


def run_detection(
    spark: SparkSession,
    folder: str,
    quarter: str | list[str],
    output: str,
    policy: DetectionPolicy = DETECTION,
    deleted_path: str | None = None,
) -> DetectionOutput:
    """All stages over the files of one quarter, or of several taken together.

    With several the latest version of a case is found over all of them, reports keep their own quarter,
    and the signals carry the newest one. Good rows, cases, pairs and counts are each written once and read
    back by everything that uses them, so nothing is recomputed from the text, nothing
    is held in executor memory, and a lost executor costs one stage."""
    out = DetectionOutput(
        *[
            f"{output.rstrip('/')}/{name}"
            for name in (
                "drug_event_pairs",
                "pair_counts",
                "signal_metrics",
                "candidate_signals",
                "normalized_reports",
                "data_quality_report",
                "run_manifest",
                "reconciliation",
            )
        ]
    )
    quarters = [quarter] if isinstance(quarter, str) else sorted(quarter)
    newest = quarters[-1]
    tables, records = stage_tables(spark, scan_quarters(spark, folder, quarters, deleted_path, keep_bad=True), output)
    typed = type_demo(tables["DEMO"], F.col("report_quarter"), policy)
    write_dataset(latest_case_versions(typed, ("event_date", "patient_age", "patient_sex")), f"{output.rstrip('/')}/staged/versions", partition=None)
    versions = spark.read.parquet(f"{output.rstrip('/')}/staged/versions")
    cases = (
        exclude_deleted_cases(versions, tables["DELETED"])
        if policy.exclude_deleted_cases
        else versions
    )
    write_dataset(cases, f"{output.rstrip('/')}/staged/cases", partition=None)
    cases = spark.read.parquet(f"{output.rstrip('/')}/staged/cases")

    write_dataset(pair_universe(tables["DRUG"], tables["REAC"], cases, policy), out.pairs)
    pairs = spark.read.parquet(out.pairs)
    write_dataset(pair_counts(pairs), out.pair_counts)
    counts = spark.read.parquet(out.pair_counts)
    write_dataset(disproportionality(counts, policy), out.metrics)
    metrics = spark.read.parquet(out.metrics)

    signals = candidate_signals_export(detect_signals(metrics, newest, policy))
    write_dataset(validate_records(signals, SIGNAL_CONTRACT, "candidate_signals"), out.signals)
    reports = normalized_reports(pairs, cases, tables["OUTC"], policy)
    write_dataset(validate_records(reports, REPORT_CONTRACT, "normalized_reports"), out.reports)

    signals = spark.read.parquet(out.signals)
    reports = spark.read.parquet(out.reports)
    write_records_json(signals.orderBy("signal_id"), f"{out.signals}_json")
    write_records_json(reports, f"{out.reports}_json")
    write_dataset_csv(in_detection_order(signals), f"{out.signals}_csv")
    write_dataset_csv(metrics, f"{out.metrics}_csv")

    loads = quarter_load_stats(spark, folder, quarters, records)
    detection = detection_stats(metrics, policy)
    undefined = ledger_rows(
        "signal_detection",
        detection.select("finite_prr_pairs", "finite_chi2_pairs", "finite_ror_pairs"),
    ).filter("count = 0")
    # Ledger and reconciliation both read the few rows of the audit.
    write_dataset(pair_stats(tables["DRUG"], tables["REAC"], cases, pairs, policy), f"{output.rstrip('/')}/staged/pair_audit")
    pair_audit = spark.read.parquet(f"{output.rstrip('/')}/staged/pair_audit")
    pair_rows = pair_audit.filter(
        F.col("stat").isin(
            "normalized_drug_names_missing",
            "normalized_reactions_missing",
            "orphan_ps_drugs_primaryids",
            "orphan_reactions_primaryids",
        )
    ).select(
        F.lit("pair_generation").alias("stage"),
        F.col("stat").alias("reason"),
        F.col("value").alias("count"),
        F.lit("").alias("detail"),
    )
    ledger = quality_ledger(
        ledger_rows("ingest", loads, {"loaded_rows": "loaded"}),
        ledger_rows("ingest", loads, {"rejected_rows": "rejected"}).filter("count > 0"),
        ledger_rows("preprocess/demo", demo_audit(typed)),
        ledger_rows("case_processing/case_version", case_version_stats(typed), {"rows_excluded": "older versions"}),
        ledger_rows(
            "case_processing/deleted_case_filter",
            deleted_case_stats(versions, tables["DELETED"], policy.exclude_deleted_cases),
            {"rows_excluded": "ok"},
        ),
        pair_rows,
        undefined,
    )
    write_records_json(ledger, out.ledger)
    write_records_json(ledger_total(spark.read.json(out.ledger)), f"{out.ledger}_total")

    stages = reconciliation(
        raw_demo_rows=tables["DEMO"],
        raw_drug_rows=tables["DRUG"],
        raw_reac_rows=tables["REAC"],
        cases_after_version_handling=cases,
        unique_pairs=pairs,
        metrics_rows=metrics,
        candidates=signals,
        normalized_report_rows=reports,
    )
    named = pair_audit.filter(
        F.col("stat").isin(
            "unique_ps_drugs_after_norm",
            "unique_reactions_after_norm",
            "matched_primaryids",
            "orphan_ps_drugs_primaryids",
            "orphan_reactions_primaryids",
        )
    ).select(F.col("stat").alias("stage"), F.col("value").alias("rows"))
    write_records_json(stages.unionByName(named), out.reconciliation)

    paths = {(kind, q): table_path(folder, kind, q) for q in quarters for kind in RAW}
    counts = (
        spark.read.json(out.reconciliation)
        .groupBy()
        .pivot(
            "stage",
            ["cases_after_version_handling", "unique_pairs", "metrics_rows", "candidates", "normalized_report_rows"],
        )
        .agg(F.first("rows"))
    )
    if deleted_path:
        paths["DELETED", newest] = deleted_path
    write_records_json(manifest_files(spark, paths, loads), f"{out.manifest}_files")
    files = spark.read.json(f"{out.manifest}_files")
    write_records_json(run_manifest(",".join(quarters), policy, counts, files), out.manifest)
    return out
