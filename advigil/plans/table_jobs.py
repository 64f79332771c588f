"""Batch jobs that change stored tables: loading, ingest, backfill and import."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advigil import fixed_values as V
from advigil.functions.demographics import normalize_age_ingest, parse_sex_ingest
from advigil.functions.text import null_if_blank
from advigil.operators.contingency import quarterly_pair_counts
from advigil.operators.reports import (
    first_demo_per_report,
    primary_drug,
    reactions_in_order,
    seriousness_ingest,
    with_seriousness,
)
from advigil.schemas import INGEST_BATCH, RELEASE, REPORT, SIGNAL_STORED
from advigil.session import stored
from advigil.sinks.tables import (
    import_counters,
    known_metrics,
    metrics_rows,
    read_table,
    release_row,
    replace_partitions,
    replace_quarter_pairs,
    rewrite_partitions,
    upsert,
    upsert_reports,
    upsert_signals,
)
from advigil.sources.faers import (
    MissingFileError,
    file_name,
    find_quarter_member,
    lenient_load_stats,
    path_exists,
    scan_faers_unquoted,
)
from advigil.sources.signals import scan_reports_csv


# Reports that an ingest commits together, and the most commits of a quarter.
BATCH_REPORTS, MOST_BATCHES = 2_000_000, 10_000


class AlreadyImportedError(Exception):
    """The quarter is complete in the release table."""


@dataclass(frozen=True)
class Store:
    """Folder of the stored tables."""

    root: str

    def table(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @property
    def reports(self) -> str:
        return self.table("processed_reports")

    @property
    def pairs(self) -> str:
        return self.table("drug_event_pairs")

    @property
    def releases(self) -> str:
        return self.table("releases")

    @property
    def loads(self) -> str:
        return self.table("ingest_loads")

    @property
    def batches(self) -> str:
        return self.table("ingest_batches")


# --- ingest of one quarter ----------------------------------------------------


def ingest_reports(
    demo: DataFrame, drug: DataFrame, reac: DataFrame, outc: DataFrame | None, quarter: str, position: str = "_pos"
) -> DataFrame:
    """One record per usable report.

    Ids of the demographic and drug files are united and reports without a drug or
    without a reaction are left out, so the drug side drives: it is joined to the
    reactions and the other two files are looked up. All four sides are aggregated
    by report id first, so every join reuses that partitioning.
    """
    usable = primary_drug(drug, position).join(reactions_in_order(reac, position), "primaryid")
    full = usable.join(first_demo_per_report(demo, position), "primaryid", "left")
    if outc is None:
        full = full.withColumns(
            {
                "seriousness": F.lit(V.UNKNOWN_SERIOUSNESS),
                "seriousness_codes": F.array().cast("array<string>"),
            }
        )
    else:
        full = with_seriousness(full, seriousness_ingest(outc))
    return full.select(
        F.col("primaryid").alias("report_id"),
        "drug_name",
        "reactions",
        normalize_age_ingest(F.col("age"), F.col("age_cod")).alias("patient_age"),
        parse_sex_ingest(F.col("sex")).alias("patient_sex"),
        null_if_blank(F.col("event_dt")).alias("event_date"),
        "seriousness",
        "seriousness_codes",
        F.lit(quarter).alias("report_quarter"),
        F.lit(V.SOURCE_MARKER).alias("source"),
    )


def report_pairs(reports: DataFrame) -> DataFrame:
    """(drug, event, quarter) rows of report records."""
    return reports.select(
        "drug_name", F.explode("reactions").alias("event_name"), "report_quarter"
    )


def new_reports(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming reports whose id is not stored yet for their quarter."""
    return incoming.join(
        existing.select("report_id", "report_quarter"), ["report_id", "report_quarter"], "left_anti"
    )


def is_imported(spark: SparkSession, store: Store, quarter: str) -> bool:
    releases = read_table(spark, store.releases, RELEASE)
    return not releases.filter(F.col("release_id") == quarter).limit(1).isEmpty()


def quarter_frames(spark: SparkSession, folder: str) -> dict[str, DataFrame | None]:
    """Lenient reads of the members of one quarter; outcomes may be absent."""
    frames: dict[str, DataFrame | None] = {}
    for kind in ("DEMO", "DRUG", "REAC", "OUTC"):
        try:
            frames[kind] = scan_faers_unquoted(spark, find_quarter_member(spark, folder, kind))
        except MissingFileError:
            if kind != "OUTC":
                raise
            frames[kind] = None
    return frames


def _place(report_id: str) -> Column:
    """Where a report lies among all: its hash, from 0 to 2^31."""
    return F.pmod(F.xxhash64(report_id), F.lit(1 << 31))


def _placed(reports: DataFrame) -> DataFrame:
    """The reports with their place, in its order within every partition."""
    return reports.withColumn("_place", _place("report_id")).sortWithinPartitions("_place")


def ingest_batches(
    spark: SparkSession, incoming: DataFrame, quarter: str, store: Store, batch_reports: int = BATCH_REPORTS
) -> Iterator[int]:
    """Commit the reports range by range of their hashes; yields the number of each committed range.

    A range is written, then marked with its number, the number of all ranges and its reports. A
    later run deals the reports into as many ranges as the first one did and takes only the unmarked
    ones. In these it adds only what is not stored, for the case that a run ended between the two writes.
    """
    marks = read_table(spark, store.batches, INGEST_BATCH).filter(F.col("quarter") == quarter)
    known = marks.select("batch", "batches").collect()
    # Sorted as they come: every file holds all ranges in order, and a range reads its own pages of each.
    staged = stored(_placed(incoming), "incoming-reports")
    count = known[0].batches if known else min(MOST_BATCHES, max(1, -(-staged.count() // batch_reports)))
    done = {row.batch for row in known}
    # What this run writes to a range lies in that range alone, so the ids stored before are read once for all.
    before = read_table(spark, store.reports, REPORT).filter(F.col("report_quarter") == quarter)
    existing = stored(_placed(before.select("report_id", "report_quarter")), "existing-reports")
    for batch in range(count):
        if batch in done:
            continue
        low, high = ((1 << 31) * k // count for k in (batch, batch + 1))
        within = F.col("_place").between(low, high - 1)
        rows = staged.filter(within).drop("_place")
        new_reports(existing.filter(within), rows).write.mode("append").partitionBy("report_quarter").parquet(store.reports)
        mark = rows.agg(F.count(F.lit(1)).alias("reports")).select(
            F.lit(quarter).alias("quarter"), F.lit(batch).alias("batch"), F.lit(count).alias("batches"), "reports", F.current_timestamp().alias("committed_at")
        )
        mark.write.mode("append").parquet(store.batches)
        yield batch


# Fields of each file that a report is built from.
NEEDED = {
    "DEMO": ("primaryid", "age", "age_cod", "sex", "event_dt"),
    "DRUG": ("primaryid", "role_cod", "drugname"),
    "REAC": ("primaryid", "pt"),
    "OUTC": ("primaryid", "outc_cod"),
}


def quarter_load_counts(files: dict[str, DataFrame | None]) -> DataFrame:
    """(kind, rows, short_rows) of every present file."""
    out = None
    for kind, rows in files.items():
        if rows is not None:
            part = lenient_load_stats(rows, kind, *NEEDED[kind])
            out = part if out is None else out.unionByName(part)
    return out


def quarter_reports(spark: SparkSession, folder: str, quarter: str, files: dict[str, DataFrame | None] | None = None) -> DataFrame:
    """Report records of the files of one quarter."""
    files = files or quarter_frames(spark, folder)
    return ingest_reports(files["DEMO"], files["DRUG"], files["REAC"], files["OUTC"], quarter)


def ingest_quarter(
    spark: SparkSession, folder: str, quarter: str, store: Store, version: str = "v1.0.0", batch_reports: int = BATCH_REPORTS
) -> None:
    """Read one quarter of files into the stored tables.

    A complete quarter is refused. The rows of each file and those that end early are counted first.
    Reports are committed in batches; after a failure a rerun takes those that are not. The pair counts are computed from the stored reports, and the release
    row, written last, marks the quarter complete.
    """
    quarter = quarter.upper()
    if is_imported(spark, store, quarter):
        raise AlreadyImportedError(quarter)
    files = quarter_frames(spark, folder)
    replace_partitions(quarter_load_counts(files).withColumn("quarter", F.lit(quarter)), store.loads, "quarter")
    for _ in ingest_batches(spark, quarter_reports(spark, folder, quarter, files), quarter, store, batch_reports):
        pass
    reports = read_table(spark, store.reports, REPORT).filter(F.col("report_quarter") == quarter)
    replace_quarter_pairs(quarterly_pair_counts(report_pairs(reports)), store.pairs)
    total = reports.agg(F.count(F.lit(1)).alias("n"))
    release_row(spark, quarter, total, version).write.mode("append").parquet(store.releases)


# --- loading of exported report files -----------------------------------------


def load_report_level(
    spark: SparkSession,
    reports_csv: str,
    pairs_csv: str,
    quarter: str,
    store: Store,
    version: str = "v1.0.0",
) -> None:
    """Insert or update exported reports, replace the quarter's pair counts and
    insert or update its release row."""
    reports = scan_reports_csv(spark, reports_csv, quarter)
    upsert_reports(spark, store.reports, reports, REPORT)
    pairs = spark.read.option("header", True).option("escape", '"').csv(pairs_csv)
    counts = quarterly_pair_counts(pairs.withColumn("report_quarter", F.lit(quarter)))
    replace_quarter_pairs(counts, store.pairs)
    row = release_row(spark, quarter, reports.agg(F.count(F.lit(1)).alias("n")), version)
    releases = upsert(read_table(spark, store.releases, RELEASE), row, ["release_id"])
    # One small row per release: it is staged and swapped like a partition.
    rewrite_partitions(releases.withColumn("part", F.lit(0)), store.releases, "part")


# --- seriousness backfill -------------------------------------------------------


def backfill_plan(reports: DataFrame, outc: DataFrame) -> DataFrame:
    """Reports with their new class and whether it differs from the stored one."""
    fresh = seriousness_ingest(outc).select(
        F.col("primaryid").alias("report_id"),
        F.col("seriousness").alias("_class"),
        F.col("seriousness_codes").alias("_codes"),
    )
    empty = F.array().cast("array<string>")
    joined = reports.join(fresh, "report_id", "left")
    new_class = F.coalesce("_class", F.lit(V.UNKNOWN_SERIOUSNESS))
    new_codes = F.coalesce("_codes", empty)
    same = (F.col("seriousness") == new_class) & (F.coalesce("seriousness_codes", empty) == new_codes)
    return joined.withColumn("changed", ~F.coalesce(same, F.lit(False))).withColumns(
        {"seriousness": new_class, "seriousness_codes": new_codes}
    ).select(*reports.columns, "changed")


def backfill_summary(plan: DataFrame) -> DataFrame:
    """Scoped and updated reports and reports per class; one row."""
    return plan.agg(
        F.count(F.lit(1)).alias("reports_scoped"),
        F.count_if("changed").alias("reports_updated"),
        F.count_if(F.col("seriousness") == V.SERIOUS).alias("serious"),
        F.count_if(F.col("seriousness") == V.NON_SERIOUS).alias("non_serious"),
        F.count_if(F.col("seriousness") == V.UNKNOWN_SERIOUSNESS).alias("unknown"),
    )


def backfill_seriousness(spark: SparkSession, folder: str, quarter: str, store: Store) -> DataFrame:
    """Reclassify the stored reports of one quarter; other quarters are not read.

    Returns the summary. Nothing is written when no report changes.
    """
    quarter = quarter.strip().upper()
    if len(quarter) != 6 or quarter[4] != "Q":
        raise ValueError("quarter must look like 2026Q1")
    member = find_quarter_member(spark, folder, "OUTC", exact=file_name("OUTC", quarter))
    outc = scan_faers_unquoted(spark, member, encoding="UTF-8")
    reports = spark.read.schema(REPORT).parquet(store.reports).filter(F.col("report_quarter") == quarter)
    # Written once: the summary, the look for changes and the new partition read it.
    plan = stored(backfill_plan(reports, outc), "backfill")
    if not plan.filter("changed").limit(1).isEmpty():
        replace_partitions(plan.drop("changed"), store.reports, "report_quarter")
    return backfill_summary(plan)


# --- import of enriched signals ---------------------------------------------------


def import_metrics(spark: SparkSession, signals: DataFrame, metrics: DataFrame, current: str | None, target: str) -> None:
    """Write the metric table after an import to a new path: rows of imported signals are new."""
    rows = metrics_rows(known_metrics(metrics, signals), signals)
    if current and path_exists(spark, current):
        rows = upsert(spark.read.schema(rows.schema).parquet(current), rows, ["signal_id"])
    rows.write.mode("overwrite").parquet(target)


def import_signals(
    spark: SparkSession, batch: DataFrame, current: str | None, target: str, dry_run: bool = False
) -> DataFrame:
    """Write the signal table after an import to a new path; returns the counters.

    ``batch`` has a position column ``_pos``. The old table stays readable until its
    readers move on. ``import_metrics`` follows with the signals' metric rows.
    """
    counters = import_counters(batch)
    if not dry_run:
        existing = (
            read_table(spark, current, SIGNAL_STORED)
            if current and path_exists(spark, current)
            else spark.createDataFrame([], SIGNAL_STORED)
        )
        upsert_signals(existing, batch).write.mode("overwrite").parquet(target)
    return counters
