"""Changes to stored tables and whole jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advigil.operators.contingency import pair_counts, quarterly_pair_counts
from advigil.operators.pairs import pair_universe
from advigil.plans import table_jobs as jobs
from advigil.plans.detection_job import run_detection
from advigil.plans.enrichment_job import run_enrichment as enrich_files
from advigil.plans.star_schema import StarSchema
from advigil.queries.groups import ingested
from advigil.queries.shown import collector, flat
from advigil.schemas import RAW, REPORT, SIGNAL_STORED
from advigil.session import scratch_path
from advigil.sinks import files as out
from advigil.sinks import tables
from advigil.sources.faers import table_path
from advigil.streaming.arrivals import ingest_arrivals
from advigil.streaming.report_files import stream_report_files, streamed_table

QUERIES: dict = {}
query = collector(QUERIES)


def _store(s: StarSchema) -> jobs.Store:
    return jobs.Store(scratch_path(s.spark, "store"))


def _batch(s: StarSchema) -> DataFrame:
    """An import batch: strong signals twice (the second time with another status)
    and records with an empty event name."""
    strong = s.signals.filter(F.col("prr") > 2.1).select("*", F.lit(7).alias("rank"))
    again = strong.withColumn("candidate_status", F.lit("under_review"))
    broken = strong.withColumn("event_name", F.lit(""))
    return (
        strong.withColumn("_pos", F.lit(1))
        .unionByName(again.withColumn("_pos", F.lit(2)))
        .unionByName(broken.withColumn("_pos", F.lit(3)))
    )


@query
def upsert_signals(s: StarSchema) -> DataFrame:
    existing = s.signals.select(
        "*", F.lit(0).alias("rank"), F.array(F.lit("kept")).alias("known_limitations")
    ).select(*SIGNAL_STORED.names)
    merged = tables.upsert_signals(existing, _batch(s))
    return flat(merged.select("signal_id", "candidate_status", "rank", "known_limitations", "prr"))


@query
def import_counters(s: StarSchema) -> DataFrame:
    return tables.import_counters(_batch(s))


@query
def metrics_rows(s: StarSchema) -> DataFrame:
    rows = tables.metrics_rows(s.stored_metrics, s.signals)
    return flat(rows.select("signal_id", "prr", "ror", "report_count", F.col("contingency_table.d").alias("d"), "chi_square"))


@query
def upsert_reports(s: StarSchema) -> DataFrame:
    """Reports of all quarters are stored, then serious ones are written again with a
    changed source."""
    path = _store(s).reports
    tables.upsert_reports(s.spark, path, s.stored_reports, REPORT)
    changed = s.stored_reports.filter("seriousness = 'Serious'").withColumn("source", F.lit("CORRECTED"))
    tables.upsert_reports(s.spark, path, changed, REPORT)
    return flat(s.spark.read.schema(REPORT).parquet(path).select("report_id", "drug_name", "seriousness", "report_quarter", "source"))


@query
def one_row_per_report(s: StarSchema) -> DataFrame:
    return tables.one_row_per_report(s.reports).select("report_id", "drug_name")


@query
def replace_quarter_pairs(s: StarSchema) -> DataFrame:
    """All quarters are stored twice over, then replaced: nothing is added up."""
    path = _store(s).pairs
    counts = s.stored(quarterly_pair_counts(s.dated_pairs), "quarter-counts")
    tables.replace_quarter_pairs(counts.withColumn("count", F.col("count") * 2), path)
    tables.replace_quarter_pairs(counts.filter("quarter >= '1998Q1'"), path)
    return s.spark.read.parquet(path).select(
        "drug_name", "event_name", F.col("quarter").cast("string").alias("quarter"), "count"
    )


@query
def ingest_quarter_idempotent(s: StarSchema) -> DataFrame:
    """Ingest of files after an interrupted run that stored the reports of women."""
    store = _store(s)
    partial = s.stored(ingested(s), "ingested").filter("patient_sex = 'F'")
    partial.write.partitionBy("report_quarter").parquet(store.reports)
    jobs.ingest_quarter(s.spark, s.quarter_folder, s.QUARTER, store)
    try:
        jobs.ingest_quarter(s.spark, s.quarter_folder, s.QUARTER, store)
        refused = False
    except jobs.AlreadyImportedError:
        refused = True
    reports = s.spark.read.schema(REPORT).parquet(store.reports)
    return flat(reports.select("report_id", "drug_name", "reactions", "patient_age", "patient_sex", "seriousness").withColumn("refused", F.lit(refused)))


@query
def ingest_new_files(s: StarSchema) -> DataFrame:
    """The release arrives as a stream of markers; the pair counts it leaves."""
    store = _store(s)
    landing = scratch_path(s.spark, "landing")
    for kind in ("DEMO", "DRUG", "REAC", "OUTC"):
        s.write_lines(kind, f"{landing}/{s.QUARTER}/{kind}26Q1.txt")
    markers, progress = f"{landing}/markers", scratch_path(s.spark, "stream")
    s.spark.range(1).select(F.lit(s.QUARTER).alias("value")).write.text(markers)
    for _ in range(2):
        run = ingest_arrivals(s.spark, landing, store, progress, markers=markers, pattern="part-*")
        run.awaitTermination()
    return s.spark.read.parquet(store.pairs).select("drug_name", "event_name", "count")


@query
def ingest_in_batches(s: StarSchema) -> DataFrame:
    """An ingest in about four commits that ends after the first one and is taken up again."""
    store = _store(s)
    incoming = jobs.quarter_reports(s.spark, s.quarter_folder, s.QUARTER)
    size = -(-incoming.count() // 4)
    started = jobs.ingest_batches(s.spark, incoming, s.QUARTER, store, size)
    next(started)
    started.close()
    early = s.stored(s.spark.read.schema(REPORT).parquet(store.reports).select("report_id"), "early")
    complete = jobs.is_imported(s.spark, store, s.QUARTER)
    jobs.ingest_quarter(s.spark, s.quarter_folder, s.QUARTER, store, batch_reports=10)
    marks = s.spark.read.parquet(store.batches).agg(F.count_distinct("batch").alias("n"), F.count(F.lit(1)).alias("rows"), F.sum("reports").alias("reports"))
    part = early.agg(F.count(F.lit(1)).alias("n"))
    reports = s.spark.read.schema(REPORT).parquet(store.reports)
    facts = marks.crossJoin(part.withColumnRenamed("n", "part")).select(
        (F.col("n") == 4).alias("four_batches"),
        (F.col("rows") == 4).alias("marked_once"),
        F.col("reports").alias("marked_reports"),
        ((F.col("part") > 0) & (F.col("part") < F.col("reports"))).alias("stopped_early"),
    )
    rows = flat(reports.select("report_id", "drug_name", "reactions", "patient_age", "patient_sex", "seriousness"))
    return rows.crossJoin(facts).withColumn("complete_early", F.lit(complete))


def streamed(s: StarSchema) -> str:
    """Three arrivals of report files as streams. Versions of a case are spread over the arrivals, so that
    some are overtaken by later quarters and some arrive after newer ones."""
    landing, found, progress = (scratch_path(s.spark, name) for name in ("landing", "streamed", "progress"))
    third = F.pmod(F.col("primaryid").cast("bigint"), F.lit(3))
    for n, quarter in enumerate(("2025Q3", "2025Q4", "2026Q1")):
        for kind in RAW:
            s.write_lines(kind, f"{landing}/{quarter}/{kind}{quarter[2:4]}Q{quarter[-1]}.txt", only=third == n)
        for run in stream_report_files(s.spark, landing, found, progress):
            run.awaitTermination()
    return found


@query
def stream_newest_cases(s: StarSchema) -> DataFrame:
    rows = streamed_table(s.spark, streamed(s), "DEMO")
    return rows.select("caseid", "primaryid", "caseversion", "event_dt", F.col("report_quarter").cast("string").alias("report_quarter"))


@query
def stream_pair_counts(s: StarSchema) -> DataFrame:
    """Pair counts of the streamed rows that belong to newest versions."""
    found = streamed(s)
    drug, reac, cases = (streamed_table(s.spark, found, kind) for kind in ("DRUG", "REAC", "DEMO"))
    return pair_counts(pair_universe(drug, reac, cases)).select("drug_name", "event_name", "a")


@query
def release_metadata(s: StarSchema) -> DataFrame:
    row = tables.release_row(s.spark, s.QUARTER, s.cases.agg(F.count(F.lit(1)).alias("n")))
    return row.select("release_id", "dataset_release", "processing_version", "total_reports")


@query
def import_enriched_signals(s: StarSchema) -> DataFrame:
    """Signals and their metrics imported together, twice; the metric table."""
    signals, metrics = scratch_path(s.spark, "import-signals"), scratch_path(s.spark, "import-metrics")
    lacking = {f.name: F.lit(None).cast(f.dataType) for f in SIGNAL_STORED.fields if f.name not in s.signals.columns}
    batch = s.signals.withColumns(lacking).withColumn("_pos", F.monotonically_increasing_id())
    for n in (1, 2):
        jobs.import_signals(s.spark, batch, f"{signals}/{n - 1}", f"{signals}/{n}")
        imported = s.spark.read.parquet(f"{signals}/{n}")
        jobs.import_metrics(s.spark, imported, s.stored_metrics, f"{metrics}/{n - 1}", f"{metrics}/{n}")
    rows = s.spark.read.parquet(f"{metrics}/2")
    return flat(rows.select("signal_id", "prr", "ror", "report_count", F.col("contingency_table.d").alias("d"), "chi_square"))


# --- whole jobs --------------------------------------------------------------------


@query
def detection_run(s: StarSchema) -> DataFrame:
    """Files of the release through all stages; the signals it writes."""
    done = run_detection(s.spark, s.quarter_folder, s.QUARTER, scratch_path(s.spark, "run"))
    return flat(
        s.spark.read.parquet(done.signals).select(
            "signal_id", "drug_name", "event_name", "supporting_report_count", "prr", "ror", "dataset_version"
        )
    )


@query
def detection_run_of_quarters(s: StarSchema) -> DataFrame:
    """Versions of a case spread over the files of three quarters, detected together; the signals and their reports."""
    folder = scratch_path(s.spark, "quarters")
    third = F.pmod(F.col("primaryid").cast("bigint"), F.lit(3))
    quarters = ["2025Q3", "2025Q4", "2026Q1"]
    for n, quarter in enumerate(quarters):
        for kind in RAW:
            s.write_lines(kind, table_path(folder, kind, quarter), only=third == n)
    done = run_detection(s.spark, folder, quarters, scratch_path(s.spark, "run"))
    found = s.spark.read.parquet(done.signals).select("signal_id", "supporting_report_count", "prr", "dataset_version")
    own = s.spark.read.parquet(done.reports).groupBy("report_quarter").agg(F.count(F.lit(1)).alias("n"))
    counts = own.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "report_quarter", "n"))), ";").alias("reports"))
    return flat(found).withColumn("reports", counts.scalar())


@query
def normalized_reports(s: StarSchema) -> DataFrame:
    return flat(s.reports)


@query
def enrichment_run(s: StarSchema) -> DataFrame:
    """Signal and metric files to a ranked signal file."""
    folder = scratch_path(s.spark, "enrichment")
    out.write_records_json(s.candidates, f"{folder}/signals")
    s.metrics.write.option("header", True).csv(f"{folder}/metrics")
    enrich_files(s.spark, f"{folder}/signals", f"{folder}/metrics", f"{folder}/out")
    done = s.spark.read.schema(SIGNAL_STORED).json(f"{folder}/out")
    return flat(done.select("signal_id", "risk_score", "priority_level", "rank"))


@query
def load_report_level(s: StarSchema) -> DataFrame:
    """Exported report and pair files loaded twice; the quarter's pair counts."""
    folder = scratch_path(s.spark, "exports")
    out.write_dataset_csv(s.stored_reports, f"{folder}/reports")
    out.write_dataset_csv(s.pairs.select("primaryid", "drug_name", "event_name"), f"{folder}/pairs")
    store = _store(s)
    for _ in range(2):
        jobs.load_report_level(s.spark, f"{folder}/reports", f"{folder}/pairs", s.QUARTER, store)
    total = s.spark.read.parquet(store.releases).agg(F.sum("total_reports").alias("n"))
    return s.spark.read.parquet(store.pairs).select("drug_name", "event_name", "count").withColumn("release_reports", total.scalar())


@query
def backfill_seriousness(s: StarSchema) -> DataFrame:
    """Stored reports without outcomes reclassified from the outcome file."""
    store = _store(s)
    stored = ingested(s).withColumns(
        {"seriousness": F.lit("Unknown"), "seriousness_codes": F.array().cast("array<string>")}
    )
    stored.write.partitionBy("report_quarter").parquet(store.reports)
    jobs.backfill_seriousness(s.spark, s.quarter_folder, s.QUARTER, store)
    return flat(s.spark.read.schema(REPORT).parquet(store.reports).select("report_id", "drug_name", "seriousness", "seriousness_codes"))


@query
def ingest_faers(s: StarSchema) -> DataFrame:
    """Records built from the files of the release."""
    files = jobs.quarter_frames(s.spark, s.quarter_folder)
    return flat(jobs.ingest_reports(files["DEMO"], files["DRUG"], files["REAC"], files["OUTC"], s.QUARTER))
