"""Readers and writers, on files that Spark writes from the tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from advigil import fixed_values as V
from advigil.functions.text import parse_reactions_cell
from advigil.plans.star_schema import RAW_LINES, StarSchema
from advigil.queries.shown import collector, flat, joined
from advigil.session import scratch_path
from advigil.sinks import files as out
from advigil.sinks import records, runs
from advigil.sources import documents, faers, openfda, signals
from advigil.operators.cases import case_version_stats, demo_audit
from advigil.operators.reports import primary_drug
from advigil.schemas import RAW

QUERIES: dict = {}
query = collector(QUERIES)


def ragged_demo(s: StarSchema) -> str:
    """The demographic file with rows of customers' case version 5 cut short."""
    path = faers.table_path(scratch_path(s.spark, "ragged"), "DEMO", s.QUARTER)
    s.write_lines("DEMO", path, ragged=F.col("caseversion") == "5")
    return path


@query
def scan_faers_table(s: StarSchema) -> DataFrame:
    table = faers.scan_faers_table(s.spark, ragged_demo(s), "DEMO")
    return table.select("primaryid", "caseid", "caseversion", "event_dt", "age", "age_cod", "sex")


@query
def scan_quoted_cells(s: StarSchema) -> DataFrame:
    """Every document as a quoted cell with its line breaks and quotes, read back by all splits."""
    path = faers.table_path(scratch_path(s.spark, "quoted"), "REAC", s.QUARTER)
    names = RAW["REAC"].names
    cell = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(V.FIELD_SEPARATOR, "doc_id", "doc_id", cell, "lang").alias("value")
    texts = s.table("documents").select(F.pmod(F.xxhash64("doc_id"), F.lit(16)).alias("part"), F.lit(1).alias("row"), line)
    heads = s.spark.range(16).select(F.col("id").alias("part"), F.lit(0).alias("row"), F.lit(V.FIELD_SEPARATOR.join(names)).alias("value"))
    parts = texts.unionByName(heads).repartition("part").sortWithinPartitions("part", "row")
    parts.select("part", "value").write.partitionBy("part").text(path)
    rows = faers.scan_faers_table(s.spark, path, "REAC")
    return rows.select("primaryid", F.length("pt").cast("bigint").alias("characters"), F.md5(F.encode("pt", "UTF-8")).alias("digest"), "drug_rec_act")


def tied_drugs(s: StarSchema) -> DataFrame:
    """The drug file with one sequence number for all rows, the last line of a report first."""
    path = faers.table_path(scratch_path(s.spark, "ties"), "DRUG", s.QUARTER)
    names = RAW["DRUG"].names
    rows = s.drug.withColumn("line", F.col("drug_seq").cast("int")).withColumn("drug_seq", F.lit("1"))
    cells = [F.col(c) if c in rows.columns else F.lit("") for c in names]
    ordered = rows.orderBy("primaryid", F.desc("line"), "drugname")
    ordered.select(F.concat_ws(V.FIELD_SEPARATOR, *cells).alias(V.FIELD_SEPARATOR.join(names))).write.options(**RAW_LINES).csv(path)
    return faers.scan_faers_table(s.spark, path, "DRUG")


@query
def natural_key_sort(s: StarSchema) -> DataFrame:
    """Place of every drug row among those of its report and case, as in the file."""
    order = W.partitionBy("primaryid", "caseid").orderBy(faers.POS)
    rows = faers.in_natural_order(tied_drugs(s))
    return rows.withColumn("place", F.row_number().over(order).cast("bigint")).select("primaryid", "caseid", "drugname", "place")


@query
def primary_drug_in_file_order(s: StarSchema) -> DataFrame:
    """First suspect drug of every report where all sequence numbers tie."""
    return primary_drug(tied_drugs(s), faers.POS)


@query
def scan_faers_unquoted(s: StarSchema) -> DataFrame:
    path = faers.table_path(s.quarter_folder, "DRUG", s.QUARTER)
    rows = faers.scan_faers_unquoted(s.spark, path)
    return rows.groupBy("primaryid", "role_cod", "drugname").agg(F.count(F.lit(1)).alias("rows"))


@query
def load_stats(s: StarSchema) -> DataFrame:
    path = ragged_demo(s)
    return faers.load_stats(faers.read_table_rows(s.spark, path, "DEMO"), "DEMO")


@query
def validate_header(s: StarSchema) -> DataFrame:
    """Fails on a wrong header; the result counts data lines of the accepted file."""
    path = faers.table_path(s.quarter_folder, "REAC", s.QUARTER)
    faers.validate_header(s.spark, path, "REAC")
    header = V.FIELD_SEPARATOR.join(V.REAC_COLUMNS)
    lines = s.spark.read.text(path).filter(F.col("value") != header)
    return lines.agg(F.count(F.lit(1)).alias("data_lines")).withColumn("header_ok", F.lit(True))


@query
def validate_keys(s: StarSchema) -> DataFrame:
    """Reports that pass the id check, with their number of reaction rows."""
    checked = faers.validate_keys(s.reac, "REAC")
    return checked.groupBy("primaryid").agg(F.count(F.lit(1)).alias("rows"))


@query
def scan_deleted_cases(s: StarSchema) -> DataFrame:
    path = scratch_path(s.spark, "deleted")
    padded = s.deleted.select(F.concat(F.lit("  "), F.col("caseid"), F.lit(" ")).alias("value"))
    padded.unionByName(s.deleted.select(F.lit("").alias("value"))).write.text(path)
    return faers.scan_deleted_cases(s.spark, path)


@query
def scan_quarter(s: StarSchema) -> DataFrame:
    tables = faers.scan_quarter(s.spark, s.quarter_folder, s.QUARTER)
    return runs.reconciliation(**{k.lower(): v for k, v in tables.items()})


@query
def find_quarter_members(s: StarSchema) -> DataFrame:
    """Members of each kind with the data lines they hold."""
    parts = None
    for kind in ("DEMO", "DRUG", "REAC", "OUTC"):
        member = faers.find_quarter_member(s.spark, s.quarter_folder, kind.lower())
        lines = s.spark.read.text(member).filter(~F.col("value").startswith("primaryid$"))
        name = F.lit(member.rstrip("/").rsplit("/", 1)[-1])
        row = lines.agg(F.count(F.lit(1)).alias("data_lines")).withColumn("member", name)
        parts = row if parts is None else parts.unionByName(row)
    return parts


@query
def encoding_fallback(s: StarSchema) -> DataFrame:
    """Document texts written once as UTF-8 and once as Latin-1, read back as found."""
    folder = scratch_path(s.spark, "encodings")
    texts = s.table("documents").select(
        F.concat_ws("$", F.col("doc_id"), F.col("lang"), F.regexp_replace("text", r"[\r\n$]+", " ")).alias(
            "doc_id$lang$text"
        )
    )
    for encoding in ("UTF-8", "ISO-8859-1"):
        texts.write.options(**RAW_LINES).option("encoding", encoding).csv(f"{folder}/{encoding}")
    parts = None
    for encoding in ("UTF-8", "ISO-8859-1"):
        path = f"{folder}/{encoding}"
        found = faers.file_encodings(s.spark, path).agg(F.min("encoding").alias("e"))
        rows = faers.scan_faers_unquoted(s.spark, path)
        counted = rows.groupBy("lang").agg(
            F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("characters")
        )
        counted = counted.withColumn("written_as", F.lit(encoding)).withColumn("read_as", found.scalar())
        parts = counted if parts is None else parts.unionByName(counted)
    return parts


@query
def scan_signals_json(s: StarSchema) -> DataFrame:
    path = scratch_path(s.spark, "signals-json")
    out.write_records_json(s.candidates, path)
    read = signals.scan_signals_json(s.spark, path)
    return flat(read.select("signal_id", "drug_name", "event_name", "supporting_report_count", "prr", "ror", "candidate_status"))


@query
def scan_signals_array(s: StarSchema) -> DataFrame:
    """A signal for every pair, in files that each hold one array over many lines or on one."""
    path = scratch_path(s.spark, "signals-array")
    record = F.struct(
        "signal_id",
        F.concat("drug_name", F.lit(' "}[{')).alias("drug_name"),
        "event_name",
        F.col("a").alias("supporting_report_count"),
        "prr",
        F.array(F.struct(F.lit("}\\").alias("k"))).alias("notes"),
    )
    part, place = F.pmod(F.xxhash64("drug_name"), F.lit(32)).alias("part"), F.struct("signal_id", "drug_name", "event_name")
    rows = s.stored_metrics.select("signal_id", part, place.alias("place"), F.to_json(record).alias("record"))
    # The ends of a file come from its least and greatest row: no task holds the records of a file.
    ends = rows.groupBy("part").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    line = F.concat(F.when(F.col("place") == F.col("first"), "[").otherwise(","), "record", F.when(F.col("place") == F.col("last"), "]").otherwise(""))
    lines = s.stored(rows.join(ends, "part").select("part", "place", line.alias("value")), "array-lines")
    for even, separator in ((0, "\n"), (1, " ")):
        part = lines.filter(F.col("part") % 2 == even).repartition("part").sortWithinPartitions("part", "place")
        part.select("part", "value").write.mode("append").partitionBy("part").option("lineSep", separator).text(path)
    read = signals.scan_signals_json(s.spark, path)
    return flat(read.select("signal_id", "drug_name", "event_name", "supporting_report_count", "prr"))


@query
def scan_metrics_csv(s: StarSchema) -> DataFrame:
    path = scratch_path(s.spark, "metrics-csv")
    s.metrics.write.option("header", True).csv(path)
    read = signals.scan_metrics_csv(s.spark, path)
    return flat(read.select("signal_id", "chi_square", "prr_lower", "prr_upper", "ror_lower", "ror_upper"))


@query
def parse_reactions_cell_json_and_text(s: StarSchema) -> DataFrame:
    """Reaction cells of every report in both spellings."""
    cells = s.reac.groupBy("primaryid").agg(F.array_sort(F.collect_set("pt")).alias("pts"))
    texts = cells.select(
        "primaryid",
        F.concat(F.array_join("pts", "|"), F.lit("| |"), F.element_at("pts", 1)).alias("bar"),
        F.to_json(F.transform("pts", lambda x: F.lower(x))).alias("json"),
    )
    return texts.select(
        "primaryid",
        joined(parse_reactions_cell(F.col("bar"))).alias("from_text"),
        joined(parse_reactions_cell(F.col("json"))).alias("from_json"),
    )


@query
def scan_reports_csv(s: StarSchema) -> DataFrame:
    path = scratch_path(s.spark, "reports-csv")
    blank = s.reports.withColumn("report_quarter", F.lit(" "))
    out.write_dataset_csv(blank, path)
    return flat(signals.scan_reports_csv(s.spark, path, s.QUARTER))


@query
def flatten_openfda_labels(s: StarSchema) -> DataFrame:
    """Saved label pages, one per brand, made of the parts table."""
    path = scratch_path(s.spark, "labels")
    label = F.struct(
        F.struct(
            F.array("p_name").alias("brand_name"),
            F.array(F.upper("p_name")).alias("generic_name"),
            F.array("p_brand").alias("manufacturer_name"),
            F.when(F.col("p_size") > 25, F.array("p_type")).alias("product_type"),
        ).alias("openfda"),
        F.array(F.concat(F.lit("purpose "), F.col("p_type"))).alias("purpose"),
        F.array(F.repeat("p_name", 80)).alias("warnings"),
    )
    s.table("part").select(F.array(label).alias("results")).write.json(path)
    flattened = openfda.flatten_labels(s.spark.read.schema(openfda.LABEL_SCHEMA).json(path))
    return flat(flattened)


@query
def flatten_openfda_events(s: StarSchema) -> DataFrame:
    """Saved event pages, one per report."""
    path = scratch_path(s.spark, "event-pages")
    drugs = s.drug.groupBy("primaryid").agg(
        F.array_sort(F.collect_set(F.struct(F.trim("drugname").alias("medicinalproduct")))).alias("drug")
    )
    terms = s.reac.groupBy("primaryid").agg(
        F.array_sort(F.collect_set(F.struct(F.trim("pt").alias("reactionmeddrapt")))).alias("reaction")
    )
    report = F.struct(
        F.col("primaryid").alias("safetyreportid"),
        F.nullif("event_dt", F.lit("")).alias("receivedate"),
        F.struct(
            F.nullif("age", F.lit("")).alias("patientonsetage"),
            F.trim("sex").alias("patientsex"),
            "drug",
            F.array_append("reaction", F.struct(F.lit("").alias("reactionmeddrapt"))).alias("reaction"),
        ).alias("patient"),
    )
    pages = s.demo.join(drugs, "primaryid").join(terms, "primaryid").select(F.array(report).alias("results"))
    pages.write.json(path)
    flattened = openfda.flatten_events(s.spark.read.schema(openfda.EVENT_SCHEMA).json(path))
    return flat(flattened)


@query
def scan_documents_binary(s: StarSchema) -> DataFrame:
    """Every document and web page as an upload with bytes, size and name."""
    docs = s.table("documents").select(
        F.concat(F.lit("/uploads/doc"), F.col("doc_id"), F.when(F.col("doc_id") % 10 == 3, ".pdf").otherwise(".TXT")).alias("path"),
        F.encode("text", "UTF-8").alias("content"),
    )
    pages = s.table("pages").select(
        F.concat(F.lit("/uploads/page"), F.col("page_id"), F.lit(".html")).alias("path"),
        F.encode("html", "UTF-8").alias("content"),
    )
    files = docs.unionByName(pages).withColumn("length", F.octet_length("content").cast("bigint"))
    checked = documents.check_documents(files, max_bytes=20_000)
    return checked.select(
        "filename",
        "file_type",
        "file_size_bytes",
        "status",
        "over_size",
        F.length("extracted_text").cast("bigint").alias("text_length"),
        F.length("extracted_text_preview").cast("bigint").alias("preview_length"),
    )


@query
def write_dataset_csv(s: StarSchema) -> DataFrame:
    path = scratch_path(s.spark, "dataset")
    out.write_dataset_csv(s.reports, path)
    return s.spark.read.option("header", True).option("escape", '"').csv(path).select(
        "report_id", "drug_name", "reactions", "patient_sex", "seriousness", "seriousness_codes", "report_quarter"
    )


@query
def write_records_json(s: StarSchema) -> DataFrame:
    path = scratch_path(s.spark, "records")
    out.write_records_json(s.reports, path)
    nulls = s.spark.read.text(path).select(
        F.get_json_object("value", "$.report_id").alias("report_id"),
        F.get_json_object("value", "$.drug_name").alias("drug_name"),
        F.col("value").contains('"patient_sex":null').alias("null_sex_written"),
        F.col("value").startswith('{"drug_name":').alias("keys_sorted"),
    )
    return nulls


@query
def validate_records(s: StarSchema) -> DataFrame:
    """Contract violations of report records whose fields some fault was put into."""
    faulty = s.reports.withColumns(
        {
            "source": F.when(F.col("patient_age") > 80, "OTHER").otherwise(F.col("source")),
            "seriousness": F.when(F.col("patient_sex") == "F", F.lower("seriousness")).otherwise(F.col("seriousness")),
            "report_quarter": F.when(F.col("event_date").isNotNull(), F.col("report_quarter")),
        }
    )
    return records.violation_counts(faulty, records.REPORT_CONTRACT)


@query
def quality_ledger(s: StarSchema) -> DataFrame:
    ledger = runs.quality_ledger(
        runs.ledger_rows("preprocess/demo", demo_audit(s.typed)),
        runs.ledger_rows("case_processing/case_version", case_version_stats(s.demo), {"rows_excluded": "older versions"}),
    )
    return ledger.select("stage", "reason", "count")


@query
def ledger_totals(s: StarSchema) -> DataFrame:
    return runs.ledger_total(quality_ledger(s))


def _manifest_files(s: StarSchema) -> DataFrame:
    paths = {(kind, s.QUARTER): faers.table_path(s.quarter_folder, kind, s.QUARTER) for kind in RAW}
    loads = None
    for (kind, quarter), path in paths.items():
        part = faers.load_stats(faers.read_table_rows(s.spark, path, kind), kind).withColumn("quarter", F.lit(quarter))
        loads = part if loads is None else loads.unionByName(part)
    return s.stored(runs.manifest_files(s.spark, paths, loads), "manifest-files")


@query
def run_manifest(s: StarSchema) -> DataFrame:
    from advigil.policy import DETECTION

    counts = s.cases.agg(F.count(F.lit(1)).alias("cases"))
    manifest = runs.run_manifest(s.QUARTER, DETECTION, counts, _manifest_files(s))
    return manifest.select(
        "quarter", "outcome", F.col("counts.cases").alias("cases"), "inputs.files", "inputs.loaded_rows", "inputs.rejected_rows", F.col("config.min_prr").alias("min_prr")
    )


@query
def manifest_files(s: StarSchema) -> DataFrame:
    """Digest of the data lines of each kind, over all parts, with its load statistics."""
    files, rows = _manifest_files(s), None
    for kind in RAW:
        own = F.sha2(F.lit(V.FIELD_SEPARATOR.join(RAW[kind].names)), 256)
        # Every part file has one header line; it is taken off again.
        digits = [F.conv(F.substring(own, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(runs.DIGEST_PARTS)]
        numbers = [F.sum(F.get(F.split("digest", ":"), i).cast("decimal(38,0)") - (F.lit(1) if i == 0 else digits[i - 1])) for i in range(runs.DIGEST_PARTS + 1)]
        text = F.concat_ws(":", *[n.cast("string") for n in numbers]).alias("digest")
        part = files.filter(F.col("kind") == kind).groupBy("kind").agg(text, F.max("loaded_rows").alias("loaded_rows"), F.max("rejected_rows").alias("rejected_rows"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query
def reconciliation(s: StarSchema) -> DataFrame:
    return runs.reconciliation(
        raw_demo_rows=s.demo,
        raw_drug_rows=s.drug,
        raw_reac_rows=s.reac,
        cases_after_version_handling=s.cases,
        metrics_rows=s.metrics,
        candidates=s.candidates,
    )
