"""Report tables as views over a star schema of orders, lines, parts and suppliers.

An order is a report, a customer's orders of one year are versions of one case, a
line names a drug (its part) and a reaction (its supplier) and has an outcome (its
return flag).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advigil.fixed_values import FIELD_SEPARATOR
from advigil.operators import cases as case_ops
from advigil.operators.contingency import disproportionality, pair_counts
from advigil.operators.detection import detect_signals
from advigil.operators.enrichment import enrich_signals
from advigil.operators.name_index import report_names, write_name_index
from advigil.operators.pairs import pair_universe, pairs_of_sides, report_events, suspect_drugs
from advigil.operators.reports import reports_of_sides, reports_of_tables
from advigil.operators.support import event_counts_by_quarter, trend_series
from advigil.plans.report_table import report_event_rows, write_report_events
from advigil.schemas import RAW
from advigil.session import REPORT_DEFAULTS, prepare, scratch_path
from advigil.sources.faers import table_path


# Options that write one text column as it is, under its own name as header line.
RAW_LINES = {
    "header": True,
    "sep": "\u0001",
    "quote": "",
    "escape": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


class StarSchema:
    """Lazy views over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark, REPORT_DEFAULTS)
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """Write a frame once into the shared folder and read it back."""
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    # --- raw tables (text columns) ------------------------------------------

    @cached_property
    def demo(self) -> DataFrame:
        date = F.col("o_orderdate")
        half_year = F.concat(
            F.year(date).cast("string"), F.when(F.month(date) <= 6, "0101").otherwise("0701")
        )
        unit = F.substring("o_orderpriority", 1, 1)
        tens = (F.floor("o_totalprice") % 10) * 10
        return self.table("orders").select(
            F.col("o_orderkey").cast("string").alias("primaryid"),
            F.concat_ws("-", F.col("o_custkey"), F.year(date)).alias("caseid"),
            (F.col("o_orderkey") % 5 + 1).cast("string").alias("caseversion"),
            F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(half_year).alias("event_dt"),
            F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(tens.cast("string")).alias("age"),
            F.when(unit == "1", "YR")
            .when(unit == "2", "MON")
            .when(unit == "3", "WK")
            .when(unit == "4", "DY")
            .otherwise("")
            .alias("age_cod"),
            F.when(F.col("o_orderstatus") == "F", "F")
            .when(F.col("o_orderstatus") == "O", "m ")
            .otherwise("U")
            .alias("sex"),
            F.concat(F.year(date), F.lit("Q"), F.quarter(date)).alias("report_quarter"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").cast("string").alias("primaryid"),
            F.col("l_orderkey").cast("string").alias("caseid"),
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
            "l_returnflag",
        )

    @cached_property
    def drug(self) -> DataFrame:
        spelled = (
            F.when(F.col("p_size") % 3 == 0, F.col("p_name"))
            .when(F.col("p_size") % 3 == 1, F.concat(F.lit("  "), F.upper("p_name"), F.lit(".")))
            .otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit(", ")))
        )
        parts = self.table("part").select(F.col("p_partkey").alias("l_partkey"), spelled.alias("drugname"))
        role = (
            F.when(F.col("l_linenumber") <= 2, "PS").when(F.col("l_linenumber") <= 4, "SS").otherwise("C")
        )
        return self.lines.join(parts, "l_partkey").select(
            "primaryid",
            "caseid",
            F.col("l_linenumber").cast("string").alias("drug_seq"),
            role.alias("role_cod"),
            "drugname",
        )

    @cached_property
    def reac(self) -> DataFrame:
        spelled = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(
            F.concat(F.lit(" "), F.lower("s_name"), F.lit("  "))
        )
        suppliers = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), spelled.alias("pt"))
        return self.lines.join(suppliers, "l_suppkey").select("primaryid", "caseid", "pt", "l_linenumber")

    @cached_property
    def outc(self) -> DataFrame:
        code = (
            F.when(F.col("l_returnflag") == "A", "DE")
            .when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") > 3), "ho ")
            .when(F.col("l_returnflag") == "R", "")
            .otherwise("ZZ")
        )
        return self.lines.filter("l_linenumber <= 4 or l_returnflag = 'R'").select(
            "primaryid", "caseid", code.alias("outc_cod")
        )

    @cached_property
    def deleted(self) -> DataFrame:
        """Case ids of customers in debt, in the year of their orders."""
        debtors = self.table("customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
        return (
            self.table("orders")
            .join(debtors, "o_custkey", "left_semi")
            .select(F.concat_ws("-", F.col("o_custkey"), F.year("o_orderdate")).alias("caseid"))
            .distinct()
        )

    # --- derived tables ------------------------------------------------------

    @cached_property
    def typed(self) -> DataFrame:
        return case_ops.type_demo(self.demo, F.col("report_quarter"))

    @cached_property
    def cases(self) -> DataFrame:
        """Latest versions; fields are parsed after the selection."""
        return case_ops.type_demo(
            case_ops.latest_case_versions(self.demo), F.col("report_quarter")
        )

    @cached_property
    def pairs(self) -> DataFrame:
        return pair_universe(self.drug, self.reac, self.cases)

    @cached_property
    def dated_pairs(self) -> DataFrame:
        return self.pairs.join(self.cases.select("primaryid", "report_quarter"), "primaryid")

    @cached_property
    def pair_counts(self) -> DataFrame:
        """Reports per pair, written once: the statistics read it several times."""
        return self.stored(pair_counts(self.pairs), "pair-counts")

    @cached_property
    def metrics(self) -> DataFrame:
        return disproportionality(self.pair_counts)

    @cached_property
    def candidates(self) -> DataFrame:
        return detect_signals(self.metrics, None)

    @cached_property
    def reports(self) -> DataFrame:
        return reports_of_tables(self.drug, self.reac, self.cases, self.outc)

    # --- stored tables (written once per instance) -----------------------------

    @cached_property
    def stored_cases(self) -> DataFrame:
        return self.stored(self.cases, "cases")

    @cached_property
    def stored_drugs(self) -> DataFrame:
        """Analysed drugs of every report, read by pairs and reports alike."""
        named = suspect_drugs(self.drug, self.stored_cases).select("primaryid", "caseid", "drug_name")
        return self.stored(named, "suspect-drugs").withColumn("raw_drug_name", F.lit(None).cast("string"))

    @cached_property
    def stored_events(self) -> DataFrame:
        """Events of every report, read by pairs and reports alike."""
        named = report_events(self.reac, self.stored_cases).select("primaryid", "caseid", "event_name")
        return self.stored(named, "reported-events").withColumn("raw_reaction", F.lit(None).cast("string"))

    @cached_property
    def stored_pairs(self) -> DataFrame:
        pairs = pairs_of_sides(self.stored_drugs, self.stored_events)
        return self.stored(pairs.select("primaryid", "drug_name", "event_name"), "pairs")

    @cached_property
    def stored_reports(self) -> DataFrame:
        return self.stored(reports_of_sides(self.stored_drugs, self.stored_events, self.stored_cases, self.outc), "reports")

    @cached_property
    def report_events(self) -> DataFrame:
        """Reports laid out by pair: the one table that the statistics, support and duplicates are read from."""
        pairs = pairs_of_sides(self.stored_drugs, self.stored_events)
        return write_report_events(report_event_rows(pairs, self.stored_cases), scratch_path(self.spark, "report-events"))

    @cached_property
    def name_index(self) -> DataFrame:
        path = scratch_path(self.spark, "name-index")
        write_name_index(report_names(self.report_events), path)
        return self.spark.read.parquet(path)

    @cached_property
    def support_counts(self) -> DataFrame:
        """Support of every pair by quarter, written once for all scopes."""
        return self.stored(event_counts_by_quarter(self.report_events), "support-counts")

    @cached_property
    def stored_metrics(self) -> DataFrame:
        counts = self.support_counts.groupBy("drug_name", F.col("event_key").alias("event_name")).agg(F.sum("n").alias("a"))
        return self.stored(disproportionality(self.stored(counts, "pair-counts")), "metrics")

    @cached_property
    def signals(self) -> DataFrame:
        """Scored signals, written once.

        A signal with an even number of reports is tied to its newest quarter; the
        review status also follows the number of reports.
        """
        found = detect_signals(self.stored_metrics, None)
        trend = trend_series(found, self.reports, scope="all", counts=self.support_counts)
        inputs = self.stored_metrics.select("signal_id", "chi_square", "prr_lower", "ror_lower")
        newest = F.try_element_at("trend_data", F.lit(-1))["quarter"]
        release = F.when(F.col("supporting_report_count") % 2 == 0, newest)
        fifth = F.col("supporting_report_count") % 5
        status = (
            F.when(fifth == 0, "closed").when(fifth == 1, "under_review").otherwise("candidate")
        )
        scored = enrich_signals(found, inputs.join(trend, "signal_id"))
        dated = (
            scored.drop("dataset_version")
            .join(trend, "signal_id")
            .withColumn("dataset_version", release)
            .withColumn("candidate_status", status)
            .select(*found.columns)
        )
        return self.stored(dated, "signals")

    # --- report files of one release, written once per instance -------------------

    QUARTER = "2026Q1"

    def layout(self, kind: str) -> DataFrame:
        """A raw table in its full file layout, rows in file order."""
        frame = {"DEMO": self.demo, "DRUG": self.drug, "REAC": self.reac, "OUTC": self.outc}[kind]
        order = {
            "DEMO": ["primaryid"],
            "DRUG": ["primaryid", "drug_seq", "drugname"],
            "REAC": ["primaryid", "l_linenumber", "pt"],
            "OUTC": ["primaryid", "outc_cod"],
        }[kind]
        cells = [F.col(c) if c in frame.columns else F.lit("").alias(c) for c in RAW[kind].names]
        return frame.orderBy(*order).select(*cells)

    def write_lines(self, kind: str, path: str, ragged: Column | None = None, only: Column | None = None) -> None:
        """Report file ``path`` as a folder of parts, each with the header line.

        Rows for which ``ragged`` holds are cut after two fields. ``only`` picks rows.
        """
        rows = self.layout(kind)
        rows = rows if only is None else rows.filter(only)
        names = RAW[kind].names
        line = F.concat_ws(FIELD_SEPARATOR, *names)
        if ragged is not None:
            line = F.when(ragged, F.concat_ws(FIELD_SEPARATOR, *names[:2])).otherwise(line)
        rows.select(line.alias(FIELD_SEPARATOR.join(names))).write.options(**RAW_LINES).csv(path)

    @cached_property
    def quarter_folder(self) -> str:
        """Folder with all four report files of the release."""
        folder = scratch_path(self.spark, "quarter")
        for kind in RAW:
            self.write_lines(kind, table_path(folder, kind, self.QUARTER))
        return folder
