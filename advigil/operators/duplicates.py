"""Potential duplicate reports of a signal.

Reports of a signal that agree on age, sex and event date form a block. Agreement is
transitive, so that stored tables list a block as its first report against every other one, with the
block size: n - 1 rows that stand for all n(n-1)/2 candidates. ``duplicate_groups`` lists
the members of every block. Every count of such rows comes from block sizes: their output and
work are linear in the reports, whatever the size of a block. ``candidate_pairs`` has all n(n-1)/2 of
them, for results that show candidates by their ids; a large block is met in tiles of reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from advigil import fixed_values as V
from advigil.functions.identifiers import duplicate_id
from advigil.functions.numbers import short_number
from advigil.functions.text import fill_template, strip
from advigil.operators.support import block_sex
from advigil.schemas import DUPLICATE
from advigil.session import stored
from advigil.sinks.tables import read_table

BLOCK = ["signal_id", "age", "sex", "date"]
# Reports of a block that meet each other in one task.
TILE = 512


def is_complete() -> Column:
    """Has a report all the fields that duplicates agree on?"""
    return F.col("patient_age").isNotNull() & (F.coalesce("patient_sex", F.lit("")) != "") & (F.coalesce("event_date", F.lit("")) != "")


def event_candidates(signals: DataFrame, events: DataFrame) -> DataFrame:
    """``generated_candidates`` from the report-event table.

    Its layout brings the reports of a block together: their number and the first one are taken from sorted
    runs, and no report is shuffled. Names have to be spelled as in the table.
    """
    key = ["drug_name", "event_name", "block", "age", "sex", "date", "_release"]
    keys = signals.select("signal_id", "drug_name", "event_name", F.nullif("dataset_version", F.lit("")).alias("_release"))
    rows = events.filter(is_complete()).select(
        *key[:3], F.col("patient_age").cast("double").alias("age"), block_sex(F.col("patient_sex")).alias("sex"), strip("event_date").alias("date"), "report_quarter", "report_id"
    )
    scoped = rows.join(keys, ["drug_name", "event_name"]).filter(F.col("_release").isNull() | (F.col("_release") == F.col("report_quarter")))
    run = W.partitionBy(*key[:3], "signal_id", "age", "sex", "date")
    sized = scoped.withColumns({"block_size": F.count(F.lit(1)).over(run), "report_id_a": F.min("report_id").over(run)})
    pairs = sized.filter(F.col("report_id") != F.col("report_id_a")).select(*BLOCK, "report_id_a", "block_size", F.col("report_id").alias("report_id_b"), "drug_name", "event_name")
    return _candidate_columns(pairs)


def block_members(signals: DataFrame, reports: DataFrame) -> DataFrame:
    """Distinct (signal, age, sex, date, report) with complete identifying fields.

    Drug names match ignoring case, the event exactly, the quarter if the signal has
    a release.
    """
    complete = reports.filter(is_complete()).select(
        F.upper("drug_name").alias("_drug"),
        F.explode(F.array_distinct("reactions")).alias("event_name"),
        "report_quarter",
        "report_id",
        F.col("patient_age").cast("double").alias("age"),
        block_sex(F.col("patient_sex")).alias("sex"),
        strip("event_date").alias("date"),
    )
    keys = signals.select(
        "signal_id",
        F.upper("drug_name").alias("_drug"),
        "event_name",
        F.nullif("dataset_version", F.lit("")).alias("_release"),
    )
    scoped = complete.join(keys, ["_drug", "event_name"]).filter(
        F.col("_release").isNull() | (F.col("_release") == F.col("report_quarter"))
    )
    return scoped.select(*BLOCK, "report_id").distinct()


def blocks(members: DataFrame) -> DataFrame:
    """Blocks of two or more reports with size and first report."""
    return (
        members.groupBy(*BLOCK)
        .agg(F.count(F.lit(1)).alias("block_size"), F.min("report_id").alias("first_report"))
        .filter("block_size > 1")
    )


def sized_members(members: DataFrame) -> DataFrame:
    """Members of blocks with block size and first report.

    The members are written once: both the sizes and the rows are read from there.
    """
    once = stored(members, "block-members")
    return once.join(blocks(once), BLOCK)


def duplicate_groups(signals: DataFrame, reports: DataFrame) -> DataFrame:
    """Every report of every block with the block size."""
    return sized_members(block_members(signals, reports)).select(*BLOCK, "report_id", "block_size")


def duplicate_counts(signals: DataFrame, reports: DataFrame) -> DataFrame:
    """Exact number of candidates per signal, from block sizes alone."""
    n = F.col("block_size")
    return (
        blocks(block_members(signals, reports))
        .groupBy("signal_id")
        .agg(F.sum((n * (n - 1) / 2).cast("bigint")).alias("duplicate_count"))
    )


def candidate_pairs(members: DataFrame) -> DataFrame:
    """(block, report_id_a, block_size, report_id_b): every two reports of a block, the lesser id first; the size is null, as a row is one candidate.

    The reports of a block are dealt over sections of about a tile; two sections, or one with itself, meet at a time.
    """
    sections = F.ceil(F.col("block_size") / TILE).cast("int")
    sized = sized_members(members).withColumn("sections", sections).withColumn("section", F.pmod(F.xxhash64("report_id"), "sections").cast("int"))
    left = sized.select(*BLOCK, "report_id", F.col("section").alias("i"), F.explode(F.sequence("section", F.col("sections") - 1)).alias("j"))
    right = sized.select(*BLOCK, F.col("report_id").alias("other"), F.explode(F.sequence(F.lit(0), "section")).alias("i"), F.col("section").alias("j"))
    return left.join(right, [*BLOCK, "i", "j"]).filter("i < j OR report_id < other").select(
        *BLOCK,
        F.least("report_id", "other").alias("report_id_a"),
        F.lit(None).cast("bigint").alias("block_size"),
        F.greatest("report_id", "other").alias("report_id_b"),
    )


def listed_pairs(members: DataFrame) -> DataFrame:
    """(block, report_id_a, block_size, report_id_b): the first report of a block and every other."""
    return sized_members(members).filter(F.col("report_id") != F.col("first_report")).select(
        *BLOCK,
        F.col("first_report").alias("report_id_a"),
        "block_size",
        F.col("report_id").alias("report_id_b"),
    )


def _rationale() -> Column:
    return fill_template(
        V.DUPLICATE_RATIONALE,
        a=F.col("report_id_a"),
        b=F.col("report_id_b"),
        drug=F.col("drug_name"),
        event=F.col("event_name"),
        age=short_number(F.col("age")),
        sex=F.col("sex"),
        date=F.col("date"),
    )


def _candidate_rows(pairs: DataFrame, signals: DataFrame) -> DataFrame:
    """Stored form of pairs."""
    return _candidate_columns(pairs.join(signals.select("signal_id", "drug_name", "event_name"), "signal_id"))


def _candidate_columns(named: DataFrame) -> DataFrame:
    one = F.lit(1.0)
    return named.select(
        duplicate_id(F.col("signal_id"), F.col("report_id_a"), F.col("report_id_b")).alias("candidate_id"),
        "signal_id",
        "report_id_a",
        "report_id_b",
        _rationale().alias("rationale"),
        one.alias("similarity_score"),
        one.alias("drug_similarity"),
        one.alias("event_similarity"),
        F.lit(0).alias("date_proximity_days"),
        F.array(*[F.lit(x) for x in V.DUPLICATE_MATCHED_FIELDS]).alias("matched_fields"),
        F.lit(V.DUPLICATE_STATUS).alias("status"),
        "block_size",
    )


def generated_candidates(signals: DataFrame, reports: DataFrame, whole: bool = False) -> DataFrame:
    """Candidate rows computed from the reports: listed ones, or all if ``whole``."""
    pairs = candidate_pairs if whole else listed_pairs
    return _candidate_rows(pairs(block_members(signals, reports)), signals)


def duplicate_candidates(
    signals: DataFrame, reports: DataFrame, known: DataFrame | None = None, events: DataFrame | None = None
) -> DataFrame:
    """Stored candidates where a signal has any, generated ones otherwise; from the report-event table if given."""

    def generated(wanted: DataFrame) -> DataFrame:
        return generated_candidates(wanted, reports) if events is None else event_candidates(wanted, events)

    if known is None:
        return generated(signals)
    open_signals = signals.join(known.select("signal_id"), "signal_id", "left_anti")
    kept = known.join(signals.select("signal_id"), "signal_id", "left_semi")
    return kept.withColumn("block_size", F.lit(None).cast("bigint")).unionByName(generated(open_signals))


def added_candidates(signals: DataFrame, reports: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates that the stored ones lack; together they are what a later run reads.

    A block that has stored candidates keeps the first report they are listed against, so that a report that joins
    it later adds one row, whatever its id. Blocks without any are listed as ever.
    """
    members = stored(block_members(signals, reports), "block-members")
    first = F.col("report_id_a").alias("anchor")
    listed = known.select("signal_id", first, F.explode(F.array("report_id_a", "report_id_b")).alias("report_id"))
    stood = listed.groupBy("signal_id", "report_id").agg(F.min("anchor").alias("anchor"))
    marked = stored(members.join(stood, ["signal_id", "report_id"], "left"), "marked-members")
    anchors = marked.filter("anchor IS NOT NULL").groupBy(*BLOCK).agg(F.min("anchor").alias("first_report"))
    joined = marked.filter("anchor IS NULL").drop("anchor").join(anchors, BLOCK)
    sizes = blocks(members).select(*BLOCK, "block_size")
    late = joined.join(sizes, BLOCK).select(
        *BLOCK,
        F.least("first_report", "report_id").alias("report_id_a"),
        "block_size",
        F.greatest("first_report", "report_id").alias("report_id_b"),
    )
    fresh = members.join(anchors, BLOCK, "left_anti")
    rows = _candidate_rows(late.unionByName(listed_pairs(fresh)), signals)
    return rows.join(known.select("candidate_id"), "candidate_id", "left_anti").select(*rows.columns)


def store_candidates(spark: SparkSession, path: str, signals: DataFrame, reports: DataFrame, refresh: bool = False) -> int:
    """Append candidates to the table at ``path``; returns how many were added.

    Only signals without stored candidates are computed; with ``refresh`` all are, and what new reports
    add to their blocks is appended. Nothing is written if there is nothing to add, and a run repeated
    after a failure adds what the failed one did not.
    """
    known = read_table(spark, path, DUPLICATE)
    wanted = signals if refresh else signals.join(known.select("signal_id"), "signal_id", "left_anti")
    added = stored(added_candidates(wanted, reports, known).select(*DUPLICATE.names), "added-candidates")
    count = added.count()
    if count:
        added.write.mode("append").parquet(path)
    return count


def first_candidates(candidates: DataFrame, k: int = 3) -> DataFrame:
    """The first k candidates by id of every signal (pruned before the shuffle)."""
    w = W.partitionBy("signal_id").orderBy("candidate_id")
    return candidates.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def candidate_summary(candidates: DataFrame, k: int = 3) -> DataFrame:
    """Per signal: number of candidates and the first k listed ones.

    The n - 1 rows of a block count n / 2 each; a row without block size is one candidate.
    """
    counts = candidates.groupBy("signal_id").agg((F.sum(F.coalesce("block_size", F.lit(2))) / 2).cast("bigint").alias("duplicate_count"))
    fields = [
        "candidate_id",
        "report_id_a",
        "report_id_b",
        "status",
        "similarity_score",
        "matched_fields",
        "date_proximity_days",
        "rationale",
    ]
    sample = (
        first_candidates(candidates, k)
        .groupBy("signal_id")
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("duplicates"))
    )
    return counts.join(sample, "signal_id")
