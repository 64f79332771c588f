"""Substring search in drug and event names without reading the reports.

The index lists every distinct name under the runs of one to three characters it holds, per quarter and
kind of name, sorted by run: a search reads the runs of its text only. Names that hold all of
them are candidates; the text is looked for in these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advigil.sinks.tables import replace_partitions

RUN = 3
DRUG, EVENT = "drug", "event"


def runs_of(name: Column) -> Column:
    """Distinct runs of one to three characters of the upper-case name."""
    text = F.upper(name)

    def of_length(n: Column) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(text, i, n))

    return F.array_distinct(F.flatten(F.transform(F.array(*[F.lit(n) for n in range(1, RUN + 1)]), of_length)))


def report_names(events: DataFrame) -> DataFrame:
    """(quarter, kind, name) of the distinct drug and event names of report-event rows."""
    kinds = [(DRUG, "drug_name"), (EVENT, "event_name")]
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in kinds])).alias("it")
    return events.select(F.col("report_quarter").alias("quarter"), both).select("quarter", "it.*").filter("name IS NOT NULL").distinct()


def write_name_index(names: DataFrame, path: str) -> None:
    """Replace the quarters of ``names`` in the index. A run that very many names hold is spread over files."""
    listed = names.select("quarter", "kind", F.explode(runs_of(F.col("name"))).alias("run"), "name")
    ordered = listed.repartitionByRange("quarter", "kind", "run", "name").sortWithinPartitions("quarter", "kind", "run", "name")
    replace_partitions(ordered, path, "quarter")


def _wanted(text: str) -> str:
    return text.strip().upper()


def search_names(index: DataFrame, text: str, kind: str = DRUG, quarter: str | None = None) -> DataFrame:
    """Distinct names (name) of one kind that hold the text in any case; all names for an empty text."""
    wanted = _wanted(text)
    rows = index.filter(F.col("kind") == kind)
    if quarter is not None:
        rows = rows.filter(F.col("quarter") == quarter)
    if len(wanted) <= RUN:
        return (rows.filter(F.col("run") == wanted) if wanted else rows).select("name").distinct()
    runs = sorted({wanted[i : i + RUN] for i in range(len(wanted) - RUN + 1)})
    hits = rows.filter(F.col("run").isin(runs)).groupBy("name").agg(F.count_distinct("run").alias("n"))
    return hits.filter((F.col("n") == len(runs)) & F.upper("name").contains(wanted)).select("name")


def with_names_like(rows: DataFrame, index: DataFrame, column: str, text: str, kind: str = DRUG) -> DataFrame:
    """Rows whose name in ``column`` holds the text. The names found meet the rows; texts are not compared again."""
    return rows.join(search_names(index, text, kind).withColumnRenamed("name", column), column, "left_semi").select(*rows.columns)


def indexed_drug_search(signals: DataFrame, index: DataFrame, text: str) -> DataFrame:
    """``support.drug_search`` by the index: drugs with their number of signals, or, if no signal matches, drugs
    of reports with 0."""
    names = search_names(index, text).withColumnRenamed("name", "drug_name")
    counted = signals.join(names, "drug_name", "left_semi").groupBy("drug_name").agg(F.count("signal_id").alias("candidate_signals_count"))
    any_signal = counted.agg(F.count(F.lit(1)).alias("n")).scalar()
    others = names.filter(any_signal == 0).withColumn("candidate_signals_count", F.lit(0).cast("bigint"))
    return counted.unionByName(others).orderBy(F.desc("candidate_signals_count"), "drug_name")
