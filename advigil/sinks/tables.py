"""Idempotent changes to stored tables, as plans over old and new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from advigil.functions.numbers import finite
from advigil.session import scratch_path, stored
from advigil.sinks.records import valid_import_record
from advigil.sources.faers import path_exists


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stored table, or an empty frame of its schema before the first write."""
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def last_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of every key in the given order (pruned before the shuffle)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Table after insert-or-update: old rows without a new version, plus the new rows."""
    kept = existing.join(incoming.select(*keys), keys, "left_anti")
    return kept.select(*incoming.columns).unionByName(incoming)


def importable_signals(batch: DataFrame, order: str = "_pos") -> DataFrame:
    """Valid records of a batch, the last one of each id, numbers made finite.

    ``order`` is the position of a record in its batch.
    """
    valid = batch.filter(valid_import_record())
    numeric = [c for c in ("prr", "ror", "trend_score", "risk_score") if c in batch.columns]
    cleaned = valid.withColumns({c: finite(F.col(c)) for c in numeric}).withColumn(
        "supporting_report_count", F.coalesce("supporting_report_count", F.lit(0)).cast("bigint")
    )
    return last_per_key(cleaned, ["signal_id"], [F.desc(order)]).drop(order)


def import_counters(batch: DataFrame) -> DataFrame:
    """total, inserted_or_updated, skipped and errors of a batch; one row."""
    good = F.count_if(valid_import_record())
    total = F.count(F.lit(1))
    return batch.agg(
        total.alias("total"),
        good.alias("inserted_or_updated"),
        (total - good).alias("skipped"),
        (total - good).alias("errors"),
    )


def upsert_signals(existing: DataFrame, batch: DataFrame, order: str = "_pos") -> DataFrame:
    """Signal table after an import; stored limitations of a signal are kept."""
    incoming = importable_signals(batch, order)
    if "known_limitations" not in incoming.columns and "known_limitations" in existing.columns:
        old = existing.select("signal_id", "known_limitations")
        incoming = incoming.join(old, "signal_id", "left")
    return upsert(existing, incoming.select(*existing.columns), ["signal_id"])


def known_metrics(metrics: DataFrame, signals: DataFrame) -> DataFrame:
    """Metrics of known signals only."""
    return metrics.join(signals.select("signal_id"), "signal_id", "left_semi")


def metrics_rows(metrics: DataFrame, signals: DataFrame) -> DataFrame:
    """Stored metric rows of imported signals: ratios come from the signal record."""
    ratios = signals.select("signal_id", "prr", "ror")
    cells = F.struct(*[F.col(c).cast("bigint").alias(c) for c in "abcd"])
    return metrics.select("signal_id", *"abcd", "chi_square").join(ratios, "signal_id").select(
        "signal_id",
        F.coalesce(finite(F.col("prr")), F.lit(0.0)).alias("prr"),
        finite(F.col("ror")).alias("ror"),
        F.coalesce(F.col("a").cast("bigint"), F.lit(0)).alias("report_count"),
        cells.alias("contingency_table"),
        F.lit(None).cast("array<struct<quarter:string,count:double>>").alias("trend_data"),
        finite(F.col("chi_square")).alias("chi_square"),
    )


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Overwrite exactly the partitions that occur in the frame."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def rewrite_partitions(df: DataFrame, path: str, partition: str) -> None:
    """``replace_partitions`` for a frame that reads the same table.

    The new rows are first written to the shared folder, so no task reads a file that
    another one is replacing, and a lost executor can be recomputed.
    """
    spark = df.sparkSession
    staged = scratch_path(spark, "staged")
    df.write.parquet(staged)
    replace_partitions(spark.read.parquet(staged), path, partition)


def upsert_reports(spark: SparkSession, path: str, incoming: DataFrame, schema, order: str | None = None) -> None:
    """Insert or update report rows by (report, drug), also where the quarter has changed.

    The quarters that the rows come to and the ones that they had are rewritten, no others. Of
    rows with equal keys the last by ``order`` is taken, without it the largest row.
    """
    keys = ["report_id", "drug_name"]
    last = [F.desc(order)] if order else [F.desc(c) for c in incoming.columns if c not in keys]
    incoming = last_per_key(incoming, keys, last).select(*[f.name for f in schema.fields])
    if not path_exists(spark, path):
        replace_partitions(incoming, path, "report_quarter")
        return
    incoming = stored(incoming, "incoming-reports")
    existing = read_table(spark, path, schema)
    had = existing.join(incoming.select(*keys), keys, "left_semi").select("report_quarter")
    quarters = stored(had.union(incoming.select("report_quarter")).distinct(), "touched-quarters")
    merged = stored(upsert(existing.join(quarters, "report_quarter", "left_semi"), incoming, keys), "merged-reports")
    replace_partitions(merged, path, "report_quarter")
    left = merged.select("report_quarter").distinct()
    for row in quarters.join(left, "report_quarter", "left_anti").collect():
        drop_partition(spark, path, "report_quarter", row["report_quarter"])


def drop_partition(spark: SparkSession, path: str, column: str, value: str) -> None:
    """Remove the folder of a partition that has no rows any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={value}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def one_row_per_report(reports: DataFrame) -> DataFrame:
    """The row with the largest drug name of every report."""
    return last_per_key(reports, ["report_id"], [F.desc("drug_name")])


def replace_quarter_pairs(counts: DataFrame, path: str) -> None:
    """Replace the pair counts of the quarters in the frame; a rerun changes nothing."""
    replace_partitions(counts, path, "quarter")


def release_row(
    spark: SparkSession, quarter: str, total_reports: DataFrame, version: str = "v1.0.0"
) -> DataFrame:
    """Metadata of one release; ``total_reports`` has one row with column n."""
    return total_reports.select(
        F.lit(quarter).alias("release_id"),
        F.lit(quarter).alias("quarter"),
        F.lit(f"FDA FAERS {quarter}").alias("dataset_release"),
        F.current_date().alias("import_date"),
        F.lit(version).alias("processing_version"),
        F.col("n").alias("total_reports"),
        F.current_timestamp().alias("processed_at"),
    )


def release_of(releases: DataFrame, release_id: str) -> DataFrame:
    """The row of one release; none if it is unknown."""
    return releases.filter(F.col("release_id") == release_id)


def list_releases(releases: DataFrame) -> DataFrame:
    """Newest import first."""
    return releases.orderBy(F.desc("import_date"), F.desc("release_id"))
