"""Run records: quality ledger, manifest and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advigil import __version__
from advigil.sources.faers import path_exists

DIGEST_PARTS = 4


def ledger_rows(stage: str, stats: DataFrame, reasons: dict[str, str] | None = None) -> DataFrame:
    """(stage, reason, count, detail) rows out of a one-row frame of counts.

    ``reasons`` maps a count column to its reason; the whole row is the detail.
    """
    numeric = [f.name for f in stats.schema.fields if f.dataType.simpleString() in ("bigint", "int")]
    reasons = reasons or {c: c for c in numeric}
    entries = F.array(
        *[
            F.struct(F.lit(reason).alias("reason"), F.col(c).cast("bigint").alias("count"))
            for c, reason in reasons.items()
        ]
    )
    return stats.select(
        F.explode(entries).alias("e"), F.to_json(F.struct(*stats.columns)).alias("detail")
    ).select(F.lit(stage).alias("stage"), "e.reason", "e.count", "detail")


def quality_ledger(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ledger_total(ledger: DataFrame) -> DataFrame:
    """Sum of all counts, and the sum without the rows that only report loads."""
    informative = F.col("reason").isin("loaded", "loaded_rows", "demo_rows")
    return ledger.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_exclusions"),
        F.coalesce(F.sum(F.when(~informative, F.col("count"))), F.lit(0)).alias("total_rejected"),
    )


def file_fingerprints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, kind, digest) of every input file that exists.

    The digest is the number of lines and four sums of 60 bits each of the lines' SHA-256, so
    that every split of a file adds its part and equal lines count each time they occur.
    """
    found = [p for p in paths if path_exists(spark, p)]
    lines = spark.read.text(found).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), F.sha2("value", 256).alias("h")
    )
    numbers = lines.select("path", "length", *(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("bigint").alias(f"p{i}") for i in range(DIGEST_PARTS)))
    # Sums of halves stay within a long for eight billion lines; decimals of every line would take most of the time.
    halves = [(F.shiftright(f"p{i}", 30), F.col(f"p{i}").bitwiseAND(F.lit((1 << 30) - 1))) for i in range(DIGEST_PARTS)]
    sums = numbers.groupBy("path", "length").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(part).cast("decimal(38,0)").alias(f"{name}{i}") for i, both in enumerate(halves) for name, part in zip(("high", "low"), both, strict=True))
    )
    whole = ((F.col(f"high{i}").cast("decimal(25,0)") * F.lit(1 << 30).cast("decimal(12,0)") + F.col(f"low{i}")).cast("string") for i in range(DIGEST_PARTS))
    digest = F.concat_ws(":", F.col("n").cast("string"), *whole)
    return sums.select("path", "length", F.lit("lines+sha256").alias("kind"), digest.alias("digest"))


def manifest_files(spark: SparkSession, paths: dict[tuple[str, str], str], load_stats: DataFrame) -> DataFrame:
    """A row per part of every input file: kind, quarter, path, length and digest, with the load statistics of the file.

    ``paths`` maps (kind, quarter) to a path. Files without load statistics, such as a deletion list, have nulls there.
    """
    prints = None
    for (kind, quarter), path in paths.items():
        if path_exists(spark, path):
            part = file_fingerprints(spark, [path]).withColumnRenamed("kind", "digest_kind")
            part = part.withColumns({"kind": F.lit(kind), "quarter": F.lit(quarter)})
            prints = part if prints is None else prints.unionByName(part)
    return prints.join(load_stats, ["kind", "quarter"], "left")


def run_manifest(quarter: str, policy, counts: DataFrame, files: DataFrame) -> DataFrame:
    """One row: policy, counts, totals of the ``manifest_files``, version and time.

    Files and load statistics are rows of their own table, however many parts a file has.
    """
    per_kind = files.groupBy("kind", "quarter").agg(F.count(F.lit(1)).alias("parts"), F.sum("length").alias("length"), F.first("loaded_rows").alias("loaded"), F.first("rejected_rows").alias("rejected"))
    totals = per_kind.agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("parts").alias("parts"),
        F.sum("length").alias("length"),
        F.sum("loaded").alias("loaded_rows"),
        F.sum("rejected").alias("rejected_rows"),
    )
    settings = F.struct(
        F.lit("latest").alias("case_version_policy"),
        F.array(*[F.lit(r) for r in sorted(policy.roles)]).alias("analysis_drug_roles"),
        F.lit(policy.exclude_deleted_cases).alias("exclude_deleted_cases"),
        F.lit(policy.min_reports).alias("min_supporting_reports"),
        F.lit(policy.min_prr).alias("min_prr"),
        F.lit(policy.min_chi_square).alias("min_chi_square"),
        F.lit(policy.cell_correction).alias("cell_correction"),
    )
    return counts.select(
        F.lit(quarter).alias("quarter"),
        F.lit(__version__).alias("code_version"),
        totals.select(F.struct(*totals.columns)).scalar().alias("inputs"),
        settings.alias("config"),
        F.struct(*counts.columns).alias("counts"),
        F.lit("completed").alias("outcome"),
        F.current_timestamp().alias("generated_at_utc"),
    )


def reconciliation(**stages: DataFrame) -> DataFrame:
    """(stage, rows) for every named frame, in one plan."""
    out = None
    for stage, frame in stages.items():
        row = frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(stage).alias("stage"), "rows")
        out = row if out is None else out.unionByName(row)
    return out
