"""Report files as a stream: raw rows by quarter and the newest version of every case.

The files lie in ``<landing>/<quarter>/``. Quarters may arrive in any order and in pieces. A case is
reported again in later quarters; its newest version replaces the earlier ones wherever these arrived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from advigil.fixed_values import FIELD_SEPARATOR
from advigil.operators.cases import zero_fill
from advigil.schemas import RAW
from advigil.session import stored
from advigil.sinks.tables import replace_partitions
from advigil.sources.faers import path_exists

# Newest cases are rewritten by hash buckets: an arrival touches those of its cases.
BUCKETS = 64


def arriving_rows(spark: SparkSession, landing: str, kind: str, files_at_once: int | None = None) -> DataFrame:
    """Stream of the rows of all ``<landing>/<quarter>/<kind>*`` files, with their quarter from the path.

    A file may be a folder of parts. Cells are read as they are, without quotes. Header lines and lines
    with a wrong number of cells are passed over.
    """
    reader = spark.readStream.option("recursiveFileLookup", True)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    names = RAW[kind].names
    lines = reader.text(f"{landing.rstrip('/')}/*/{kind}*").select("value", F.col("_metadata.file_path").alias("file"))
    cells = F.split(F.regexp_replace("value", r"\r$", ""), rf"\{FIELD_SEPARATOR}")
    # The pattern spans three names of the path at most; the others would only be searched in vain.
    quarter = F.upper(F.regexp_extract(F.substring_index("file", "/", -3), rf"([^/]+)/{kind}[^/]*(?:/[^/]*)?$", 1))
    # A generator makes the cells of a line once, where a plain column would be made again for each of its cells.
    rows = lines.select(F.explode(F.array(cells)).alias("c"), quarter.alias("report_quarter")).filter(F.size("c") == len(names))
    named = rows.select(*[F.get("c", i).alias(n) for i, n in enumerate(names)], "report_quarter")
    return named.filter(F.lower(F.trim(names[0])) != names[0])


def _newer() -> Column:
    return F.struct(zero_fill(F.col("caseversion"), 10), zero_fill(F.col("primaryid"), 20))


def newest_versions(demo: DataFrame) -> DataFrame:
    """The newest version of every case so far, held as the state of a streaming aggregation."""
    columns = [c for c in demo.columns if c != "caseid"]
    newest = F.max_by(F.struct(*columns), _newer()).alias("row")
    return demo.groupBy("caseid").agg(newest).select("caseid", *[F.col(f"row.{c}").alias(c) for c in columns])


def _merge(batch: DataFrame, path: str) -> None:
    """Put the newest versions of a batch in place of the stored ones. A repeated batch changes nothing."""
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64("caseid"), F.lit(BUCKETS)).cast("int").alias("bucket")
    placed = stored(batch.select("*", bucket), "newest-cases")
    if path_exists(spark, path):
        touched = placed.select("bucket").distinct()
        old = spark.read.schema(placed.schema).parquet(path).join(touched, "bucket", "left_semi")
        kept = old.join(placed.select("caseid"), "caseid", "left_anti").select(*placed.columns)
        placed = stored(kept.unionByName(placed), "merged-cases")
    # One file a bucket, not one for every task that has some of its rows.
    replace_partitions(placed.repartition("bucket"), path, "bucket")


def stream_report_files(
    spark: SparkSession, landing: str, tables: str, checkpoint: str, files_at_once: int | None = None
) -> list[StreamingQuery]:
    """Take what has arrived into ``<tables>/{drug,reac,outc,newest_cases}``, then stop; one stream per kind.

    Raw rows are appended once by the file sink. Cases go through the state of their newest version, so
    a version that arrives late, or was overtaken by a later quarter, never replaces a newer one.
    No quarter is looped over.
    """
    runs = []
    for kind in ("DRUG", "REAC", "OUTC"):
        sink = arriving_rows(spark, landing, kind, files_at_once).writeStream.format("parquet").partitionBy("report_quarter")
        sink = sink.option("path", f"{tables}/{kind.lower()}").option("checkpointLocation", f"{checkpoint}/{kind.lower()}")
        runs.append(sink.trigger(availableNow=True).start())
    cases = newest_versions(arriving_rows(spark, landing, "DEMO", files_at_once))
    sink = cases.writeStream.outputMode("update").foreachBatch(lambda batch, _: _merge(batch, f"{tables}/newest_cases"))
    runs.append(sink.option("checkpointLocation", f"{checkpoint}/demo").trigger(availableNow=True).start())
    return runs


def streamed_table(spark: SparkSession, tables: str, kind: str) -> DataFrame:
    """Raw rows of one kind, or the newest version of every case for ``DEMO``."""
    return spark.read.parquet(f"{tables}/{'newest_cases' if kind == 'DEMO' else kind.lower()}")
