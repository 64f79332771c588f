"""Ingest of quarters as they arrive, as a file stream of marker files.

A quarter is a folder ``<landing>/<quarter>/`` with its report files. When the files
are complete a marker ``<landing>/ready/<anything>.ready`` with the quarter as its
text is added. The stream's checkpoint remembers which markers were handled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from advigil.plans.table_jobs import Store, ingest_quarter, is_imported
from advigil.functions.text import strip


def arrived_quarters(spark: SparkSession, markers: str, pattern: str = "*.ready") -> DataFrame:
    """Stream of quarter labels out of marker files."""
    return (
        spark.readStream.option("pathGlobFilter", pattern)
        .text(markers)
        .select(F.upper(strip("value")).alias("quarter"))
        .filter("quarter <> ''")
    )


def ingest_arrivals(
    spark: SparkSession,
    landing: str,
    store: Store,
    checkpoint: str,
    version: str = "v1.0.0",
    markers: str | None = None,
    pattern: str = "*.ready",
) -> StreamingQuery:
    """Handle every marker that is there now, then stop.

    A batch holds one label per new marker. A quarter that is already complete is
    passed over, so a batch repeated after a failure has no second effect.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        labels = sorted(row.quarter for row in batch.distinct().collect())
        for quarter in labels:
            if not is_imported(spark, store, quarter):
                ingest_quarter(spark, f"{landing.rstrip('/')}/{quarter}", quarter, store, version)

    return (
        arrived_quarters(spark, markers or f"{landing.rstrip('/')}/ready", pattern)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
