"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators count on. The forced skew join lets AQE split a hot report or drug even where that costs one more shuffle. Joins
# whose measured partitions are small hash instead of sorting.
SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
}

# Shuffles of reports start from many partitions, which are joined to the advised size: the memory of a task does not grow
# with the input where the session has a fixed number of partitions.
REPORT_DEFAULTS = SQL_DEFAULTS | {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "512",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8MB",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "advigil") -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Small local files would otherwise become one task per file.
        .config("spark.sql.files.openCostInBytes", str(256 * 1024))
    )
    for key, value in SQL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession, settings: dict[str, str] = SQL_DEFAULTS) -> SparkSession:
    """Bring an existing session to the settings the operators rely on."""
    for key, value in settings.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def working_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="advigil-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


# Intermediate tables of this process lie in one folder, so that they can be dropped together.
_RUN = uuid.uuid4().hex


def _run_folder(spark: SparkSession) -> str:
    return f"{working_folder(spark).rstrip('/')}/advigil/{_RUN}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written intermediate table."""
    return f"{_run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove all intermediate tables of this process. Results that are still to be read from them are lost."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


# Shuffle files of a write that has ended are of no use: nothing but its own plan reads them.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df, name: str, settings: dict[str, str] | None = None):
    """``df`` written to the shared folder and read again: columnar, its lineage ends there and its shuffle files go.

    ``settings`` hold while it is written.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    during = {_SHUFFLE_CLEANUP: "true"} | (settings or {})
    before = {key: spark.conf.get(key) for key in during}
    prepare(spark, during)
    try:
        df.write.parquet(path)
    finally:
        prepare(spark, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables) -> None:
    """Remove tables that ``stored`` has written and that nothing is to read any more."""
    for table in tables:
        spark = table.sparkSession
        for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if f"/advigil/{_RUN}/" in path:
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
