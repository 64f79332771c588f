"""Readers of the ``$``-separated quarterly report files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advigil.fixed_values import FIELD_SEPARATOR
from advigil.functions.text import strip
from advigil.schemas import RAW, REQUIRED_TABLES
from advigil.sources.split_text import cells_of, quoted_records

BAD_ROW, POS = "_bad", "_pos"
_ADDED = f"{POS}:struct<file:string,start:bigint,row:bigint>,{BAD_ROW}:string"
_SEPARATOR = rf"\{FIELD_SEPARATOR}"


class MissingFileError(Exception):
    """A required report file is absent."""


class EmptyFileError(Exception):
    """A report file has no header."""


class HeaderError(Exception):
    """A header differs from the fixed layout."""


def file_name(kind: str, quarter: str) -> str:
    """``DEMO26Q1.txt`` for ("DEMO", "2026Q1")."""
    return f"{kind.upper()}{quarter[2:4]}Q{quarter[-1]}.txt"


def table_path(folder: str, kind: str, quarter: str) -> str:
    return f"{folder.rstrip('/')}/{file_name(kind, quarter)}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something to read; any other trouble with the path is raised."""
    try:
        spark.read.text(path)
        return True
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def _header_error(found: str, kind: str, path: str) -> None:
    names = found.rstrip("\r").split(FIELD_SEPARATOR)
    expected = RAW[kind].names
    if names != expected:
        missing = [c for c in expected if c not in names]
        extra = [c for c in names if c not in expected]
        raise HeaderError(f"{path}: missing={missing} extra={extra} found={names}")


def validate_header(spark: SparkSession, path: str, kind: str) -> None:
    """Compare the first line with the layout; missing, extra or moved columns fail.

    Readers check the first line of every part file besides.
    """
    if not path_exists(spark, path):
        raise MissingFileError(f"missing report file {path}")
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise EmptyFileError(f"report file {path} is empty")
    _header_error(first[0].value, kind, path)


def read_table_rows(spark: SparkSession, path: str | list[str], kind: str) -> DataFrame:
    """All records of the fixed layout, ``_pos`` (file, split, row) and ``_bad``.

    ``_bad`` is the text of a record with a wrong number of cells and null for all others; of a record that
    is longer than its cells may be it is ``''``. Blank lines are bad records. Quoted cells may hold
    separators and line breaks, wherever the file is split. ``_pos`` orders records as in the file.
    """
    names = RAW[kind].names
    records = quoted_records(spark, path, _SEPARATOR, len(names))
    header = FIELD_SEPARATOR.join(names)
    wrong = F.raise_error(F.concat(F.lit(f"header of {kind} differs in "), F.col("file"))).cast("boolean")
    data = records.where(F.when(F.col("head") & (F.col("value") != header), wrong).otherwise(~F.col("head")))
    # The partition id keeps the cells where they are made: filters on them do not make them again.
    once = F.when(F.spark_partition_id() >= 0, cells_of(F.col("value"), _SEPARATOR, FIELD_SEPARATOR))
    cells = data.withColumn("_cells", once)
    good = F.coalesce(F.size("_cells") == len(names), F.lit(False))
    return cells.select(
        *[F.when(good, F.get("_cells", i)).alias(c) for i, c in enumerate(names)],
        F.struct("file", "start", "row").alias(POS),
        F.when(~good, F.coalesce("value", F.lit(""))).alias(BAD_ROW),
    )


def _no_keys() -> Column:
    ids = [F.coalesce(strip(c), F.lit("")) for c in ("primaryid", "caseid")]
    return (ids[0] == "") | (ids[1] == "")


def _fail(name: str) -> Column:
    return F.raise_error(F.lit(f"{name} has rows without primaryid or caseid")).cast("boolean")


def good_rows(rows: DataFrame, name: str = "table", keep_bad: bool = False) -> DataFrame:
    """Rows with the right number of fields; empty cells are ``''``.

    The job fails at the first such row without a report or case id. The check is
    part of the row filter, so it holds whichever columns are read. ``keep_bad`` checks
    the good rows but keeps the bad ones beside them.
    """
    is_bad = F.when(F.col(BAD_ROW).isNotNull(), F.lit(keep_bad))
    # The partition id keeps the check where it stands: lines within a record are no rows.
    here = F.spark_partition_id() >= 0
    kept = rows.filter(is_bad.when(_no_keys() & here, _fail(name)).otherwise(F.lit(True)))
    return kept if keep_bad else kept.drop(BAD_ROW)


def load_stats(rows: DataFrame, kind: str) -> DataFrame:
    """Scanned, loaded, skipped, accepted and rejected records of one file.

    ``rows`` are all records with ``_bad``, as read or as stored by a job.
    """
    bad = F.count_if(F.col(BAD_ROW).isNotNull()).alias("bad")
    counted = rows.agg(F.count(F.lit(1)).alias("rows"), bad)
    return counted.select(
        F.lit(kind).alias("kind"),
        F.col("rows").alias("scanned_data_lines"),
        (F.col("rows") - F.col("bad")).alias("loaded_rows"),
        F.col("bad").alias("skipped_bad_lines"),
        F.lit(0).cast("bigint").alias("malformed_rows_kept"),
        (F.col("rows") - F.col("bad")).alias("accepted_rows"),
        F.col("bad").alias("rejected_rows"),
    )


def validate_keys(table: DataFrame, name: str = "table") -> DataFrame:
    """The table itself, failing the job at the first row without ids.

    The check rides along with whatever reads the table; there is no extra pass.
    """
    return table.filter(F.when(_no_keys(), _fail(name)).otherwise(F.lit(True)))


def scan_faers_table(spark: SparkSession, path: str, kind: str, keep_bad: bool = False) -> DataFrame:
    """Good rows of one file with a checked header, checked ids and their position ``_pos``."""
    validate_header(spark, path, kind)
    return good_rows(read_table_rows(spark, path, kind), kind, keep_bad)


def scan_deleted_cases(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a deletion list, one id per line."""
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    return (
        spark.read.text(path).select(line.alias("caseid")).filter("caseid <> ''").distinct()
    )


def scan_quarter(
    spark: SparkSession, folder: str, quarter: str, deleted_path: str | None = None, keep_bad: bool = False
) -> dict[str, DataFrame]:
    """The tables of one quarter. Only the outcome table may be absent."""
    paths = {kind: table_path(folder, kind, quarter) for kind in RAW}
    missing = [paths[k] for k in REQUIRED_TABLES if not path_exists(spark, paths[k])]
    if missing:
        raise MissingFileError(f"missing report files {missing}")
    tables = {}
    for kind, path in paths.items():
        if kind in REQUIRED_TABLES or path_exists(spark, path):
            tables[kind] = scan_faers_table(spark, path, kind, keep_bad)
        else:
            tables[kind] = spark.createDataFrame([], f"{RAW[kind].simpleString()[7:-1]},{_ADDED}")
            tables[kind] = tables[kind] if keep_bad else tables[kind].drop(BAD_ROW)
    if deleted_path and path_exists(spark, deleted_path):
        tables["DELETED"] = scan_deleted_cases(spark, deleted_path)
    else:
        tables["DELETED"] = spark.createDataFrame([], "caseid string")
    return tables


def scan_quarters(
    spark: SparkSession, folder: str, quarters: list[str], deleted_path: str | None = None, keep_bad: bool = False
) -> dict[str, DataFrame]:
    """Several quarters of one folder with a ``report_quarter`` column; one deletion list holds for all."""
    out: dict[str, DataFrame] = {}
    for quarter in quarters:
        for kind, table in scan_quarter(spark, folder, quarter, deleted_path, keep_bad).items():
            if kind == "DELETED":
                out[kind] = table
                continue
            table = table.withColumn("report_quarter", F.lit(quarter))
            out[kind] = out[kind].unionByName(table) if kind in out else table
    return out


def in_natural_order(rows: DataFrame) -> DataFrame:
    """Rows sorted by report and case id, as in the file where these are equal."""
    return rows.orderBy("primaryid", "caseid", POS)


# --- lenient variant ---------------------------------------------------------


def quarter_members(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """Distinct members ``<prefix>*.txt`` below a folder, in any case.

    A member is a file, or a folder of part files of that name. Only names are
    listed, no bytes are read.
    """
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ).select("path")
    pattern = rf"(?i)^(.*/{prefix}[^/]*\.txt)(?:/.*)?$"
    member = F.regexp_extract("path", pattern, 1)
    return listed.select(member.alias("path")).filter("path <> ''").distinct()


def find_quarter_member(spark: SparkSession, folder: str, prefix: str, exact: str | None = None) -> str:
    """First matching member, or the one with the exact name in any case."""
    members = quarter_members(spark, folder, prefix)
    if exact:
        base = F.upper(F.element_at(F.split("path", "/"), -1))
        members = members.filter(base == exact.upper())
    first = members.orderBy("path").limit(1).collect()
    if not first:
        raise MissingFileError(f"no {exact or prefix + '*.txt'} in {folder}")
    return first[0].path


def file_encodings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, encoding): UTF-8 when every line of the file is valid, else Latin-1."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.expr("is_valid_utf8(value)").alias("ok")
    )
    return lines.groupBy("path").agg(
        F.when(F.bool_and("ok"), "UTF-8").otherwise("ISO-8859-1").alias("encoding")
    )


def _unquoted(spark: SparkSession, paths: str | list[str], encoding: str, files: list[str] | None = None) -> DataFrame:
    reader = (
        spark.read.option("sep", FIELD_SEPARATOR)
        .option("header", True)
        .option("quote", "")
        .option("encoding", encoding)
    )
    # The first file names the columns; one with other columns fails the read.
    raw = reader.schema(reader.csv(paths).schema).option("enforceSchema", False).csv(paths)
    names = [F.col(f"`{c}`").alias(c.strip().lower()) for c in raw.columns]
    place = [F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")]
    if files is None:
        return raw.select(*names, F.struct(F.col("_metadata.file_path").alias("file"), *place).alias(POS))
    # Positions are sorted and shuffled with every row: they hold the number of a file, not its path.
    rows = raw.select(*names, F.col("_metadata.file_path").alias("_path"), F.struct(*place).alias("_place"))
    numbers = spark.range(1).select(F.posexplode(F.array(*[F.lit(f) for f in files])).alias("_file", "_path"))
    position = F.struct(F.col("_file").alias("file"), "_place.start", "_place.row").alias(POS)
    return rows.join(numbers, "_path", "left").select(*[c.strip().lower() for c in raw.columns], position)


def scan_faers_unquoted(
    spark: SparkSession, path: str, encoding: str | None = None
) -> DataFrame:
    """Lenient read: no quoting, header names lower-cased and trimmed, access by name.

    Without a given encoding every file is read in its own: files are grouped by it, and the
    groups are united. Long rows are kept and short rows have nulls. ``_pos`` orders rows as in the
    file: number of the file in the order of paths, start of the split, then the running row id within the split.
    """
    if encoding is not None:
        return _unquoted(spark, path, encoding)
    # One row per file, as many as the driver lists anyway.
    found = sorted(file_encodings(spark, path).collect(), key=lambda r: r.path)
    files = [row.path for row in found]
    groups: dict[str, list[str]] = {}
    for row in found:
        groups.setdefault(row.encoding, []).append(row.path)
    if len(groups) <= 1:
        return _unquoted(spark, path, next(iter(groups), "UTF-8"), files or None)
    parts = [_unquoted(spark, paths, name, files) for name, paths in sorted(groups.items())]
    return parts[0].unionByName(parts[1])


def _lacking(needed: tuple[str, ...]) -> Column:
    lacking = F.lit(False)
    for c in needed:
        lacking = lacking | F.col(c).isNull()
    return lacking


def short_rows(rows: DataFrame, *needed: str) -> DataFrame:
    """Rows of a lenient read that end before one of the needed fields."""
    return rows.filter(_lacking(needed))


def lenient_load_stats(rows: DataFrame, kind: str, *needed: str) -> DataFrame:
    """Rows of a lenient read, and those of them that end before a needed field; both are kept."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(_lacking(needed)).alias("short_rows")).select(F.lit(kind).alias("kind"), "rows", "short_rows")
