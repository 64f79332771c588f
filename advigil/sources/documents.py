"""Document files: checks, text and preview. Rejects carry a status, they do not fail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advigil import fixed_values as V


def check_documents(files: DataFrame, max_bytes: int = V.MAX_DOCUMENT_BYTES) -> DataFrame:
    """Type, status, text and preview for rows of (path, length, content).

    The text of a document is its whole content; only the preview is short. Documents above
    ``max_bytes`` are flagged by ``over_size`` and treated like all others.
    """
    name = F.element_at(F.split("path", "/"), -1)
    has_dot = F.position(F.lit("."), name) > 0
    extension = F.when(has_dot, F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")
    content = F.col("content")
    pdf_ok = F.hex(F.substring(content, 1, 5)) == "255044462D"
    docx_ok = F.hex(F.substring(content, 1, 4)) == "504B0304"
    # Two hex digits per byte: a NUL byte is a pair of zeros at an even offset.
    binary = F.hex(content).rlike("^(?:[0-9A-F]{2})*?00")
    as_text = content.cast("string")
    decoded = F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(content, "ISO-8859-1"))
    status = (
        F.when(~extension.isin(*V.DOCUMENT_EXTENSIONS), "unsupported_format")
        .when((extension == "pdf") & ~pdf_ok, "corrupted")
        .when((extension == "docx") & ~docx_ok, "corrupted")
        .when((extension == "txt") & binary, "corrupted")
        .otherwise("accepted")
    )
    keep = [c for c in files.columns if c not in ("path", "length", "content")]
    checked = files.select(
        *keep,
        name.alias("filename"),
        extension.alias("file_type"),
        F.col("length").alias("file_size_bytes"),
        status.alias("status"),
        (F.col("length") > max_bytes).alias("over_size"),
        F.regexp_replace(decoded, r"(?U)^\s+|\s+$", "").alias("_text"),
    )
    has_text = (F.col("status") == "accepted") & (F.col("file_type") == "txt")
    return checked.withColumn("extracted_text", F.when(has_text, F.col("_text"))).withColumn(
        "extracted_text_preview", F.substring("extracted_text", 1, V.PREVIEW_LENGTH)
    ).drop("_text")


def scan_documents_binary(
    spark: SparkSession, path: str, max_bytes: int = V.MAX_DOCUMENT_BYTES
) -> DataFrame:
    """Document files below a folder, whatever their size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return check_documents(files.select("path", "length", "content"), max_bytes)
