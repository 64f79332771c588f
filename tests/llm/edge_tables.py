"""Small tables with nulls, empty and long texts, repeated rows, ties and clashing column names."""

from __future__ import annotations

EXTRA = "lang string, source string, n_chars bigint, size string, score string, rank string, class string, mix string, copy string, line_no string, block string"
SCHEMA = f"doc_id bigint, text string, {EXTRA}"
BODY = "the quick brown fox jumps over the lazy dog while seven small birds sing a quiet song near the old stone bridge"


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, None if text is None else len(text), "s", "s", "r", "c", "m", "x", "l", "b")


def edge_rows():
    long_text = " ".join(f"word{i % 997} thing{i}" for i in range(30_000))
    return [
        row(1, BODY),
        row(1, BODY),
        row(2, BODY),
        row(3, BODY + " today"),
        row(4, ""),
        row(5, None, None),
        row(None, BODY),
        row(None, None),
        row(6, long_text),
        row(7, "short"),
        row(8, "short"),
        row(9, "  \n\n \t", "b"),
        row(50, "a bird sang near the bridge\nthe quick brown fox jumps over the lazy dog"),
        row(100, "ünïcödé straße 東京 слово " * 5, "b"),
    ]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
