"""Name normalisation and small text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from advigil.fixed_values import (
    EDGE_PUNCTUATION_PATTERN,
    PLAIN_TEXT_EXCEPTION_PATTERN,
    WHITESPACE,
    WHITESPACE_PATTERN,
)


def null_if_blank(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def strip(text: Column | str) -> Column:
    """White space of any script cut off at both ends."""
    return F.trim(text, F.lit(WHITESPACE))


def squeeze(text: Column) -> Column:
    """Upper case, runs of white space as one blank, no blank at the edges.

    Printable ASCII with single blanks, nearly every name, needs no replacement; a
    cheap pattern finds the rest.
    """
    upper = F.upper(text)
    unusual = upper.rlike(PLAIN_TEXT_EXCEPTION_PATTERN)
    return F.trim(F.when(unusual, F.regexp_replace(upper, WHITESPACE_PATTERN, " ")).otherwise(upper))


def normalize_reaction(text: Column) -> Column:
    return null_if_blank(squeeze(text))


def normalize_drug_name(text: Column) -> Column:
    return null_if_blank(F.regexp_replace(squeeze(text), EDGE_PUNCTUATION_PATTERN, ""))


def has_no_drug_name(text: Column) -> Column:
    """Whether ``normalize_drug_name`` is null: no letter or digit is left once the edges are cut off."""
    return ~F.coalesce(F.upper(text).rlike("[A-Za-z0-9]"), F.lit(False))


def trimmed_upper(text: Column) -> Column:
    return F.upper(strip(text))


def fill_template(template: str, **parts: Column) -> Column:
    """``"{a} and {b}"`` as one ``concat`` over columns."""
    pieces: list[Column] = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            pieces.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        pieces.append(parts[name].cast("string"))
    return F.concat(*pieces)


def json_or_none_text(column: Column) -> Column:
    """Text of a value; a null prints as ``None``."""
    return F.coalesce(column.cast("string"), F.lit("None"))


def quoted_list(items: Column) -> Column:
    """``['a', 'b']`` for an array of texts."""
    return F.when(F.size(items) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))
    )


def join_with_and(items: Column) -> Column:
    """``a``, ``a, and b`` or ``a, b, and c``; underscores become blanks."""
    words = F.transform(items, lambda x: F.replace(x, F.lit("_"), F.lit(" ")))
    last = F.element_at(words, -1)
    head = F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), ", ")
    return (
        F.when(F.size(F.coalesce(items, F.array())) == 0, F.lit("--"))
        .when(F.size(items) == 1, F.try_element_at(words, F.lit(1)))
        .otherwise(F.concat(head, F.lit(", and "), last))
    )


def source_label(source: Column) -> Column:
    return F.replace(source, F.lit("_"), F.lit(" "))


def parse_reactions_cell(cell: Column) -> Column:
    """JSON list or ``|`` joined text as distinct upper-case terms, first seen first."""
    raw = strip(F.coalesce(cell, F.lit("")))
    items = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(
        F.split(raw, r"\|")
    )
    terms = F.transform(F.coalesce(items, F.array()), lambda x: trimmed_upper(F.coalesce(x, F.lit(""))))
    return F.array_distinct(F.filter(terms, lambda x: x != ""))
