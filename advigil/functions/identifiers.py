"""Stable hashed identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from advigil import fixed_values as V


def _short_hash(text: Column, length: int) -> Column:
    return F.upper(F.substring(F.sha2(text, 256), 1, length))


def signal_id(drug: Column, event: Column) -> Column:
    key = F.concat(drug, F.lit(V.SIGNAL_ID_SEPARATOR), event)
    return F.concat(F.lit(V.SIGNAL_ID_PREFIX), _short_hash(key, V.SIGNAL_ID_HEX_LENGTH))


def duplicate_id(signal: Column, report_a: Column, report_b: Column) -> Column:
    key = F.concat_ws("|", signal, report_a, report_b)
    return F.concat(F.lit(V.DUPLICATE_ID_PREFIX), _short_hash(key, V.DUPLICATE_ID_HEX_LENGTH))


def facts_hash(facts: Column) -> Column:
    """SHA-256 over the JSON text of a struct, nulls kept."""
    return F.sha2(F.to_json(facts, {"ignoreNullFields": "false"}), 256)
