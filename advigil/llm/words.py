"""Words, word hashes and word shingles of a text as numpy arrays.

A word is a maximal run of letters and digits of the lower-cased text. Hashes are 64
bits wide and equal on every machine and in every run.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SHINGLE_WORDS = 5

_ODD = re.compile(r"[^\x00-\x7f\w]+")
# Bytes of ASCII letters, digits and of every character beyond ASCII belong to words.
_IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) <= n:
        size = 1 << int(n + 1).bit_length()
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def word_hashes(text: str | None) -> np.ndarray:
    """One hash per word, in order; none for null.

    Prefix sums of a polynomial over the bytes give the hash of every word at once.
    """
    low = (text or "").lower()
    if not low.isascii():
        low = _ODD.sub(" ", low)
    data = np.frombuffer(low.encode("utf-8", "surrogatepass"), np.uint8)
    edges = np.diff(_IN_WORD[data].astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def rolling(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hash of every window of ``words`` words, by its first word (Karp-Rabin polynomial)."""
    n = len(hashes) - words + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(words):
        out = out * np.uint64(_BASE) + hashes[i : i + n]
    return mixed(out)


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes. A shorter text is one shingle; no words give none."""
    hashes = word_hashes(text)
    if 0 < len(hashes) < words:
        return rolling(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(rolling(hashes, words))


def with_fields(df, names: list[str], more: str):
    """Schema of the named columns of ``df`` and of the fields in ``more`` (DDL)."""
    return StructType(df.select(*names).schema.fields + StructType.fromDDL(more).fields)


def by_document(docs, run, fields: str):
    """mapInPandas over (doc_id, text). Ids travel as text, as pandas has no whole numbers with nulls."""
    ids = docs.schema["doc_id"].dataType
    schema = StructType.fromDDL("doc_id string, " + fields)
    rows = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, schema)
    return rows.select(F.col("doc_id").cast(ids), *schema.names[1:])
