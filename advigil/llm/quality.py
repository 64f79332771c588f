"""Quality classifier: a generalised additive model with pairwise interactions.

Shape features of a text (shares of letters, symbols, capitals, repeated words ...) are put
into quantile bins. Shallow trees are boosted in turn over one feature after the other, then
over the strongest pairs of features, each on the residuals of all before it, so that every
feature and pair ends up with a small lookup table. A score is the sum of table entries.

The model is fitted on at most ``FIT_ROWS`` labelled rows, the ones with the least hash of
their id; everything else reads whole tables. Scoring has no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advigil.llm.words import by_document

FIT_ROWS = 12_000
BINS, ROUNDS, PAIRS, PAIR_BINS, RATE = 32, 60, 6, 8, 0.15
REJECT_BELOW = 0.3
FEATURES = (
    "words", "chars_per_word", "long_words", "letters", "capitals", "digits", "symbols",
    "marked_words", "bars", "bangs", "stops_per_word", "words_per_line", "lines",
    "repeated_words", "repeated_lines", "short_lines", "unended_lines",
)
_SPACE, _UPPER, _LOWER, _DIGIT, _STOP, _OTHER = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
for _b in range(256):
    _c = chr(_b)
    if _b >= 128 or _c.islower():
        _KIND[_b] = _LOWER
    elif _c.isspace():
        _KIND[_b] = _SPACE
    elif _c.isupper():
        _KIND[_b] = _UPPER
    elif _c.isdigit():
        _KIND[_b] = _DIGIT
    elif _c in ".,;:":
        _KIND[_b] = _STOP


def features(text: str | None) -> np.ndarray:
    """Shape of a whole text; zeros for null and for texts without words."""
    out = np.zeros(len(FEATURES))
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return out
    kind = _KIND[data]
    edges = np.diff((kind != _SPACE).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    n = len(starts)
    if not n:
        return out
    count = np.bincount(kind, minlength=6)
    size = ends - starts
    solid = max(1, len(data) - count[_SPACE])
    lines = [line for line in text.split("\n") if line.strip()]
    words = text.split()
    other = kind == _OTHER
    out[:] = (
        n,
        size.mean(),
        (size > 12).mean(),
        (count[_LOWER] + count[_UPPER]) / solid,
        count[_UPPER] / solid,
        count[_DIGIT] / solid,
        count[_OTHER] / solid,
        other[ends - 1].mean(),
        np.count_nonzero(data == ord("|")) / n,
        np.count_nonzero(data == ord("!")) / n,
        count[_STOP] / n,
        n / len(lines),
        len(lines),
        1 - len(set(words)) / n,
        1 - len(set(lines)) / len(lines),
        sum(len(x) < 30 for x in lines) / len(lines),
        sum(not x.rstrip().endswith((".", "!", "?", '"')) for x in lines) / len(lines),
    )
    return out


def feature_rows(texts: pd.Series) -> np.ndarray:
    return np.stack([features(t) for t in texts]) if len(texts) else np.zeros((0, len(FEATURES)))


def _best_cut(gradient: np.ndarray, weight: np.ndarray, axis: int = 0) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram along an axis of bins."""
    g, w = np.cumsum(gradient, axis=axis), np.cumsum(weight, axis=axis)
    total_g, total_w = g[-1], w[-1]
    left_g, left_w = g[:-1], w[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_g**2 / (left_w + 1) + (total_g - left_g) ** 2 / (total_w - left_w + 1) - total_g**2 / (total_w + 1)
    return (float(gain.max()), int(gain.argmax())) if len(gain) else (0.0, 0)


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Step per bin of a tree with up to ``leaves`` leaves over one feature."""
    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        cuts = [(_best_cut(gradient[a:b], weight[a:b]), a, b) for a, b in parts if b - a > 1]
        if not cuts or max(c[0][0] for c in cuts) <= 1e-9:
            break
        (_, at), a, b = max(cuts, key=lambda c: c[0][0])
        parts = [p for p in parts if p != (a, b)] + [(a, a + at + 1), (a + at + 1, b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + 1)
    return out


def _pair_tree(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step per cell of the best tree with one cut of each feature."""
    g, w = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    a_g, a_w = g[:-1, :-1], w[:-1, :-1]
    b_g, b_w = g[:-1, -1:] - a_g, w[:-1, -1:] - a_w
    c_g, c_w = g[-1:, :-1] - a_g, w[-1:, :-1] - a_w
    d_g, d_w = g[-1, -1] - a_g - b_g - c_g, w[-1, -1] - a_w - b_w - c_w
    gain = sum(x**2 / (y + 1) for x, y in ((a_g, a_w), (b_g, b_w), (c_g, c_w), (d_g, d_w)))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros_like(gradient)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = gradient[rows, cols].sum() / (weight[rows, cols].sum() + 1)
    return float(gain.max()), out


class AdditiveModel:
    """Lookup tables per feature and per pair of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed_pairs: int = PAIRS):
        k = x.shape[1]
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(k)]
        self.coarse = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for f in range(k)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        mean = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(mean / (1 - mean)))
        fine, broad = self._bins(x, self.cuts), self._bins(x, self.coarse)
        total = np.full(len(y), self.base)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-total))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for f in range(k):
                g, h = slopes()
                size = len(self.tables[f])
                step = RATE * _tree(np.bincount(fine[f], g, size), np.bincount(fine[f], h, size))
                self.tables[f] += step
                total += step[fine[f]]

        def grid(f: int, o: int) -> tuple[np.ndarray, np.ndarray]:
            g, h = slopes()
            shape = (len(self.coarse[f]) + 1, len(self.coarse[o]) + 1)
            cell = broad[f] * shape[1] + broad[o]
            return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

        open_pairs = [p for p in combinations(range(k), 2) if len(self.coarse[p[0]]) and len(self.coarse[p[1]])]
        self.pairs = sorted(open_pairs, key=lambda p: -_pair_tree(*grid(*p))[0])[:seed_pairs]
        self.pair_tables = [np.zeros((len(self.coarse[f]) + 1, len(self.coarse[o]) + 1)) for f, o in self.pairs]
        for _ in range(ROUNDS):
            for table, (f, o) in zip(self.pair_tables, self.pairs):
                step = RATE * _pair_tree(*grid(f, o))[1]
                table += step
                total += step[broad[f], broad[o]]

    @staticmethod
    def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        fine, broad = self._bins(x, self.cuts), self._bins(x, self.coarse)
        total = np.full(len(x), self.base)
        for table, at in zip(self.tables, fine):
            total += table[at]
        for table, (f, o) in zip(self.pair_tables, self.pairs):
            total += table[broad[f], broad[o]]
        return 1 / (1 + np.exp(-total))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept away from learning: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, y) of at most ``most`` labelled rows that are not held out, least hash of the id first.

    Labels are chosen before any text is read, so that the documents are joined to a table of
    proven size. An id with several labels counts as its larger one.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    return docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> AdditiveModel:
    """Fit on features that the executors make of the chosen texts. Without labels the score is 0.5."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "x": list(feature_rows(batch["text"]))})

    found = fit_rows(docs, labels, "quality", most).select("text", "y").mapInPandas(rows, "y int, x array<double>")
    # Repeated ids may bring more rows than labels; the bound holds for what reaches the driver.
    local = found.orderBy(F.xxhash64("x", "y")).limit(most).toPandas()
    x = np.stack(local["x"]) if len(local) else np.zeros((1, len(FEATURES)))
    y = local["y"].to_numpy(float) if len(local) else np.array([0.5])
    return AdditiveModel(x, y)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score in [0, 1], predicted (1 from 0.3 on).

    Null and empty texts have the features of no words; null ids are not held out.
    """
    model = fit_quality(docs, labels)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": model.score(feature_rows(batch["text"]))})

    scored = by_document(docs, rows, "score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= REJECT_BELOW).cast("int").alias("predicted"))


def quality_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score 0.3 or more; all columns are kept."""
    model = fit_quality(docs, labels)

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(feature_rows(texts)))

    return docs.where(F.pandas_udf(score, "double")("text") >= REJECT_BELOW)
