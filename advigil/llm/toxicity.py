"""Toxicity: a counterfactually regularised linear classifier.

Features are the words of a text and their beginnings of three to six letters, hashed, each
with the logarithm of its rate. A labelled text with identity terms is also read with those
terms swapped for others of their category, and with the terms left out. The fit adds the
squared change of the score between a text and its counterfactuals to the loss, so that a mere
mention of a group carries no weight of its own.

The model is fitted on at most ``FIT_ROWS`` labelled texts; scoring reads whole texts, with no
join and no shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advigil.llm.quality import fit_rows, held_out
from advigil.llm.words import by_document

FIT_ROWS = 8_000
SPACE = 1 << 20
KEPT_FEATURES = 4_000
PENALTY = 4.0
TOXIC_FROM = 0.5
# Identity terms by category: a term is only swapped for another of its category.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "african", "latino", "european", "arab"),
    ("gay", "lesbian", "bisexual", "queer", "straight", "heterosexual"),
    ("immigrant", "refugee", "foreigner", "migrant", "native", "local"),
    ("immigrants", "refugees", "foreigners", "migrants", "natives", "locals"),
    ("disabled", "blind", "deaf", "old", "elderly", "young"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
_SWAPS = {term: terms[(i + 1) % len(terms)] for terms in IDENTITY_TERMS for i, term in enumerate(terms)}
_WORD = re.compile(r"[^\W\d_]+")


def _ids(word: str) -> list[int]:
    parts = {word} | {"^" + word[:n] for n in range(3, 7) if len(word) >= n}
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % SPACE for p in parts]


class Reader:
    """Texts to feature ids and values; ids of words met before are kept, within bounds.

    ``used`` marks the features of a fitted model; others need not be read for a score.
    """

    def __init__(self, used: np.ndarray | None = None, most_words: int = 200_000):
        self.known: dict[str, list[int]] = {}
        self.used, self.most = used, most_words

    def read(self, words: Counter, total: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and values; ``total`` is the length that rates refer to, that of ``words`` by default."""
        if len(self.known) > self.most:
            self.known.clear()
        ids: list[int] = []
        counts: list[int] = []
        for word, n in words.items():
            found = self.known.get(word)
            if found is None:
                found = _ids(word)
                if self.used is not None:
                    found = [i for i in found if self.used[i]]
                self.known[word] = found
            if found:
                ids += found
                counts += [n] * len(found)
        at, where = np.unique(np.array(ids, np.int64), return_inverse=True)
        total = sum(words.values()) if total is None else total
        return at, np.log1p(100.0 * np.bincount(where, counts, len(at)) / (total + 20.0))


def words_of(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def counterfactuals(words: Counter) -> list[Counter]:
    """The words with identity terms swapped, and without them; none if there are no terms."""
    if not any(w in _SWAPS for w in words):
        return []
    swapped: Counter = Counter()
    for w, n in words.items():
        swapped[_SWAPS.get(w, w)] += n
    return [swapped, Counter({w: n for w, n in words.items() if w not in _SWAPS})]


class Matrix:
    """Rows of sparse features with the products a gradient needs."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], columns: np.ndarray):
        place = np.full(SPACE, -1, np.int64)
        place[columns] = np.arange(len(columns))
        row, col, val = [], [], []
        for i, (ids, values) in enumerate(rows):
            at = place[np.asarray(ids, np.int64)]
            keep = at >= 0
            col.append(at[keep])
            val.append(np.asarray(values)[keep])
            row.append(np.full(int(keep.sum()), i))
        empty = [np.zeros(0)]
        self.row, self.col = (np.concatenate([*x, *empty]).astype(np.int64) for x in (row, col))
        self.val = np.concatenate([*val, *empty])
        self.shape = (len(rows), len(columns))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * weights[self.col], self.shape[0])

    def transposed(self, slopes: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * slopes[self.row], self.shape[1])


class LinearModel:
    """Logistic regression on the telling features, with counterfactual pairs held together."""

    def __init__(self, rows, labels, pairs, penalty: float = PENALTY, steps: int = 400, rate: float = 0.1, decay: float = 1e-4):
        """rows: (ids, values) per text; pairs: (row number, ids, values) per counterfactual."""
        y = np.asarray(labels, float)
        columns = self._telling(rows, y)
        x = Matrix(rows, columns)
        changed = Matrix([(i, v) for _, i, v in pairs], columns)
        source = np.array([r for r, _, _ in pairs], np.int64)
        weights, bias = np.zeros(len(columns)), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        first, second = np.zeros(len(columns) + 1), np.zeros(len(columns) + 1)
        # Both labels weigh the same, as toxic texts are few.
        share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        for step in range(1, steps + 1):
            z = x.times(weights)
            slope = share * (1 / (1 + np.exp(-(z + bias))) - y)
            gradient = x.transposed(slope) + decay * weights
            if len(pairs) and penalty:
                change = (z[source] - changed.times(weights)) * (2 * penalty / len(pairs))
                gradient += x.transposed(np.bincount(source, change, len(y))) - changed.transposed(change)
            both = np.append(gradient, slope.sum())
            first = 0.9 * first + 0.1 * both
            second = 0.999 * second + 0.001 * both**2
            move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            weights, bias = weights - move[:-1], bias - move[-1]
        self.weights = np.zeros(SPACE, np.float32)
        self.weights[columns] = weights
        self.bias = bias

    @staticmethod
    def _telling(rows, y: np.ndarray) -> np.ndarray:
        """Features whose share of texts differs most between the labels."""
        with_it = [np.zeros(SPACE), np.zeros(SPACE)]
        for (ids, _), label in zip(rows, y):
            with_it[int(label)][np.asarray(ids, np.int64)] += 1
        n0, n1 = max(1, (y == 0).sum()), max(1, (y == 1).sum())
        p0, p1 = with_it[0] / n0, with_it[1] / n1
        mean = (with_it[0] + with_it[1]) / (n0 + n1)
        with np.errstate(divide="ignore", invalid="ignore"):
            z = np.abs(p1 - p0) / np.sqrt(mean * (1 - mean) * (1 / n0 + 1 / n1))
        z = np.where((with_it[0] + with_it[1] >= 3) & np.isfinite(z), z, 0)
        best = np.argsort(-z, kind="stable")[:KEPT_FEATURES]
        return best[z[best] > 0]

    def score(self, ids: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + (self.weights[ids] * values).sum(), -500, 500))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, penalty: float = PENALTY) -> LinearModel:
    """Fit on hashed features that the executors make of the chosen texts and counterfactuals."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for batch in batches:
            out = []
            for y, text in zip(batch["y"], batch["text"]):
                words = words_of(text)
                # Rates of all other words stay as they are, also where terms are left out.
                own, *others = [reader.read(w, sum(words.values())) for w in (words, *counterfactuals(words))]
                pack = lambda f: (f[0].astype(np.int32).tobytes(), f[1].astype(np.float32).tobytes())
                out.append((y, *pack(own), [dict(zip(("ids", "values"), pack(o))) for o in others]))
            yield pd.DataFrame(out, columns=["y", "ids", "values", "others"])

    schema = "y int, ids binary, values binary, others array<struct<ids: binary, values: binary>>"
    found = fit_rows(docs, labels, "toxic", most).select("text", "y").mapInPandas(rows, schema)
    local = found.orderBy(F.xxhash64("ids", "values", "y")).limit(most).toPandas()
    unpack = lambda i, v: (np.frombuffer(i, np.int32), np.frombuffer(v, np.float32))
    texts = [unpack(i, v) for i, v in zip(local["ids"], local["values"])]
    pairs = [(k, *unpack(o["ids"], o["values"])) for k, others in enumerate(local["others"]) for o in others]
    return LinearModel(texts or [unpack(b"", b"")], local["y"].tolist() or [0.0], pairs, penalty)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score in [0, 1], predicted (1 from 0.5 on).

    Null and empty texts score as a text without features; null ids are not held out.
    """
    model = fit_toxicity(docs, labels)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model.weights != 0)
        for batch in batches:
            scores = [model.score(*reader.read(words_of(t))) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": scores})

    scored = by_document(docs, rows, "score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
