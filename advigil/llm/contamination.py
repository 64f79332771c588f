"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching.

Benchmark items are worked on in blocks of bounded size, each shipped to the tasks that read
the documents, so that documents are never shuffled. In a document all windows of ``SEED``
words are hashed by a rolling polynomial and looked up among the block's windows. For every
item with a shared window, the longest common run of words that covers no marked word is
marked again and again, until no run of ``SEED`` words is left. The share of the item's words
that is marked tells how much of the test a document holds, in whatever order its passages stand.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advigil.llm.words import by_document, rolling, word_hashes

SEED = 5
COVERAGE = 0.6
# Characters of benchmark text per block: what a task holds of the benchmark at once.
BLOCK_CHARS = 4_000_000


def tiles(text: np.ndarray, test: np.ndarray, starts: list[tuple[int, int]], seed: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (text position, test position, words), longest first, then leftmost.

    ``starts`` are the (text, test) positions with an equal window of ``seed`` words. Runs are
    read along diagonals; words of a mark never belong to a later one.
    """
    pairs = np.array(sorted(starts, key=lambda p: (p[0] - p[1], p[0])), np.int64).reshape(-1, 2)
    # A hash that fits is confirmed word by word.
    for i in range(seed):
        pairs = pairs[text[pairs[:, 0] + i] == test[pairs[:, 1] + i]]
    found = []
    while len(pairs):
        breaks = np.flatnonzero((np.diff(pairs[:, 0]) != 1) | (np.diff(pairs[:, 1]) != 1)) + 1
        first = np.append(0, breaks)
        length = np.diff(np.append(first, len(pairs))) + seed - 1
        at = min(np.flatnonzero(length == length.max()), key=lambda k: tuple(pairs[first[k]]))
        i, j, n = int(pairs[first[at], 0]), int(pairs[first[at], 1]), int(length[at])
        found.append((i, j, n))
        free = ((pairs[:, 0] + seed <= i) | (pairs[:, 0] >= i + n)) & ((pairs[:, 1] + seed <= j) | (pairs[:, 1] >= j + n))
        pairs = pairs[free]
    return found


class Block:
    """Window index of some benchmark items."""

    def __init__(self, items: list[tuple[int | None, str | None]], seed: int = SEED):
        self.seed = seed
        self.ids = [i for i, _ in items]
        self.words = [word_hashes(t) for _, t in items]
        windows = [rolling(w, seed) for w in self.words]
        hashes = np.concatenate([*windows, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(items)), [len(w) for w in windows])
        place = np.concatenate([*(np.arange(len(w)) for w in windows), np.zeros(0, np.int64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order], place[order]

    def matches(self, text: str | None) -> Iterator[tuple[int | None, int, int, list[tuple[int, int, int]]]]:
        """(item_id, covered words, words, tiles) of every item with a shared window."""
        words = word_hashes(text)
        windows = rolling(words, self.seed)
        low, high = np.searchsorted(self.hashes, windows, "left"), np.searchsorted(self.hashes, windows, "right")
        shared: dict[int, list[tuple[int, int]]] = {}
        for i in np.flatnonzero(high > low):
            for k in range(low[i], high[i]):
                shared.setdefault(int(self.item[k]), []).append((int(i), int(self.place[k])))
        for item, starts in sorted(shared.items()):
            found = tiles(words, self.words[item], starts, self.seed)
            yield self.ids[item], sum(n for _, _, n in found), len(self.words[item]), found


def benchmark_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """Benchmark items in blocks of about ``block_chars``; an item is never split."""
    total = benchmark.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(total / block_chars))
    keyed = benchmark.where("text IS NOT NULL").select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"))
    for k in range(blocks):
        yield sorted(((r["item_id"], r["text"]) for r in keyed.where(F.col("block") == k).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, covered, item_words, coverage, tiles) for pairs at or above ``coverage``.

    ``tiles`` lists document word:item word:words. Items of fewer than five words match nothing,
    null and empty texts neither; equal items and repeated rows are reported one by one.
    """
    items_type = benchmark.schema["item_id"].dataType
    fields = "item_id string, covered int, item_words int, coverage double, tiles string"

    def per_block(block: Block) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [
                    (doc_id, None if item is None else str(item), covered, size, covered / size, ",".join(f"{i}:{j}:{n}" for i, j, n in found))
                    for doc_id, text in zip(batch["doc_id"], batch["text"])
                    for item, covered, size, found in block.matches(text)
                    if covered >= coverage * size
                ]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "covered", "item_words", "coverage", "tiles"])

        return run

    out = None
    for items in benchmark_blocks(benchmark):
        part = by_document(docs, per_block(Block(items)), fields)
        out = part if out is None else out.union(part)
    return out.withColumn("item_id", F.col("item_id").cast(items_type))


def without_contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that cover no benchmark item to ``coverage`` or more; all columns are kept."""

    def flag(block: Block):
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: not any(covered >= coverage * size for _, covered, size, _ in block.matches(t))).astype(bool)

        return F.pandas_udf(run, "boolean")

    out = docs
    for items in benchmark_blocks(benchmark):
        out = out.where(flag(Block(items))("text"))
    return out
