"""Exact n-gram Jaccard join of documents with Bayesian pruning of MinHash candidates.

1. Texts with equal shingle sets form a *text class*; one text stands for its class.
2. Bands of MinHash values give the candidate buckets. Buckets with equal members are kept once.
3. A bucket is worked on in tiles of bounded size, so neither a task nor the driver ever
   holds a whole group, and pairs are counted inside the tile instead of emitted.
4. In a tile, MinHash values are compared step by step. A pair is dropped as soon as the
   posterior probability that its similarity reaches the threshold falls below ``tolerance``.
5. Every remaining pair is verified on its shingle sets.

A pair is worked on in the first bucket it shares, so each link counts once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from advigil.llm.graph import components, stored
from advigil.llm.words import SHINGLE_WORDS, mixed, shingles, with_fields

THRESHOLD = 0.8
TOLERANCE = 1e-6
# A pair at similarity 0.8 shares none of 40 bands of 6 values with probability 5e-6.
BANDS, ROWS = 40, 6
STEP = 24
TILE = 512
_LANES = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)
_FACTORS = (mixed(_LANES) | np.uint64(1)).astype(np.uint32)
_SHIFTS = (mixed(_LANES + np.uint64(1 << 40)) >> np.uint64(32)).astype(np.uint32)


def class_key(sets: np.ndarray) -> bytes | None:
    """128 bits that stand for a shingle set; null for the empty set."""
    if not len(sets):
        return None
    a = np.bitwise_xor.reduce(mixed(sets + np.uint64(len(sets))))
    return np.array([a, mixed(sets).sum(dtype=np.uint64)], ">u8").tobytes()


def signature(sets: np.ndarray) -> np.ndarray:
    """MinHash values of a set, 32 bits each."""
    high = (sets >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(_LANES), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(high), 1024):
        part = _FACTORS[:, None] * high[None, at : at + 1024] + _SHIFTS[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def band_keys(values: np.ndarray) -> np.ndarray:
    """One bucket key per band, never 0."""
    grouped = values.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, i])
    return np.where(key == 0, np.uint64(1), key)


def least_matches(threshold: float, tolerance: float, values: int = BANDS * ROWS, step: int = STEP) -> list[int]:
    """For n = step, 2 step, ...: the fewest matches of n values that keep a pair.

    With a uniform prior the similarity after m matches of n is Beta(m+1, n-m+1), so that
    P(similarity >= t) = P(Binomial(n+1, t) <= m).
    """
    out = []
    for n in range(step, values + 1, step):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _text_keys() -> list[Column]:
    """128 bits of a text, made without Python, by which it is found again."""
    return [F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2")]


def keyed_documents(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, k1, k2, class, bands) per document, stored; class and bands are null without words.

    This is the only step in which Python reads all texts.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch["text"]]
            bands = [band_keys(signature(s)).view(np.int64) if len(s) else None for s in sets]
            yield batch.drop(columns="text").assign(**{"class": [class_key(s) for s in sets], "bands": bands})

    given = docs.select(F.col("doc_id").cast("string"), *_text_keys(), "text")
    made = given.mapInPandas(rows, "doc_id string, k1 bigint, k2 bigint, class binary, bands array<bigint>")
    return stored(made.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)), "keyed")


def _members(classes: DataFrame) -> DataFrame:
    """(bucket, class, band, tiles) for buckets of two or more classes, one of those with equal members."""
    rows = classes.select("class", F.posexplode("bands").alias("band", "bucket"))
    sizes = (
        rows.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("sum"))
        .where("size > 1")
        .groupBy("size", "sum")
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    )
    return rows.join(sizes, "bucket")


def _payload(batches: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingles(t, words) for t in batch["text"]]
        buckets = [np.zeros(BANDS, np.int64) for _ in sets]
        for row, found in zip(buckets, batch["found"]):
            for x in found:
                row[x["band"]] = x["bucket"]
        yield pd.DataFrame(
            {
                "class": batch["class"],
                "found": batch["found"],
                "buckets": [row.tobytes() for row in buckets],
                "signature": [signature(s).astype(np.uint16).tobytes() for s in sets],
                "shingles": [s.tobytes() for s in sets],
            }
        )


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of equal keys from batches sorted by the keys."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        new = np.zeros(len(batch), bool)
        for k in keys:
            v = batch[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cuts = np.flatnonzero(new)
        start = 0
        for cut in cuts:
            yield batch.iloc[start:cut]
            start = cut
        held = batch.iloc[start:]
    if held is not None and len(held):
        yield held


class _Tile:
    """Links between the members of one tile of a bucket."""

    def __init__(self, frame: pd.DataFrame, threshold: float, least: list[int]):
        self.bucket, self.cross = frame["bucket"].iat[0], frame["a"].iat[0] != frame["b"].iat[0]
        self.side = frame["tile"].to_numpy() != frame["a"].iat[0]
        self.classes = frame["class"].tolist()
        self.buckets = np.frombuffer(b"".join(frame["buckets"]), np.int64).reshape(len(frame), -1)
        self.values = np.frombuffer(b"".join(frame["signature"]), np.uint16).reshape(len(frame), -1)
        sets = [np.frombuffer(x, np.uint64) for x in frame["shingles"]]
        self.sizes = np.array([len(s) for s in sets])
        known, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.flat, self.ends = flat, np.cumsum(self.sizes)
        self.mark = np.zeros(len(known), bool)
        self.threshold, self.least = threshold, least

    def partners(self, i: int) -> np.ndarray:
        """Later members that member i is linked to."""
        others = np.arange(i + 1, len(self.sizes))
        if self.cross:
            others = others[self.side[others] != self.side[i]]
        small, large = np.minimum(self.sizes[others], self.sizes[i]), np.maximum(self.sizes[others], self.sizes[i])
        others = others[small >= self.threshold * large]
        shared = (self.buckets[others] == self.buckets[i]) & (self.buckets[i] != 0)
        others = others[self.buckets[i][shared.argmax(axis=1)] == self.bucket]
        matches = np.zeros(len(others), np.int32)
        for step, least in enumerate(self.least):
            if not len(others):
                return others
            at = slice(step * STEP, step * STEP + STEP)
            matches = matches + (self.values[others, at] == self.values[i, at]).sum(axis=1, dtype=np.int32)
            keep = matches >= least
            others, matches = others[keep], matches[keep]
        if not len(others):
            return others
        own = self.flat[self.ends[i] - self.sizes[i] : self.ends[i]]
        self.mark[own] = True
        common = np.array([self.mark[self.flat[self.ends[j] - self.sizes[j] : self.ends[j]]].sum() for j in others])
        self.mark[own] = False
        # Whole numbers: intersection >= threshold * union.
        return others[common >= self.threshold * (self.sizes[i] + self.sizes[others] - common) - 1e-9]

    def links(self) -> tuple[np.ndarray, list[int]]:
        """Links per member, and a member that stands for its part of the tile."""
        count, up = np.zeros(len(self.sizes), np.int64), list(range(len(self.sizes)))

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for i in range(len(up)):
            found = self.partners(i)
            count[i] += len(found)
            count[found] += 1
            for j in found.tolist():
                up[top(j)] = top(i)
        return count, [top(i) for i in range(len(up))]


def _links(batches: Iterator[pd.DataFrame], threshold: float, least: list[int]) -> Iterator[pd.DataFrame]:
    rows: dict[str, list] = {"class": [], "links": [], "other": []}
    for frame in _runs(batches, ["bucket", "a", "b"]):
        tile = _Tile(frame, threshold, least)
        count, tops = tile.links()
        for i in np.flatnonzero(count):
            rows["class"].append(tile.classes[i])
            rows["links"].append(count[i])
            rows["other"].append(tile.classes[tops[i]])
        if len(rows["class"]) >= 10_000:
            yield pd.DataFrame(rows)
            rows = {k: [] for k in rows}
    yield pd.DataFrame(rows).astype({"links": "int64"})


def linked_classes(
    docs: DataFrame, keyed: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, words: int = SHINGLE_WORDS
) -> DataFrame:
    """(class, class_id, n_docs, n_links, group) per text class of ``keyed_documents``.

    ``class_id`` is the least doc_id of the class, ``n_links`` the number of other classes with
    a similarity of at least ``threshold``, ``group`` the class key that its connected group shares.
    """
    own_key = F.min(F.struct("k1", "k2")).alias("key")
    classes = (
        keyed.where("class IS NOT NULL")
        .groupBy("class")
        .agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_docs"), F.first("bands").alias("bands"), own_key)
    )
    members = stored(_members(classes), "members")
    # A class has one bucket per band at most.
    lists = members.groupBy("class").agg(F.collect_list(F.struct("band", "bucket", "tiles")).alias("found"))
    # One text stands for a class; its copies are dropped before they are shuffled a second time.
    wanted = lists.join(classes.select("class", "key.k1", "key.k2"), "class").drop("found")
    texts = docs.select(*_text_keys(), "text").join(wanted, ["k1", "k2"]).groupBy("class").agg(F.first("text").alias("text"))
    with_text = texts.join(lists, "class")
    schema = with_fields(with_text, ["class", "found"], "buckets binary, signature binary, shingles binary")
    tiles = (
        with_text.mapInPandas(lambda b: _payload(b, words), schema)
        .select("class", "buckets", "signature", "shingles", F.explode("found").alias("at"))
        .select("class", "buckets", "signature", "shingles", "at.bucket", "at.tiles")
        .withColumn("tile", F.pmod(F.xxhash64("class", "bucket"), "tiles").cast("int"))
        .withColumn("with", F.explode(F.expr("sequence(0, tiles - 1)")))
        .select("bucket", F.least("tile", "with").alias("a"), F.greatest("tile", "with").alias("b"), "tile", "class", "buckets", "signature", "shingles")
    )
    least = least_matches(threshold, tolerance)
    found = (
        tiles.repartition("bucket", "a", "b")
        .sortWithinPartitions("bucket", "a", "b")
        .mapInPandas(lambda b: _links(b, threshold, least), "class binary, links bigint, other binary")
    )
    found = stored(found, "links")
    counted = found.groupBy("class").agg(F.sum("links").alias("n_links"))
    groups = components(found.select(F.col("class").alias("u"), F.col("other").alias("v")))
    return (
        classes.select("class", "class_id", "n_docs")
        .join(counted, "class", "left")
        .join(groups.select(F.col("node").alias("class"), F.col("root").alias("group")), "class", "left")
        .select("class", "class_id", "n_docs", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group", "class").alias("group"))
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, group_size.

    ``class_id`` is the least doc_id of the document's connected group, ``n_links`` the number of
    other distinct texts whose 5-word shingle similarity to it reaches ``threshold``, and
    ``group_size`` the documents of the group, copies counted. Documents without words and
    repeated rows: the first have no class or links and a group size of 1, the others are copies.
    Null ids count as documents but never name a group.
    """
    keyed = keyed_documents(docs)
    linked = stored(linked_classes(docs, keyed, threshold, tolerance), "classes")
    groups = linked.groupBy("group").agg(F.min("class_id").alias("class_id"), F.sum("n_docs").alias("group_size"))
    found = linked.select("class", "n_links", "group").join(groups, "group").drop("group")
    return (
        keyed.select("doc_id", "class")
        .join(found, "class", "left")
        .select(
            "doc_id",
            F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("group_size", F.lit(1)).alias("group_size"),
        )
    )


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The documents of which no near duplicate with a smaller doc_id is kept: one row per group.

    Of the rows of the least doc_id of a group the one with the least text hash stays, of equal
    rows one. Documents without words stay. All columns are kept as they are.
    """
    keyed = keyed_documents(docs)
    linked = stored(linked_classes(docs, keyed, threshold, tolerance), "classes")
    grouped = linked.groupBy("group").agg(F.min("class_id").alias("least")).join(linked, "group")
    texts = keyed.where("class IS NOT NULL").select("k1", "k2", "class").distinct()
    chosen = stored(
        texts.join(grouped, "class").select(
            F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("group").alias("__group"), F.col("least").alias("__least")
        ),
        "chosen",
    )
    own = dict(zip(("__t1", "__t2"), _text_keys()))
    rows = docs.withColumns(own).join(chosen, (F.col("__t1") == F.col("__k1")) & (F.col("__t2") == F.col("__k2")), "left")
    alone = Window.partitionBy("__group").orderBy(F.col("doc_id").asc_nulls_last(), "__t1", "__t2")
    # Only rows of the chosen id meet in the window; each group ships one row per task.
    first = rows.where("__group IS NOT NULL AND doc_id <=> __least").withColumn("__n", F.row_number().over(alone)).where("__n = 1")
    return first.select(*docs.columns).union(rows.where("__group IS NULL").select(*docs.columns))
