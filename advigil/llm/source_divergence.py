"""How far the sources of a language differ in their use of terms, exact in whole numbers.

Terms are runs of ASCII letters and of characters beyond ASCII; only A-Z are lower-cased. A
language keeps the terms that occur in at least ``least`` of its documents. They are found by
iceberg prefix refinement over bytes:

1. At a level of L bytes every document counts once for each term of fewer than L bytes and once
   for each prefix of L bytes of its other terms. Counts are combined in the task, then by key.
2. Prefixes in fewer than ``least`` documents are discarded; no term that starts with one can
   be kept. The prefixes that stay go to the tasks as a bitmap of bounded size. Two prefixes that
   share a bit only let one more prefix through, whose own count discards it a level later.
3. Texts are cut to the terms that go on, L doubles, and the next level starts, until no prefix
   stays. A term is complete at the first level beyond its length; its count is exact.
4. Uses of the kept terms are counted by source, packed by term.

Nulls in text, lang and source are ``''``. Every row is a document, repeated rows and ids as well.
Empty texts have no terms, but their (lang, source) counts as a group. Very long texts and terms
are whole; a term of n bytes takes about log2(n) levels. An empty table gives no rows. Other
columns of the table are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from advigil.llm.graph import stored

LEAST_DOCUMENTS = 10
FIRST_LEVEL = 8
TOP_TERMS = 10
# Counts of a task are handed on when so many are held: items of a language, terms of all sources.
HELD, HELD_USES = 400_000, 800_000
# The bitmap of prefixes that stay: sixteen bits each, within these bounds (8 MB at most).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
_BATCH = 50_000

# Letters as they are or lower-cased, bytes beyond ASCII as they are, all else apart.
_TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order, lower-cased."""
    return (text or b"").translate(_TERM_BYTES).split()


class Bitmap:
    """Which (lang, prefix) stay: never a wrong no."""

    def __init__(self, words: np.ndarray, values: np.ndarray, bits: int):
        self.mask = bits - 1
        self.words = np.zeros(bits // 64, np.int64)
        self.words[words] = values

    def __call__(self, lang: bytes, prefix: bytes) -> bool:
        slot = zlib.crc32(lang + b"\0" + prefix) & self.mask
        return bool((int(self.words[slot >> 6]) >> (slot & 63)) & 1)


def bitmap(prefixes: DataFrame) -> Bitmap:
    """The bitmap of stored prefixes (lang, item); the driver receives its words only."""
    bits = LEAST_BITS
    wanted = 16 * prefixes.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    slot = F.crc32(F.concat("lang", F.lit(b"\0"), "item")).bitwiseAND(F.lit(bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int"))
    words = prefixes.groupBy(F.floor(slot / 64).alias("word")).agg(F.bit_or(one).alias("value")).toPandas()
    return Bitmap(words["word"].to_numpy(np.int64), words["value"].to_numpy(np.int64), bits)


class _Known(dict):
    """Prefixes of one language that a task has looked up."""

    def __init__(self, lang: bytes, stays: Bitmap):
        self.lang, self.stays = lang, stays

    def __missing__(self, prefix: bytes) -> bool:
        if len(self) >= HELD:
            self.clear()
        known = self[prefix] = self.stays(self.lang, prefix)
        return known


def _cut(batches: Iterator[pa.RecordBatch], level: int, stays: Bitmap) -> Iterator[pa.RecordBatch]:
    """Texts of the distinct terms of ``level`` bytes and more whose prefix stays; texts without any go."""
    known: dict[bytes, _Known] = {}
    for batch in batches:
        langs, texts = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if lang not in known:
                known[lang] = _Known(lang, stays)
            alive = known[lang]
            left = [t for t in set(terms_of(text)) if len(t) >= level and alive[t[:level]]]
            if left:
                langs.append(lang)
                texts.append(b" ".join(left))
        yield pa.record_batch([pa.array(langs, pa.binary()), pa.array(texts, pa.binary())], ["lang", "text"])


def _rows(counts: dict[bytes, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, docs in counts.items():
        items = list(docs)
        for at in range(0, len(items), _BATCH):
            part = items[at : at + _BATCH]
            columns = [pa.array([lang] * len(part), pa.binary()), pa.array(part, pa.binary()), pa.array([docs[i] for i in part], pa.int64())]
            yield pa.record_batch(columns, ["lang", "item", "docs"])


def _count(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """Documents of each item: a term of fewer than ``level`` bytes, or the prefix of a longer one."""
    counts: dict[bytes, Counter] = {}
    start = itemgetter(slice(level))
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if lang not in counts:
                counts[lang] = Counter()
            counts[lang].update(set(map(start, terms_of(text))))
            # A text of n bytes adds fewer than n items.
            if len(counts[lang]) > HELD:
                yield from _rows({lang: counts.pop(lang)})
    yield from _rows(counts)


def _packed(lang: bytes, uses: dict[bytes, Counter], kept: Bitmap) -> Iterator[pa.RecordBatch]:
    """A row per term with the sources that use it."""
    sizes = [len(c) for c in uses.values()]
    items = pa.array([t for c in uses.values() for t in c], pa.binary()).dictionary_encode()
    numbers = np.fromiter((n for c in uses.values() for n in c.values()), np.int64, sum(sizes))
    sources = np.repeat(np.arange(len(sizes)), sizes)
    stays = np.fromiter((kept(lang, t) for t in items.dictionary.to_pylist()), bool, len(items.dictionary))
    codes = items.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    order = order[stays[codes[order]]]
    ends = np.flatnonzero(np.diff(codes[order], append=-1)) + 1
    names = pa.array(list(uses), pa.binary())
    for at in range(0, len(ends), _BATCH):
        part = ends[at : at + _BATCH]
        first = ends[at - 1] if at else 0
        taken, offsets = order[first : part[-1]], pa.array(np.concatenate([[0], part - first]), pa.int32())
        columns = [
            pa.array([lang] * len(part), pa.binary()),
            items.dictionary.take(pa.array(codes[order[part - 1]])),
            pa.ListArray.from_arrays(offsets, names.take(pa.array(sources[taken]))),
            pa.ListArray.from_arrays(offsets, pa.array(numbers[taken])),
        ]
        yield pa.record_batch(columns, ["lang", "item", "sources", "uses"])


def _uses(batches: Iterator[pa.RecordBatch], kept: Bitmap) -> Iterator[pa.RecordBatch]:
    """Uses of the kept terms by language and source, combined in the task."""
    held: dict[bytes, dict[bytes, Counter]] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            uses = held.setdefault(lang, {}).setdefault(source, Counter())
            size -= len(uses)
            uses.update(terms_of(text))
            size += len(uses)
            if size > HELD_USES:
                lang = max(held, key=lambda k: sum(map(len, held[k].values())))
                size -= sum(map(len, held[lang].values()))
                yield from _packed(lang, held.pop(lang), kept)
    for lang in list(held):
        yield from _packed(lang, held.pop(lang), kept)


def read_texts(docs: DataFrame) -> DataFrame:
    """(lang, source, text) as bytes, nulls as empty."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("lang", "source", "text")])


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS, first: int = FIRST_LEVEL) -> DataFrame:
    """(lang, item) of the terms in at least ``least`` documents of their language, stored."""
    texts, level, complete = read_texts(docs).select("lang", "text"), first, None
    while True:
        counted = texts.mapInArrow(lambda batches, n=level: _count(batches, n), "lang binary, item binary, docs bigint")
        often = counted.groupBy("lang", "item").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least)
        often = stored(often.select("lang", "item"), f"items-{level}")
        whole = often.where(F.length("item") < level)
        complete = whole if complete is None else complete.unionByName(whole)
        prefixes = often.where(F.length("item") == level)
        if prefixes.isEmpty():
            return complete
        stays = bitmap(prefixes)
        cut = texts.mapInArrow(lambda batches, n=level, s=stays: _cut(batches, n, s), texts.schema)
        texts, level = stored(cut, f"texts-{level}"), 2 * level


def term_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS, first: int = FIRST_LEVEL) -> DataFrame:
    """(lang, source, item, uses, all_uses) of the kept terms where a source uses them, stored."""
    kept = kept_terms(docs, least, first)
    stays = bitmap(kept)
    packed = read_texts(docs).mapInArrow(lambda batches: _uses(batches, stays), "lang binary, item binary, sources array<binary>, uses array<bigint>")
    # The join drops what only shares a bit; what follows keeps its partitioning by term.
    pairs = packed.join(kept, ["lang", "item"]).select("lang", "item", F.explode(F.arrays_zip("sources", "uses")).alias("it"))
    used = pairs.groupBy("lang", "item", F.col("it.sources").alias("source")).agg(F.sum("it.uses").alias("uses"))
    return stored(used.withColumn("all_uses", F.sum("uses").over(Window.partitionBy("lang", "item"))), "uses")


def _share(uses: Column | str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (uses + 2) / (total + 2 terms)), exact beyond 64 bits."""
    uses = F.col(uses) if isinstance(uses, str) else uses
    top = (uses + 2).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    below = (F.col(total) + 2 * F.col(terms)).cast("decimal(20,0)")
    return F.call_function("div", top, F.greatest(below, F.lit(1))) + 1


def _far(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    return rows.withColumn("rank", F.row_number().over(order))


def _groups(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, total, terms, p0) per occurring group, stored; p0 is the share of an unused term."""
    given = read_texts(docs).select("lang", "source").distinct()
    terms = counts.groupBy("lang", "item").agg(F.lit(1)).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("uses").alias("total"))
    joined = given.join(totals, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["total", "terms"])
    return stored(joined.withColumn("p0", _share(F.lit(0), "total", "terms")), "groups")


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """Every other source of the language by its summed distance over all kept terms.

    Most terms are unused by most sources, so a pair starts from the distance of two unused
    terms, once per kept term. Corrections: terms of one source, by the counts they have there, and
    the terms that both use. The result itself lists all pairs of sources of a language.
    """
    shares = counts.join(groups, ["lang", "source"]).select("lang", "source", "item", "p0", _share("uses", "total", "terms").alias("p"))
    right = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    pairs = groups.select("lang", "source", "terms", "p0").join(right, "lang").where("source <> other")
    base = pairs.select("lang", "source", "other", (F.col("terms") * _far("p0", "q0")).alias("value"))
    alike = shares.groupBy("lang", "source", "p0", "p").agg(F.count(F.lit(1)).alias("n"))
    own = (
        alike.join(right, "lang")
        .where("source <> other")
        .groupBy("lang", "source", "other")
        .agg(F.sum(F.col("n") * (_far("p", "q0") - _far("p0", "q0"))).alias("value"))
    )
    others = shares.select("lang", "item", F.col("source").alias("other"), F.col("p0").alias("q0"), F.col("p").alias("q"))
    fix = _far("p", "q") - _far("p", "q0") - _far("p0", "q") + _far("p0", "q0")
    both = shares.join(others, ["lang", "item"]).where("source < other").groupBy("lang", "source", "other").agg(F.sum(fix).alias("value"))
    turned = own.unionByName(both)
    turned = turned.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value")
    parts = base.unionByName(own).unionByName(both).unionByName(turned)
    summed = parts.groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    return _ranked(summed).withColumn("part", F.lit("pair"))


def _terms(counts: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The terms a source uses more than its language does, furthest first."""
    langs = groups.groupBy("lang").agg(F.sum("total").alias("all_total"))
    shares = counts.join(groups, ["lang", "source"]).join(langs, "lang")
    shares = shares.withColumn("p", _share("uses", "total", "terms")).withColumn("q", _share("all_uses", "all_total", "terms"))
    rows = shares.where("p > q").select("lang", "source", "item", _far("p", "q").alias("value"))
    return _ranked(rows).where(F.col("rank") <= top).withColumn("part", F.lit("term"))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of the parts ``pair`` and ``term``.

    With p and q the shares of a term in two groups, in parts of 10^9 and never 0, its distance
    is floor((p - q)^2 / (p + q)). A language without kept terms has pairs at distance 0. Rows are
    ranked by distance, then by the bytes of the item.
    """
    counts = term_counts(docs, least)
    groups = _groups(docs, counts)
    rows = _pairs(counts, groups).unionByName(_terms(counts, groups, top))
    texts = [F.col(c).cast("string").alias(c) for c in ("lang", "source", "item")]
    return rows.select(*texts[:2], "part", texts[2], "value", F.col("rank").cast("int").alias("rank"))
