"""Mixing sources to target weights: repetition rates and hash-seeded extra copies.

DataFrame functions only. Sizes are summed per source before anything is joined, so a source
with any share of the documents is one row of a small table. A source's target is its weight's
share of all words, at most ``MOST_REPEATS`` times its own words; what is above goes to the
others by weight until no target is above its limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from advigil.llm.graph import stored

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix-1"
_HASH_BITS = 52


def word_count(text: Column) -> Column:
    """Runs of other characters than blank, tab to carriage return; 0 for null."""
    spaced = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    blanks = F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))
    return F.when(text.isNull() | (spaced == ""), F.lit(0)).otherwise(blanks + 1).cast("long")


def source_sizes(docs: DataFrame) -> DataFrame:
    """(source, source_size) with the words of every source; null is a source of its own."""
    return docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))


def _running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Running sums over the whole table in a total order, without one task for all rows.

    The rows are range-sorted and stored with their partition, summed within it, and get the
    sums of the partitions before. Only one row per partition meets in a single task.
    """
    ordered = stored(df.orderBy(*order).withColumn("_part", F.spark_partition_id()), "running")
    local = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("_part").agg(*(F.sum(F.expr(e)).alias(k) for k, e in sums.items()))
    parts = parts.select("_part", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_{k}") for k in sums))
    summed = ordered.withColumns({k: F.sum(F.expr(e)).over(local) for k, e in sums.items()})
    return summed.join(parts, "_part").withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop("_part", *(f"_{k}" for k in sums))


def source_targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target): sources by code point, null last, have the weights in turn.

    In ascending order of limit / weight a source is held at its limit as long as that is below
    its share of what the held ones before it leave. Without words every target is 0.
    """
    placed = _running(source_sizes(docs).withColumn("_null", F.col("source").isNull()), ["_null", "source"], {"place": "1"})
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    limited = placed.withColumn("weight", turn.cast("long")).withColumn("limit", F.col("source_size") * repeats)
    limited = limited.withColumn("ratio", F.col("limit") / F.col("weight"))
    summed = _running(limited, ["ratio", "place"], {"limits": "limit", "weights": "weight", "sizes": "source_size"})
    summed = stored(summed, "targets")
    # Two rows of totals come to the driver, whatever the number of sources.
    total = summed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    if total["words"] is None:
        return summed.select("source", "source_size", F.lit(0.0).alias("target"))
    # Words and weights that are left when the sources before this one are held at their limits.
    left_words = F.lit(total["words"]) - (F.col("limits") - F.col("limit"))
    left_weight = F.lit(total["weight"]) - (F.col("weights") - F.col("weight"))
    # Held sources are a prefix of the order; the rest shares what they leave.
    marked = summed.withColumn("held", F.col("ratio") <= left_words / left_weight)
    held = marked.where("held").agg(F.coalesce(F.sum("limit"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    share = F.col("weight") * F.lit(total["words"] - held["words"]) / F.lit(max(total["weight"] - held["weight"], 1))
    target = F.when(F.col("held"), F.col("limit").cast("double")).otherwise(share.cast("double"))
    return marked.select("source", "source_size", target.alias("target"))


def _uniform(seed: str) -> Column:
    """A number in [0, 1) from seed, doc_id and text: equal in every run and on every machine."""
    parts = [F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))]
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, _HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << _HASH_BITS))


def with_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """``docs`` and, as a struct in the column ``__mix``, size, source_size, target, rate and copies.

    A document is taken floor(rate) times, and once more with the probability of the fraction.
    Rows of equal doc_id and text draw alike. Empty sources have the rate 0.
    """
    targets = stored(source_targets(docs, weights, repeats), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(repeats)))).otherwise(F.lit(0.0))
    targets = targets.select(F.col("source").alias("__source"), "source_size", "target", rate.alias("rate"))
    targets = targets.select("__source", F.struct("source_size", "target", "rate").alias("__target"))
    rows = docs.withColumn("__size", word_count(F.col("text"))).withColumn("__draw", _uniform(seed))
    joined = rows.join(targets, F.col("source").eqNullSafe(F.col("__source")))
    whole = F.floor("__target.rate")
    copies = (whole + F.when(F.col("__draw") < F.col("__target.rate") - whole, 1).otherwise(0)).cast("int")
    mix = F.struct(
        F.col("__size").alias("size"),
        F.col("__target.source_size").alias("source_size"),
        F.col("__target.target").alias("target"),
        F.col("__target.rate").alias("rate"),
        copies.alias("copies"),
    )
    return joined.select(*docs.columns, mix.alias("__mix"))


def mixture_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words with repeats), copies."""
    found = with_copies(docs.select("doc_id", "text", "source"))
    return found.select(
        "doc_id",
        "__mix.size",
        "__mix.source_size",
        "__mix.target",
        (F.col("__mix.size") * F.col("__mix.copies")).cast("long").alias("taken"),
        "__mix.copies",
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Every document as often as the mixture takes it, with ``copy`` from 1; other columns are kept.

    A column of the input named ``copy`` is replaced.
    """
    kept = [c for c in docs.columns if c != "copy"]
    found = with_copies(docs).where("__mix.copies > 0")
    return found.select(*kept, F.explode(F.sequence(F.lit(1), F.col("__mix.copies"))).alias("copy"))
