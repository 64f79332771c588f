"""Records of text files that are longer or shorter than a line, read by all splits at once.

Whether a quote is open at the start of a line depends on all lines before it. Each line, and by
composition each split, is a function from the state at its start to the state at its end. The
functions of a file's splits, one small row each, compose to the true state at every split; within
a split they compose over the lines that hold a quote. No text moves for that.

Lines that a quote joins are brought together by record. A file without such lines is read line by
line, and one stray quote costs no more than the lines it reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from advigil.session import stored

# A cell may not be longer; a record that is longer than all its cells may be is not put together.
MOST_CELL_CHARACTERS = 131_072
# An element of a JSON array that is longer is taken for a broken file.
MOST_ELEMENT_CHARACTERS = 1 << 26
# Bytes of a split of a JSON file: the pieces of a split are sorted and numbered in one task, each with its place, which is longer than most.
JSON_SPLIT_BYTES = 8 << 20
# Ranges of lines meet the lines by blocks of so many rows.
_BLOCK = 64
_SPLIT = ["file", "start"]


def text_lines(spark: SparkSession, path: str | list[str], separator: str = "\n") -> DataFrame:
    """(file, start, row, value): start of the split, and a number that grows within it."""
    read = spark.read.option("lineSep", separator).text(path)
    return read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )


# --- composition of state functions -------------------------------------------


def _before(rows: DataFrame, partition: list[str], order: str) -> DataFrame:
    """Adds before0 and before1: the state before a row if the partition starts in state 0 or 1.

    ``to0`` and ``to1`` are the states after a row that starts in 0 or 1. What came before the last row
    that ends the same way whatever it started with does not matter; since then only swaps count.
    """
    until = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col("to0") & ~F.col("to1")).cast("int")
    fixed = F.when(F.col("to0") == F.col("to1"), F.struct(F.col("to0").alias("state"), F.col("_swaps").alias("swaps")))
    out = rows.withColumn("_swaps", F.sum(swap).over(until)).withColumn("_fixed", F.last(fixed, True).over(past))
    earlier = F.col("_swaps") - swap
    turned = (earlier - F.coalesce("_fixed.swaps", F.lit(0))) % 2 == 1
    for start in (False, True):
        base = F.coalesce("_fixed.state", F.lit(start))
        out = out.withColumn(f"before{int(start)}", base != turned)
    return out.drop("_swaps", "_fixed")


def _applied(state: Column) -> Column:
    return F.when(state, F.col("to1")).otherwise(F.col("to0"))


def split_starts(splits: DataFrame, effects: DataFrame) -> DataFrame:
    """Splits (file, start, ...) with ``open``: the state in which each one starts.

    ``effects`` has to0 and to1 of the splits that are not without effect.
    """
    joined = splits.join(effects, _SPLIT, "left").withColumns({"to0": F.coalesce("to0", F.lit(False)), "to1": F.coalesce("to1", F.lit(True))})
    return _before(joined, ["file"], "start").withColumnRenamed("before0", "open").drop("before1", "to0", "to1")


# --- quotes of delimited files -----------------------------------------------


def _closes(piece: Column) -> Column:
    """Does the text of an open cell hold a quote that is not doubled?"""
    return F.contains(F.replace(piece, F.lit('""'), F.lit("")), F.lit('"'))


def _open_after(line: Column, delimiter: str, start: bool) -> Column:
    """Is a cell open at the end of the line? A quote opens a cell only as its first character."""

    def step(state: Column, piece: Column) -> Column:
        opens = piece.startswith('"') & ~_closes(F.substring(piece, 2, MOST_CELL_CHARACTERS * 64))
        return F.when(state, ~_closes(piece)).otherwise(opens)

    return F.aggregate(F.split(line, delimiter), F.lit(start), step)


def _ranges(lines: DataFrame, splits: DataFrame, delimiter: str) -> DataFrame:
    """Lines of the same record per split: (file, start, first, last, record_start, record_row)."""
    quoted = lines.where(F.contains("value", F.lit('"'))).select(
        *_SPLIT, "row", _open_after(F.col("value"), delimiter, False).alias("to0"), _open_after(F.col("value"), delimiter, True).alias("to1")
    )
    events = stored(_before(quoted, _SPLIT, "row"), "quotes")
    last = F.max_by(F.struct(_applied(F.col("before0")).alias("to0"), _applied(F.col("before1")).alias("to1")), "row").alias("end")
    effects = events.groupBy(*_SPLIT).agg(last).select(*_SPLIT, "end.to0", "end.to1")
    splits = stored(split_starts(splits, effects), "splits")
    was = F.when(F.col("open"), F.col("before1")).otherwise(F.col("before0"))
    moves = events.join(splits, _SPLIT).withColumn("was", was).withColumn("now", _applied(F.col("was"))).where("was <> now")
    moves = moves.select(*_SPLIT, "row", "now", F.col("end_row"))
    following = F.lead("row").over(Window.partitionBy(*_SPLIT).orderBy("row"))
    begun = moves.withColumn("next", following).where("now").select(
        *_SPLIT, F.col("row").alias("first"), F.coalesce("next", "end_row").alias("last"), F.col("start").alias("record_start"), F.col("row").alias("record_row")
    )
    # A split that starts inside a record goes on with the last one begun before it.
    opened = moves.where("now").groupBy(*_SPLIT).agg(F.max(F.struct("start", "row")).alias("begun"))
    closed = moves.where("NOT now").groupBy(*_SPLIT).agg(F.min("row").alias("closed"))
    past = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    carried = splits.join(opened, _SPLIT, "left").withColumn("from", F.last("begun", True).over(past)).where("open").join(closed, _SPLIT, "left")
    carried = carried.select(
        *_SPLIT, F.col("first_row").alias("first"), F.coalesce("closed", "end_row").alias("last"), F.col("from.start").alias("record_start"), F.col("from.row").alias("record_row")
    )
    return begun.unionByName(carried)


def quoted_records(spark: SparkSession, path: str | list[str], delimiter: str, columns: int) -> DataFrame:
    """(file, start, row, value, head): one row per record, by its first line; ``head`` marks the first of a file.

    ``delimiter`` is a regular expression of one character. Quotes may span lines and splits.
    The value of a record beyond ``columns`` cells of the greatest length is null. Two passes over the
    text are made at once, and one more if there are quotes; the result is read lazily.
    """
    lines = text_lines(spark, path)
    head = F.min(F.when(F.col("start") == 0, F.col("row"))).alias("head_row")
    quotes = F.bool_or(F.contains("value", F.lit('"'))).alias("quoted")
    measured = lines.groupBy(*_SPLIT).agg(F.min("row").alias("first_row"), F.max("row").alias("end_row"), head, quotes)
    splits = stored(measured, "splits")
    heads = splits.where("start = 0").select(*_SPLIT, F.col("head_row").alias("row"), F.lit(True).alias("head"))
    clean = F.regexp_replace("value", "\r$", "").alias("value")
    whole = lines
    joined = None
    if not splits.where("quoted").isEmpty():
        ranges = stored(_ranges(lines, splits.drop("head_row", "quoted"), delimiter), "quoted-lines")
        if not ranges.isEmpty():
            block = F.floor(F.col("row") / _BLOCK).alias("block")
            blocks = F.explode(F.sequence(F.floor(F.col("first") / _BLOCK), F.floor(F.col("last") / _BLOCK))).alias("block")
            near = ranges.select("*", blocks)
            keyed = lines.select("*", block)
            same = (keyed["file"] == near["file"]) & (keyed["start"] == near["start"]) & (keyed["block"] == near["block"])
            within = same & keyed["row"].between(near["first"], near["last"])
            whole = keyed.join(near, within, "left_anti").drop("block")
            key = ["file", "record_start", "record_row"]
            parts = keyed.join(near, within).select(keyed["file"], "record_start", "record_row", keyed["start"], "row", "value")
            sizes = parts.groupBy(*key).agg(F.sum(F.length("value") + 1).alias("size"))
            fits = F.col("size") <= columns * MOST_CELL_CHARACTERS
            texts = parts.join(sizes.where(fits), key).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "row", "value"))).alias("lines"))
            text = F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("value")
            joined = texts.select(*key, text).unionByName(sizes.where(~fits).select(*key, F.lit(None).cast("string").alias("value")))
            joined = joined.withColumnsRenamed({"record_start": "start", "record_row": "row"})
    if joined is not None:
        whole = whole.unionByName(joined)
    return whole.join(heads, [*_SPLIT, "row"], "left").select(*_SPLIT, "row", clean, F.coalesce("head", F.lit(False)).alias("head"))


def _cell(acc: Column, piece: Column, open_: Column) -> Column:
    """The next state of ``cells_of``: the piece goes on with an open cell or starts one."""
    text = F.when(open_, piece).otherwise(F.substring(piece, 2, MOST_CELL_CHARACTERS * 64))
    before = F.when(open_, F.concat(acc["cell"], acc["between"])).otherwise(F.lit(""))
    parts = F.split(text, '""')
    place = F.array_position(F.transform(parts, lambda x: F.contains(x, F.lit('"'))), True)
    hit = F.get(parts, (place - 1).cast("int"))
    at = F.instr(hit, F.lit('"'))
    inside = F.array_join(F.concat(F.slice(parts, F.lit(1), F.greatest(place - 1, F.lit(0)).cast("int")), F.array(F.left(hit, at - 1))), '"')
    rest = F.slice(parts, (place + 1).cast("int"), F.size(parts))
    behind = F.concat(F.substr(hit, at + 1), F.when(F.size(rest) > 0, F.concat(F.lit('""'), F.array_join(rest, '""'))).otherwise(F.lit("")))
    ended = F.concat(before, inside, behind)
    going = F.concat(before, F.array_join(parts, '"'))
    none = place == 0
    return F.struct(
        F.when(none, acc["cells"]).otherwise(F.concat(acc["cells"], F.array(ended))).alias("cells"),
        none.alias("open"),
        F.when(none, going).otherwise(F.lit("")).alias("cell"),
        acc["between"].alias("between"),
    )


def cells_of(record: Column, delimiter: str, character: str) -> Column:
    """Cells of a record: a quote at the start of a cell encloses it, a doubled one in it is one quote.

    What follows the closing quote belongs to the cell as it is, and so does a quote further in.
    """
    start = F.struct(
        F.array().cast("array<string>").alias("cells"), F.lit(False).alias("open"), F.lit("").alias("cell"), F.lit(character).alias("between")
    )

    def step(acc: Column, piece: Column) -> Column:
        plain = F.struct(F.concat(acc["cells"], F.array(piece)).alias("cells"), F.lit(False).alias("open"), F.lit("").alias("cell"), acc["between"].alias("between"))
        return F.when(acc["open"] | piece.startswith('"'), _cell(acc, piece, acc["open"])).otherwise(plain)

    def end(acc: Column) -> Column:
        return F.when(acc["open"], F.concat(acc["cells"], F.array(acc["cell"]))).otherwise(acc["cells"])

    pieces = F.split(record, delimiter)
    return F.when(F.contains(record, F.lit('"')), F.aggregate(pieces, start, step, end)).otherwise(pieces)


# --- elements of JSON arrays ---------------------------------------------------


def _depth_change(text: Column, end_inside: Column) -> Column:
    """Brackets opened less closed outside of strings, with the ``}`` that ends the piece."""
    bare = F.regexp_replace(text, r'"[^"]*("|$)', "")
    return (
        F.length(F.regexp_replace(bare, r"[^{\[]", "")) - F.length(F.regexp_replace(bare, r"[^\]]", "")) - F.when(end_inside, 0).otherwise(1)
    ).cast("bigint")


def json_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, number, value): the objects of files that each hold one JSON array, on one line or many; ``file`` is the MD5 of the path.

    Files are cut at ``}`` and read in splits. Whether a piece starts in a string, and how deep in brackets, is
    composed over the pieces of a split and over the splits of a file. An element ends where the
    depth is 1 again; its pieces meet by its number. Elements that are no objects are passed over.
    """
    # A path is longer than most pieces, all of which are sorted with it.
    pieces = text_lines(spark, path, "}").withColumn("file", F.unhex(F.md5("file")))
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    swaps = quotes % 2 == 1
    measured = pieces.select(
        "*",
        swaps.cast("int").alias("swaps"),
        _depth_change(plain, swaps).alias("change0"),
        _depth_change(F.concat(F.lit('"'), plain), ~swaps).alias("change1"),
    )
    until = Window.partitionBy(*_SPLIT).orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    odd = (F.sum("swaps").over(until) - F.col("swaps")) % 2
    placed = measured.withColumn("odd", odd)
    for start in (0, 1):
        change = F.when(F.col("odd") == start, F.col("change0")).otherwise(F.col("change1"))
        placed = placed.withColumn(f"depth{start}", F.sum(change).over(until))
    most = min(JSON_SPLIT_BYTES, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    small = {"spark.sql.files.maxPartitionBytes": f"{most}b"}
    pieces = stored(placed.select(*_SPLIT, "row", "value", "swaps", "odd", "depth0", "depth1"), "json-pieces", small)
    # A split changes the depth by what its last piece has come to, by the state it starts in.
    ends = pieces.groupBy(*_SPLIT).agg(F.sum("swaps").alias("swaps"), F.max_by(F.struct("depth0", "depth1"), "row").alias("by"))
    past = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    states = ends.withColumn("inside", F.coalesce(F.sum("swaps").over(past), F.lit(0)) % 2 == 1)
    change = F.when(F.col("inside"), F.col("by.depth1")).otherwise(F.col("by.depth0"))
    starts = states.withColumn("change", change).withColumn("base", F.coalesce(F.sum("change").over(past), F.lit(0)))
    known = pieces.join(starts.select(*_SPLIT, "inside", "base"), _SPLIT)
    # A piece ends outside of strings if the swaps up to its end are even.
    outside = ((F.col("odd") + F.col("swaps")) % 2 == 1) == F.col("inside")
    depth = F.col("base") + F.when(F.col("inside"), F.col("depth1")).otherwise(F.col("depth0"))
    ended = known.select(*_SPLIT, "row", "value", (outside & (depth == 1)).cast("int").alias("ends"))
    counted = ended.withColumn("before", F.sum("ends").over(until) - F.col("ends"))
    sums = ended.groupBy(*_SPLIT).agg(F.sum("ends").alias("ends")).withColumn("earlier", F.coalesce(F.sum("ends").over(past), F.lit(0)))
    numbered = counted.join(sums.select(*_SPLIT, "earlier"), _SPLIT).withColumn("number", F.col("earlier") + F.col("before"))
    numbered = stored(numbered.select("file", "number", "start", "row", "value", "ends", F.length("value").alias("size")), "json-elements")
    beyond = numbered.groupBy("file", "number").agg(F.sum("size").alias("size")).where(F.col("size") > MOST_ELEMENT_CHARACTERS)
    if not beyond.isEmpty():
        raise ValueError(f"an array element in {path} does not end within {MOST_ELEMENT_CHARACTERS} characters")
    grouped = numbered.groupBy("file", "number").agg(F.max("ends").alias("ends"), F.sort_array(F.collect_list(F.struct("start", "row", "value"))).alias("pieces"))
    text = F.concat(F.array_join(F.transform("pieces", lambda x: x["value"]), "}"), F.lit("}"))
    whole = grouped.where("ends = 1").withColumn("value", text)
    return whole.select("file", "number", F.substr("value", F.instr("value", F.lit("{"))).alias("value"))
