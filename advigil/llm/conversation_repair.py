"""Cheapest repair of damaged conversations by grammar-compressed dynamic programming.

A conversation's rows, in order, become a string of symbols: the class of the role's initial and
whether the row ends well, is truncated, or has to go. Repairing is a walk over four states (nothing
yet, after the system row, after a user row, after an assistant row), so every symbol is a 4 x 4
min-plus matrix whose cells hold a cost and the edits behind it. Matrices multiply, so:

1. Rows are dealt by range over (conversation, turn, role, text). A conversation with any share of all rows is
   split over tasks and into segments of bounded length.
2. Re-Pair replaces the most frequent pairs of symbols over all segments by rules, level by level.
3. A rule's matrix is the product of its two sides', made once and used by every conversation. The
   edits are ropes: a product refers to the edits of its factors instead of copying them.
4. A segment's matrix is the product along its compressed string. Segments of a conversation
   are multiplied in order; the best cell names the edits, by which the texts are hashed.

Edits of equal cost and equal end differ in a letter before either ends, as every letter has a fixed
effect and each insertion costs something. So the least of two joined ropes is made of the least ropes.

Nulls in role and text are one space, and in the key that decides on damage as well. A null conversation is one of its
own, null turns come first. Rows of one turn follow each other by role, then text. Repeated rows are
rows. Empty texts are blank. Very long texts are read whole and hashed in a stream; the edits of a
conversation are one value, as the result asks for them. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from advigil.llm.graph import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SEGMENT_ROWS, SEGMENT_BYTES = 1000, 1 << 20
# Rules of the grammar; what they leave is multiplied symbol by symbol.
MOST_RULES = 512
_FIRST_RULE = 256
# Compressed strings whose matrices a task remembers.
MEMO = 20_000

_SPACE = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
GONE = "d"


# --- ropes and matrices ------------------------------------------------------


class Rope:
    """Edits as a tree of shared parts; short ones are plain text."""

    __slots__ = ("left", "right", "size", "text")

    def __init__(self, text: str | None = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        self.size = len(text) if text is not None else left.size + right.size

    def __add__(self, other: Rope) -> Rope:
        if not self.size or not other.size:
            return self if self.size else other
        if self.size + other.size <= 64:
            return Rope(self.text + other.text)
        return Rope(None, self, other)

    def parts(self) -> Iterator[str]:
        left = [self]
        while left:
            rope = left.pop()
            if rope.text is not None:
                yield rope.text
            else:
                left += [rope.right, rope.left]

    def __str__(self) -> str:
        return "".join(self.parts())

    def __lt__(self, other: Rope) -> bool:
        if self is other:
            return False
        mine, theirs, a, b = self.parts(), other.parts(), "", ""
        while True:
            a, b = a or next(mine, ""), b or next(theirs, "")
            n = min(len(a), len(b))
            if not n or a[:n] != b[:n]:
                return a[:n] < b[:n] if n else bool(b)
            a, b = a[n:], b[n:]


Cell = tuple[int, Rope]
Matrix = list[list[Cell | None]]


def _less(a: Cell, b: Cell | None) -> bool:
    return b is None or a[0] < b[0] or (a[0] == b[0] and a[1] < b[1])


def row_product(row: list[Cell | None], right: Matrix) -> list[Cell | None]:
    out: list[Cell | None] = [None] * 4
    for mid in range(4):
        if row[mid] is None:
            continue
        cost, rope = row[mid]
        for to in range(4):
            step = right[mid][to]
            if step is None or (out[to] is not None and cost + step[0] > out[to][0]):
                continue
            cell = (cost + step[0], rope + step[1])
            if _less(cell, out[to]):
                out[to] = cell
    return out


def product(left: Matrix, right: Matrix) -> Matrix:
    return [row_product(row, right) for row in left]


def insertions() -> Matrix:
    """Any number of inserted rows between two states."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for state in range(4):
        at, edits = state, 0
        while out[state][at] is None:
            out[state][at] = (INSERT * edits, Rope("I" * edits))
            at, edits = _NEXT[at], edits + 1
    return out


def kept_state(state: int, initial: str) -> int | None:
    """The state after a row with this initial is kept, if that is allowed."""
    if initial == "s":
        return SYSTEM if state == START else None
    return _NEXT[state] if initial == {USER: "u", ASSISTANT: "a"}[_NEXT[state]] else None


def symbol_matrix(symbol: str) -> Matrix:
    """One row's edits, then insertions."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    initial, more = symbol.lower(), TRUNCATED * symbol.isupper()
    for state in range(4):
        steps = [(state, DELETE, "D")]
        if symbol != GONE:
            steps.append((_NEXT[state], REROLE + more, "R"))
            if kept_state(state, initial) is not None:
                steps.append((kept_state(state, initial), KEEP + more, "K"))
        for to, cost, letter in steps:
            cell = (cost, Rope(letter))
            if _less(cell, out[state][to]):
                out[state][to] = cell
    return product(out, insertions())


class Grammar:
    """Rules in their order; the n-th one writes its pair of symbols as one character."""

    def __init__(self, rules: list[str]):
        self.rules = rules
        self.matrices: dict[str, Matrix] = {}
        self.whole: dict[str, Matrix] = {}

    def compress(self, symbols: str, since: int = 0) -> str:
        for n in range(since, len(self.rules)):
            symbols = symbols.replace(self.rules[n], chr(_FIRST_RULE + n))
        return symbols

    def matrix(self, symbol: str) -> Matrix:
        """Bottom-up: the sides of a rule are older than the rule."""
        if symbol not in self.matrices:
            n = ord(symbol) - _FIRST_RULE
            if n < 0:
                self.matrices[symbol] = symbol_matrix(symbol)
            else:
                for side in self.rules[n]:
                    self.matrix(side)
                self.matrices[symbol] = product(*(self.matrices[side] for side in self.rules[n]))
        return self.matrices[symbol]

    def segment(self, symbols: str) -> Matrix:
        """The matrix of a string of row symbols."""
        found = self.whole.get(symbols)
        if found is None:
            found = [[(0, Rope()) if i == j else None for j in range(4)] for i in range(4)]
            for symbol in self.compress(symbols):
                found = product(found, self.matrix(symbol))
            if len(self.whole) >= MEMO:
                self.whole.clear()
            self.whole[symbols] = found
        return found


def first_row() -> list[Cell | None]:
    return insertions()[START]


def best(row: list[Cell | None]) -> Cell:
    """The cheapest end: nothing left, or after an assistant row."""
    a, b = row[START], row[ASSISTANT]
    if a is None or b is None:
        return a or b
    return a if _less(a, b) else b


# --- rows and segments -------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after damage; dropped rows stay with 0 copies."""
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    return conversations.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in order over the partitions, with ``later``: the same role and text have an earlier turn."""
    keys = ["conv_id", F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(7), "role", "text").alias("k2")]
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    places = rows.where("copies > 0").select(*keys, place.alias("place")).groupBy("conv_id", "k1", "k2")
    again = places.agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").drop("last")
    keyed, again = rows.select("*", *keys[1:]), again.withColumnRenamed("conv_id", "conv")
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (keyed["k1"] == again["k1"]) & (keyed["k2"] == again["k2"])
    marked = keyed.join(again, same, "left").select(
        "conv_id", "turn", "role", "text", "copies", F.coalesce(place > F.col("first"), F.lit(False)).alias("later")
    )
    order = ["conv_id", "turn", "role", "text"]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return marked.repartitionByRange(tasks, *order).sortWithinPartitions(*order)


_SEGMENT = (
    "part int, number int, within boolean, symbols string, roles array<string>, texts array<string>, first string, last string, "
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, first_turn bigint, last_turn bigint"
)
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


class _Segment:
    def __init__(self, conv_id, part: int, number: int, opens: bool):
        self.row = {"conv_id": conv_id, "part": part, "number": number, "within": opens, "roles": [], "texts": [], "first": None, "last": None}
        self.row |= dict.fromkeys(_COUNTS, 0) | {"first_turn": None, "last_turn": None}
        self.symbols: list[str] = []
        self.size = 0

    def add(self, turn, role: str, text: str, duplicate: bool) -> None:
        row, initial, end = self.row, role[:1], text.rstrip(_SPACE)[-1:]
        if row["last"] is None:
            row["first"] = initial
        else:
            row["illegal"] += row["last"] + initial not in _LEGAL
        row["last"] = initial
        if turn is not None and turn != row["last_turn"]:
            row["turns"] += 1
            row["last_turn"] = turn
            if row["first_turn"] is None:
                row["first_turn"] = turn
        fault = "blank" if not end else "duplicate" if duplicate else "truncated" if end not in ".!?" else None
        if fault:
            row[fault] += 1
        if fault in ("blank", "duplicate"):
            self.symbols.append(GONE)
        else:
            symbol = initial if initial in ("s", "u", "a") else "o"
            self.symbols.append(symbol.upper() if fault else symbol)
            row["roles"].append(role)
            row["texts"].append(text)
        self.size += len(text)

    def full(self) -> bool:
        return len(self.symbols) >= SEGMENT_ROWS or self.size >= SEGMENT_BYTES

    def done(self, within: bool) -> dict:
        return self.row | {"within": self.row["within"] and within, "symbols": "".join(self.symbols)}


def _segments(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part, number, now, before, last = TaskContext.get().partitionId(), 0, None, None, object()
    out: list[dict] = []
    held = 0
    for batch in batches:
        for conv_id, turn, role, text, copies, later in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv_id != last or now.full():
                if now is not None:
                    # A conversation that ends here was read whole, unless it began in an earlier task.
                    out.append(now.done(conv_id != last))
                    held += now.size + 200
                number += 1
                now = _Segment(conv_id, part, number, opens=number > 1 and conv_id != last)
                last = conv_id
                if held > SEGMENT_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
            place = (conv_id, turn, role, text)
            for _ in range(copies):
                now.add(turn, role, text, later or place == before)
                before = place
    if now is not None:
        out.append(now.done(False))
        yield pa.RecordBatch.from_pylist(out, schema)


def segments(conversations: DataFrame) -> DataFrame:
    """Bounded runs of a conversation's rows in order, stored; ``within``: the run is all of it."""
    rows = damaged(conversations)
    schema = StructType([rows.schema["conv_id"], *StructType.fromDDL(_SEGMENT)])
    arrow = _arrow_schema(schema)
    return stored(_ordered(rows).mapInArrow(lambda batches: _segments(batches, arrow), schema), "segments")


def _arrow_schema(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


# --- grammar -----------------------------------------------------------------


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of neighbouring symbols; of a run of one symbol every second pair counts."""
    found: Counter = Counter()
    for batch in batches:
        for symbols, times in zip(batch["symbols"], batch["times"], strict=True):
            taken = -1
            for i in range(len(symbols) - 1):
                pair = symbols[i : i + 2]
                if pair[0] == pair[1] and taken == i and symbols[i - 1] == pair[0]:
                    continue
                found[pair] += times
                taken = i + 1
    if found:
        yield pd.DataFrame({"pair": list(found), "times": list(found.values())})


def learned_grammar(rows: DataFrame, most: int = MOST_RULES) -> Grammar:
    """Re-Pair over all strings ``symbols`` with their frequencies.

    A round takes the most frequent pairs that share no symbol, which could replace each other's
    occurrences, and ends if no pair occurs twice or ``most`` rules are there. The driver sees
    at most ``most`` pairs a round.
    """
    grammar = Grammar([])
    texts = stored(rows.where("symbols <> ''").groupBy("symbols").agg(F.count(F.lit(1)).alias("times")), "symbols")
    while len(grammar.rules) < most:
        counted = texts.mapInPandas(_pairs, "pair string, times bigint").groupBy("pair").agg(F.sum("times").alias("times"))
        top = counted.where("times > 1").orderBy(F.col("times").desc(), "pair").limit(most).collect()
        chosen, met = [], set()
        for row in top:
            if not met & set(row["pair"]) and len(grammar.rules) + len(chosen) < most:
                chosen.append(row["pair"])
                met |= set(row["pair"])
        if not chosen:
            break
        since = len(grammar.rules)
        grammar = Grammar(grammar.rules + chosen)

        def compress(batches: Iterator[pd.DataFrame], rules=tuple(grammar.rules), since=since) -> Iterator[pd.DataFrame]:
            known = Grammar(list(rules))
            for batch in batches:
                yield batch.assign(symbols=[known.compress(s, since) for s in batch["symbols"]])

        texts = stored(texts.mapInPandas(compress, texts.schema).where("length(symbols) > 1"), "symbols")
    return grammar


# --- results -----------------------------------------------------------------

_RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class _Repaired:
    """A conversation: first all its segments' matrices in order, then all their texts in order."""

    def __init__(self, grammar: Grammar, conv_id):
        self.grammar, self.conv_id, self.row = grammar, conv_id, first_row()
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.first_turn = self.last_turn = self.last = None
        self.hash, self.audit, self.at, self.state, self.lines = hashlib.sha256(), None, 0, START, 0

    def measure(self, part: dict) -> None:
        for name in _COUNTS:
            self.counts[name] += part[name]
        if part["first"] is not None:
            if self.last is not None:
                self.counts["illegal"] += self.last + part["first"] not in _LEGAL
            self.last = part["last"]
        if part["first_turn"] is not None:
            self.counts["turns"] -= self.last_turn == part["first_turn"]
            self.first_turn = part["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = part["last_turn"]
        self.row = row_product(self.row, self.grammar.segment(part["symbols"]))

    def _write(self, role: str, text: str) -> None:
        self.hash.update(("\n" * bool(self.lines) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = _NEXT[self.state]
            self._write(_ROLE[self.state], "")
            self.at += 1

    def read(self, symbols: str, roles: list[str], texts: list[str]) -> None:
        """Follow the edits over a segment's rows; rows that have to go have no text here."""
        if self.audit is None:
            self.cost, rope = best(self.row)
            self.audit = str(rope)
        row = 0
        for symbol in symbols:
            self._insert()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "R":
                self.state = _NEXT[self.state]
                self._write(_ROLE[self.state], texts[row])
            elif edit == "K":
                self.state = kept_state(self.state, symbol.lower())
                self._write(roles[row], texts[row])
            row += symbol != GONE

    def result(self) -> dict:
        self.read("", [], [])
        self._insert()
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.counts["turns"]
        counts = {k: v for k, v in self.counts.items() if k != "turns"}
        known = {"conv_id": self.conv_id, "gaps": min(gaps, (1 << 63) - 1), "cost": self.cost, "audit": self.audit}
        return known | counts | {"repaired_sha256": self.hash.hexdigest()}


def _whole(batches: Iterator[pa.RecordBatch], rules: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    grammar = Grammar(rules)
    for batch in batches:
        out = []
        for part in batch.to_pylist():
            found = _Repaired(grammar, part["conv_id"])
            found.measure(part)
            found.read(part["symbols"], part["roles"], part["texts"])
            out.append(found.result())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)


def _joined(batches: Iterator[pa.RecordBatch], rules: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    grammar, found = Grammar(rules), None
    for batch in batches:
        out = []
        for part in batch.to_pylist():
            if found is None or found.conv_id != part["conv_id"]:
                if found is not None:
                    out.append(found.result())
                found = _Repaired(grammar, part["conv_id"])
            if part["kind"] == 0:
                found.measure(part)
            else:
                found.read(part["symbols"], part["roles"], part["texts"])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if found is not None:
        yield pa.RecordBatch.from_pylist([found.result()], schema)


def repaired_conversations(conversations: DataFrame, most_rules: int = MOST_RULES) -> DataFrame:
    """One row per conversation: faults, the cost and letters of its cheapest edits, and the digest of what they leave.

    ``audit`` has a letter per edit in order: Keep, Rerole, Delete, Insert; the ASCII-least of the cheapest.
    Conversations that lie within a task are finished there. The segments of the others meet by
    conversation: their matrices first, then their texts, which one task streams, as a digest is made
    in order.
    """
    parts = segments(conversations)
    grammar = learned_grammar(parts, most_rules)
    schema = StructType([parts.schema["conv_id"], *StructType.fromDDL(_RESULT)])
    arrow, rules = _arrow_schema(schema), grammar.rules
    whole = parts.where("within").mapInArrow(lambda batches: _whole(batches, rules, arrow), schema)
    split = parts.where("NOT within")
    nothing = F.array().cast("array<string>")
    measures = split.withColumns({"kind": F.lit(0), "roles": nothing, "texts": nothing})
    stream = measures.unionByName(split.withColumn("kind", F.lit(1)))
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "number")
    return whole.unionByName(stream.mapInArrow(lambda batches: _joined(batches, rules, arrow), schema))
