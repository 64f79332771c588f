"""Secret scan: base patterns, and probabilistic automata inferred from the credentials they label.

The matches of the base patterns are credentials labelled by kind. From up to ``FIT_VALUES``
distinct values of a kind (least hash first, up to ``FIT_LENGTH`` characters each) a prefix tree
of character classes is built. States whose next characters and ends are statistically
compatible (Hoeffding bound) are merged, which leaves a probabilistic automaton of the format.
Every further candidate in every whole text is scored by all automata; it becomes a span when
it is as likely as the credentials of the kind and likelier than an ordinary word.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from advigil.llm.words import by_document

KINDS = ("assign", "access", "hex")
FIT_VALUES, FIT_LENGTH, LEAST_VALUES = 400, 512, 20
ALPHA = 0.05
LEAST_CANDIDATE = 20
# Standard errors of the mean log probability by which a candidate may fall below its kind.
ERRORS, LEAST_SPREAD = 3.0, 0.1
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{LEAST_CANDIDATE},}}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
# Character classes with their sizes and their shares in ordinary words; other characters stand for themselves.
_CLASSES = {"0": (10, 0.02), "a": (6, 0.30), "z": (20, 0.62), "A": (6, 0.02), "Z": (20, 0.03)}
_OTHER_SHARE = 0.01 / 6
_UNSEEN = 1e-4

Span = tuple[str, int, int]


def _symbol(c: str) -> str:
    if c.isdigit():
        return "0"
    if c.isalpha():
        return ("a" if c <= "f" else "z") if c.islower() else ("A" if c <= "F" else "Z")
    return c


_SYMBOLS = {chr(b): _symbol(chr(b)) for b in range(128)}


def base_spans(text: str | None) -> list[Span]:
    """(kind, start, end) in code points of the base patterns, by start, then kind as listed."""
    text = text or ""
    low = text.lower()
    found: list[Span] = []
    if any(h in low for h in _ASSIGN_HINTS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    for run in _RUN.finditer(text):
        for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
            found += [(kind, run.start() + m.start(), run.start() + m.end()) for m in pattern.finditer(run[0])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Automaton:
    """Deterministic automaton with counts, merged from the prefix tree of a sample."""

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.count, self.final, self.next = [0], [0], [{}]
        for value in values:
            at = 0
            self.count[0] += 1
            for c in value:
                symbol = _SYMBOLS[c]
                step = self.next[at].get(symbol)
                if step is None:
                    step = self.next[at][symbol] = [len(self.count), 0]
                    self.count.append(0)
                    self.final.append(0)
                    self.next.append({})
                step[1] += 1
                at = step[0]
                self.count[at] += 1
            self.final[at] += 1
        self.width = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()
        own = [(self.likelihood(v), len(v)) for v in values if v]
        self.mean = sum(x for x, _ in own) / max(1, len(own))
        self.spread = max(LEAST_SPREAD, math.sqrt(sum((x - self.mean) ** 2 * n for x, n in own) / max(1, len(own))))

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self.width * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, p: int, q: int) -> bool:
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            n, m = self.count[p], self.count[q]
            if not n or not m:
                continue
            if self._differ(self.final[p], n, self.final[q], m):
                return False
            for symbol in self.next[p].keys() | self.next[q].keys():
                a, b = self.next[p].get(symbol), self.next[q].get(symbol)
                if self._differ(a[1] if a else 0, n, b[1] if b else 0, m):
                    return False
                if a and b:
                    stack.append((a[0], b[0]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree below q to p, along p's own steps."""
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            self.count[p] += self.count[q]
            self.final[p] += self.final[q]
            for symbol, (child, n) in self.next[q].items():
                step = self.next[p].get(symbol)
                if step is None:
                    self.next[p][symbol] = [child, n]
                else:
                    step[1] += n
                    stack.append((step[0], child))

    def _merge_all(self) -> None:
        """Kept states grow from the root; a state one step away is merged into the first compatible one or kept."""
        kept = [0]
        while step := self._open_step(kept):
            state = step[0]
            for other in kept:
                if self._compatible(other, state):
                    step[0] = other
                    self._fold(other, state)
                    break
            else:
                kept.append(state)
        self.states = len(kept)

    def _open_step(self, kept: list[int]) -> list[int] | None:
        known = set(kept)
        steps = (self.next[k][s] for k in kept for s in sorted(self.next[k]))
        return next((step for step in steps if step[0] not in known), None)

    def least(self, length: int) -> float:
        """Likelihood that a credential of this length has, but for chance."""
        return self.mean - ERRORS * self.spread / math.sqrt(length)

    def likelihood(self, value: str) -> float:
        """Mean log probability per character; where it ends is left open, as formats are cut."""
        at, total = 0, 0.0
        for c in value:
            symbol = _SYMBOLS[c]
            step = self.next[at].get(symbol)
            total -= math.log(_CLASSES[symbol][0] if symbol in _CLASSES else 1)
            if step is None:
                total += math.log(_UNSEEN)
            else:
                total += math.log(step[1] / self.count[at])
                at = step[0]
        return total / len(value)


def word_likelihood(value: str) -> float:
    """Mean log probability per character of an ordinary word."""
    total = 0.0
    for c in value:
        size, share = _CLASSES.get(_SYMBOLS[c], (1, _OTHER_SHARE))
        total += math.log(share / size)
    return total / len(value)


def learned_spans(text: str | None, base: list[Span], automata: dict[str, Automaton]) -> list[Span]:
    """Candidates beside the base spans that an automaton takes for a credential of its kind."""
    found = []
    for run in _RUN.finditer(text or "") if automata else ():
        start, end = run.span()
        if any(s < end and start < e for _, s, e in base):
            continue
        ordinary = word_likelihood(run[0])
        scored = [(a.likelihood(run[0]), kind) for kind, a in automata.items()]
        fitting = [(score, kind) for score, kind in scored if score >= automata[kind].least(end - start) and score > ordinary]
        if fitting:
            found.append((f"like_{max(fitting)[1]}", start, end))
    return found


def labelled_credentials(docs: DataFrame, most: int = FIT_VALUES) -> DataFrame:
    """(kind, value): distinct values of the base patterns, ``most`` of a kind with the least hash."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = set()
            for text in batch["text"]:
                for kind, start, end in base_spans(text):
                    value = _ASSIGN.fullmatch(text, start, end)[2] if kind == "assign" else text[start:end]
                    if len(value) <= FIT_LENGTH:
                        found.add((kind, value))
            yield pd.DataFrame(sorted(found), columns=["kind", "value"])

    order = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    values = docs.select("text").mapInPandas(rows, "kind string, value string").distinct()
    # Only the first rows of every task go to the window.
    return values.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("kind", "value")


def fit_automata(docs: DataFrame, most: int = FIT_VALUES, least: int = LEAST_VALUES) -> dict[str, Automaton]:
    """An automaton for every kind with at least ``least`` labelled credentials."""
    values: dict[str, list[str]] = {}
    for row in labelled_credentials(docs, most).orderBy("kind", "value").collect():
        values.setdefault(row["kind"], []).append(row["value"])
    return {kind: Automaton(v) for kind, v in values.items() if len(v) >= least}


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def secrets(docs: DataFrame, automata: dict[str, Automaton] | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Base spans are counted per kind and hashed; ``spans`` holds them and the learned ones, by
    start. Null and empty texts have no spans. Repeated rows are reported one by one.
    """
    automata = fit_automata(docs) if automata is None else automata
    order = {k: i for i, k in enumerate((*KINDS, *(f"like_{k}" for k in KINDS)))}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                base = base_spans(text)
                spans = sorted(base + learned_spans(text, base, automata), key=lambda s: (s[1], order[s[0]], s[2]))
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                out.append((doc_id, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            yield pd.DataFrame(out, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return by_document(docs, rows, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
