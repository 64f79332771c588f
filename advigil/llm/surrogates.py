"""PII surrogates: keyed replacements of the same type, format, gender and script.

E-mail addresses, IP addresses, phone, card and identity numbers and personal names are found
in whole texts. Each value is replaced by a keyed permutation over the values of its own form (a
Feistel network over the digits and letters that may change), so that equal values get equal
surrogates everywhere and different values different ones. Known given names are exchanged
within their gender and script; other names keep their pattern of vowels and consonants. A check
over all distinct values of the table finds surrogates that two values share or that
repeat their value; only these values get another salt or a longer form, until none is left.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advigil.llm.graph import stored
from advigil.llm.words import by_document

ROUNDS = 8
MOST_SALTS = 32
# Salts that a value tries in its own form before it gets a longer one.
OWN_SALTS = 4
# Given names by (gender, script).
GIVEN_NAMES = {
    ("f", "latin"): "alice anna barbara carmen clara elena emma ines julia laura lucia maria marie mary nina olivia paula petra rosa sarah sofia".split(),
    ("m", "latin"): "adam carlos daniel david diego erik felix hans jack james jean john jose karl lucas luis marco martin pablo paul peter".split(),
    ("f", "cyrillic"): "анна вера дарья елена ирина мария наталья ольга светлана татьяна".split(),
    ("m", "cyrillic"): "алексей борис виктор дмитрий иван игорь михаил николай павел сергей".split(),
    ("f", "greek"): "άννα ελένη ειρήνη κατερίνα μαρία σοφία".split(),
    ("m", "greek"): "αλέξανδρος γιώργος δημήτρης κώστας νίκος πέτρος".split(),
}
# Titles with the gender they tell; ? tells none.
TITLES = {
    "mr": "m", "mister": "m", "sir": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "don": "m", "господин": "m", "κύριος": "m",
    "mrs": "f", "ms": "f", "miss": "f", "lady": "f", "frau": "f", "madame": "f", "mme": "f", "señora": "f", "sra": "f", "doña": "f", "госпожа": "f", "κυρία": "f",
    "dr": "?", "prof": "?", "professor": "?",
}
# Letters that stand in for each other, by script.
_ALPHABETS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "0123456789")


def _marked_letters() -> tuple[str, ...]:
    """Further lower-case letters with one upper case, as alphabets by script: vowels and others apart."""
    known = set("".join(_ALPHABETS))
    out: dict[str, list[str]] = {"latin vowels": [], "latin": [], "greek": [], "cyrillic": []}
    for c in map(chr, (*range(0xDF, 0x180), *range(0x3AC, 0x3CF), *range(0x430, 0x460))):
        if c not in known and c.islower() and len(c.upper()) == 1 and c.upper().lower() == c:
            script = unicodedata.name(c).split(" ")[0].lower()
            vowel = unicodedata.normalize("NFD", c)[0] in "aeiou" or c in "æœø"
            out["latin vowels" if script == "latin" and vowel else script].append(c)
    return tuple("".join(letters) for letters in out.values())


_ALPHABETS += _marked_letters()
_PLACE = {c: (alphabet, i) for alphabet in _ALPHABETS for i, c in enumerate(alphabet)}
_GIVEN = {name: kind for kind, names in GIVEN_NAMES.items() for name in names}

_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_NUMBERS = (
    ("ip", re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)")),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w+(])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])")),
    ("id", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("card", re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])")),
)
_CAPITALS = re.compile(r"\b[A-ZÀ-ÖØ-ÞА-ЯΑ-ΩΆΈ-Ώ][\w'’-]*\.?(?: [A-ZÀ-ÖØ-ÞА-ЯΑ-ΩΆΈ-Ώ][\w'’-]*)+")
_DIGITS = re.compile(r"\d[\d ().-]{5,}\d")

Entity = tuple[int, int, str, str]


def _number(data: str, n: int) -> int:
    return int.from_bytes(hashlib.blake2b(data.encode("utf-8", "surrogatepass"), digest_size=16).digest()) % n


def permuted(values: list[int], sizes: list[int], key: str) -> list[int]:
    """A keyed permutation of the vectors with ``values[i] < sizes[i]`` (unbalanced Feistel)."""
    if not values:
        return []
    half = (len(values) + 1) // 2

    def packed(v: list[int], s: list[int]) -> tuple[int, int]:
        total, span = 0, 1
        for x, size in zip(v, s):
            total, span = total * size + x, span * size
        return total, span

    (a, span_a), (b, span_b) = packed(values[:half], sizes[:half]), packed(values[half:], sizes[half:])
    for r in range(ROUNDS):
        if r % 2 == 0:
            a = (a + _number(f"{key}|{sizes}|{r}|{b}", span_a)) % span_a
        else:
            b = (b + _number(f"{key}|{sizes}|{r}|{a}", span_b)) % span_b
    out = []
    for total, part in ((b, sizes[half:]), (a, sizes[:half])):
        for size in reversed(part):
            total, x = divmod(total, size)
            out.append(x)
    return out[::-1]


def _exchanged(text: str, key: str, fixed: int = 0) -> str:
    """Letters and digits from position ``fixed`` on permuted within their alphabets; all else kept."""
    at = [i for i, c in enumerate(text) if i >= fixed and c in _PLACE]
    new = permuted([_PLACE[text[i]][1] for i in at], [len(_PLACE[text[i]][0]) for i in at], key)
    out = list(text)
    for i, v in zip(at, new):
        out[i] = _PLACE[text[i]][0][v]
    return "".join(out)


def _luhn(digits: str) -> int:
    doubled = (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits + "0")))
    return -sum(x - 9 if x > 9 else x for x in doubled) % 10


def _email(value: str, key: str) -> str:
    local, _, host = value.partition("@")
    labels = host.split(".")
    keep = 2 if len(labels) > 2 else 1
    own = local + "@" + ".".join(labels[:-keep])
    return _exchanged(own, key) + "." + ".".join(labels[-keep:])


def _ip(value: str, key: str) -> str:
    octets = value.split(".")
    low = [0 if len(o) == 1 else 10 ** (len(o) - 1) for o in octets]
    sizes = [10 if len(o) == 1 else 90 if len(o) == 2 else 156 for o in octets]
    return ".".join(str(v + n) for v, n in zip(permuted([int(o) - n for o, n in zip(octets, low)], sizes, key), low))


def _phone(value: str, key: str) -> str:
    code = re.match(r"\+\d{1,3}(?=[ .(-])", value)
    return _exchanged(value, key, code.end() if code else 0)


def _card(value: str, key: str) -> str:
    digits = re.sub(r"\D", "", value)
    body = _exchanged(digits[:-1], key)
    new = body + str((_luhn(body) + int(digits[-1]) - _luhn(digits[:-1])) % 10)
    fresh = iter(new)
    return "".join(next(fresh) if c.isdigit() else c for c in value)


def _given(value: str, key: str) -> str:
    kind = _GIVEN.get(value)
    if kind is None:
        # The last letter often tells the gender.
        fixed = value[-1:] if any(c in _PLACE for c in value[:-1]) else ""
        return _exchanged(value[: len(value) - len(fixed)], key) + fixed
    names = GIVEN_NAMES[kind]
    turn = sorted(names, key=lambda n: hashlib.blake2b(f"{key}|{n}".encode()).digest())
    return turn[(turn.index(value) + 1) % len(turn)]


_FORMS = {"email": _email, "ip": _ip, "phone": _phone, "card": _card, "id": _exchanged, "given": _given, "family": _exchanged}


def surrogate(kind: str, value: str, key: str, salt: int = 0) -> str:
    """Replacement of a lower-case value; tries again where it would be the value itself."""
    for again in range(4):
        new = _FORMS[kind](value, f"{key}|{kind}|{salt}|{again}")
        if new != value:
            break
    return new


def _longer(kind: str, value: str, key: str) -> str:
    """A value of the kind from a larger form: more letters before a name or an address, octets of three digits."""
    if kind == "ip":
        return ".".join(str(100 + _number(f"{key}|{value}|{i}", 156)) for i in range(4))
    if kind not in ("given", "family", "email"):
        return _FORMS[kind](value, key)
    script = next((a for a in (2, 4) if any(c in _ALPHABETS[a] + _ALPHABETS[a + 1] for c in value)), 0)
    letters = (_ALPHABETS[script + 1 - i % 2] for i in range(6))
    return "".join(a[_number(f"{key}|{value}|{i}", len(a))] for i, a in enumerate(letters)) + (_FORMS[kind](value, key) if any(c in _PLACE for c in value) else "")


def fixed_surrogate(kind: str, value: str, key: str, step: int) -> str:
    """What a value gets at a step of its own: other salts of its form, then longer forms."""
    return surrogate(kind, value, key, step) if step <= OWN_SALTS else _longer(kind, value, f"{key}|{kind}|{step}")


def _cased(new: str, like: str) -> str:
    """``new`` in the upper and lower case of ``like``."""
    if len(new) == len(like):
        return "".join(n.upper() if c.isupper() and len(n.upper()) == 1 else n for n, c in zip(new, like))
    return new.upper() if like.isupper() and len(like) > 1 else new[:1].upper() + new[1:] if like[:1].isupper() else new


def _names(text: str) -> Iterator[Entity]:
    """Given and family names after a title or a known given name, and later mentions of either alone."""
    alone: dict[str, str] = {}
    whole: set[int] = set()
    for m in _CAPITALS.finditer(text):
        words, at = [], m.start()
        for word in m[0].split(" "):
            words.append((at, word))
            at += len(word) + 1
        head = words[0][1].rstrip(".").lower()
        titled = head in TITLES
        parts = words[1:] if titled else words
        parts = [(i, w.rstrip(".'’-")) for i, w in parts]
        if not parts or not titled and (head not in _GIVEN or words[0][1].endswith(".")):
            continue
        known = parts[0][1].lower() in _GIVEN
        first = 1 if known or len(parts) > 1 else 0
        for k, (i, w) in enumerate(parts[: first + 1]):
            if w:
                kind = "given" if k < first else "family"
                yield i, i + len(w), kind, w
                whole.update(range(i, i + len(w)))
                # A word that is both is a given name where it stands alone; one letter alone is a word or a label.
                if len(w) > 1 and alone.get(w) != "given":
                    alone[w] = kind
    for name, kind in alone.items():
        for m in re.finditer(rf"(?<!\w){re.escape(name)}(?!\w)", text):
            if m.start() not in whole:
                yield m.start(), m.end(), kind, name


def entities(text: str | None) -> list[Entity]:
    """(start, end, kind, value as written) without overlaps, by start; of two that overlap the earlier kind stays."""
    text = text or ""
    found: list[Entity] = []
    if "@" in text:
        found += [(*m.span(), "email", m[0]) for m in _EMAIL.finditer(text)]
    if _DIGITS.search(text):
        for kind, pattern in _NUMBERS:
            found += [(*m.span(), kind, m[0]) for m in pattern.finditer(text) if kind != "ip" or all(int(o) < 256 and str(int(o)) == o for o in m[0].split("."))]
    found += _names(text)
    kept: list[Entity] = []
    taken: list[tuple[int, int]] = []
    order = {k: i for i, k in enumerate(_FORMS)}
    for e in sorted(set(found), key=lambda e: (order[e[2]], e[0], -e[1])):
        if not any(s < e[1] and e[0] < t for s, t in taken):
            taken.append((e[0], e[1]))
            kept.append(e)
    return sorted(kept)


def replaced(text: str | None, key: str, salt: int = 0, fixed: dict[tuple[str, str], str] | None = None) -> tuple[str | None, list[Entity]]:
    """``text`` with surrogates and its entities; ``fixed`` has the surrogates of values that have one of their own."""
    found, fixed = entities(text), fixed or {}
    if not found:
        return text, found
    out, at = [], 0
    for start, end, kind, value in found:
        new = fixed.get((kind, value.lower())) or surrogate(kind, value.lower(), key, salt)
        out += [text[at:start], _cased(new, value)]
        at = end
    return "".join([*out, text[at:]]), found


def distinct_values(docs: DataFrame) -> DataFrame:
    """(kind, value) in lower case, each once."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {(kind, value.lower()) for text in batch["text"] for _, _, kind, value in entities(text)}
            yield pd.DataFrame(sorted(found), columns=["kind", "value"])

    return docs.select("text").mapInPandas(rows, "kind string, value string").distinct()


def collisions(values: DataFrame, key: str, salt: int) -> DataFrame:
    """(kind, new) of surrogates that several values share or that repeat their own value."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            new = [surrogate(k, v, key, salt) for k, v in zip(batch["kind"], batch["value"])]
            yield batch.assign(new=new)

    made = values.mapInPandas(rows, "kind string, value string, new string")
    return made.groupBy("kind", "new").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("value") == F.col("new")).cast("int")).alias("same")).where("n > 1 OR same = 1")


def clear_salt(values: DataFrame, key: str) -> int:
    """The first salt under which all values have surrogates of their own."""
    for salt in range(MOST_SALTS):
        if collisions(values, key, salt).isEmpty():
            return salt
    raise ValueError("no salt keeps all surrogates apart: give another key")


def own_surrogates(values: DataFrame, key: str) -> dict[tuple[str, str], str]:
    """Surrogates of the values whose first one repeats the value or is shared with another one.

    Of values that share one the least keeps it. The others try step after step of their own against
    all that is taken. They are few: about one in a form whose values all occur.
    """

    def made(some: DataFrame, step: int) -> DataFrame:
        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(new=[fixed_surrogate(k, v, key, step) for k, v in zip(batch["kind"], batch["value"])])

        return some.select("kind", "value").mapInPandas(rows, "kind string, value string, new string")

    def holders(tried: DataFrame) -> DataFrame:
        """The values that may keep what they tried."""
        return tried.where("value <> new").groupBy("kind", "new").agg(F.min("value").alias("value")).select("kind", "value", "new")

    tried = stored(made(values, 0), "pii-tried")
    taken, fixed, step = stored(holders(tried), "pii-taken"), {}, 0
    pending = stored(tried.join(taken, ["kind", "value"], "left_anti"), "pii-pending")
    while not pending.isEmpty():
        step += 1
        tried = stored(made(pending, step), "pii-tried")
        won = stored(holders(tried.join(taken, ["kind", "new"], "left_anti")), "pii-won")
        fixed |= {(r["kind"], r["value"]): r["new"] for r in won.collect()}
        taken = taken.union(won)
        pending = stored(pending.join(won, ["kind", "value"], "left_anti"), "pii-pending")
    return fixed


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """One row per document: doc_id, text with surrogates, n_entities, entities (kind:start:end, comma-joined).

    Positions are code points of the given text. Null texts stay null, empty ones empty; equal
    values have equal surrogates in all rows, so that repeated rows stay equal.
    """
    fixed = own_surrogates(stored(distinct_values(docs), "pii-values"), key)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [replaced(t, key, fixed=fixed) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "text": [t for t, _ in made],
                    "n_entities": [len(e) for _, e in made],
                    "entities": [",".join(f"{k}:{s}:{t}" for s, t, k, _ in e) for _, e in made],
                }
            )

    return by_document(docs, rows, "text string, n_entities int, entities string")
