"""Conversation repair, vector search and source divergence against brute force and SQL."""

import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from advigil.llm import conversation_repair as repair
from advigil.llm import posting_lists, source_divergence
from conftest import SMALL
from edge_tables import EXTRA, edge_docs, no_docs
from oracle.compare import database, difference


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_source_divergence"])
def test_same_as_sql(spark, name):
    assert difference(entry.queries()[name](spark, SMALL), database(SMALL), entry.oracle_sql()[name]) is None


# --- conversations -----------------------------------------------------------

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, symbols string, part string, kind string, copies string"


def after_damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: ((-1, 0) if r[0] is None else (0, r[0]), r[1], r[2]))


def measured(rows):
    faults, seen = [], set()
    for _, role, text in rows:
        end = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    return faults, {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "blank": faults.count("blank"),
        "duplicate": faults.count("duplicate"),
        "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
    }


def all_edits(rows, faults):
    """Every string of edits with up to two insertions in a row, its cost and what it leaves."""
    for kinds in itertools.product("DKR", repeat=len(rows)):
        if any(k != "D" and f in ("blank", "duplicate") for k, f in zip(kinds, faults, strict=True)):
            continue
        for gaps in itertools.product((0, 1, 2), repeat=len(rows) + 1):
            letters = "I" * gaps[0] + "".join(k + "I" * g for k, g in zip(kinds, gaps[1:], strict=True))
            # A changed or new row may be of either role.
            free = [i for i, x in enumerate(x for x in letters if x != "D") if x in "IR"]
            for roles in itertools.product("ua", repeat=len(free)):
                given, left, row = iter(roles), [], iter(zip(rows, faults, strict=True))
                cost = 0
                for x in letters:
                    if x == "I":
                        cost += 3
                        left.append(({"u": "user", "a": "assistant"}[next(given)], ""))
                        continue
                    (_, role, text), fault = next(row)
                    cost += {"D": 4, "K": 0, "R": 3}[x] + 3 * (x != "D" and fault == "truncated")
                    if x == "K":
                        left.append((role, text))
                    if x == "R":
                        left.append(({"u": "user", "a": "assistant"}[next(given)], text))
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in left)):
                    yield cost, letters, "\n".join(f"{r}:{t}" for r, t in left)


def walked(rows, faults):
    """Cost and edits by a plain walk over the rows."""
    step = {0: 2, 1: 2, 2: 3, 3: 2}

    def inserted(states):
        for _ in range(3):
            for state, (cost, letters) in list(states.items()):
                new = (cost + 3, letters + "I")
                states[step[state]] = min(states.get(step[state], new), new)
        return states

    states = inserted({0: (0, "")})
    for (_, role, _), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, letters) in states.items():
            new = [(state, 4, "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                new.append((step[state], 3 + more, "R"))
                new += [(to, more, "K") for to in (1, 2, 3) if role[:1] == " sua"[to] and (state == 0 if to == 1 else step[state] == to)]
            for to, price, letter in new:
                after[to] = min(after.get(to, (math.inf,)), (cost + price, letters + letter))
        states = inserted(after)
    return min(states[s] for s in (0, 3) if s in states)


def followed(rows, audit):
    """What the edits leave, the roles of changed and new rows by turns."""
    left, row = [], iter(rows)
    for x in audit:
        role, text = (None, "") if x == "I" else next(row)[1:]
        if x != "D":
            begun = len(left) - (bool(left) and left[0][0][:1] == "s")
            left.append((role if x == "K" else ("user", "assistant")[begun % 2], text))
    return "\n".join(f"{r}:{t}" for r, t in left)


def some_conversations(seed, count, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(count):
        for turn in sorted(rng.sample(range(3 * longest), rng.randrange(1, longest + 1))):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None])
            rows.append((conv, turn, role, rng.choice([f"yes {turn}.", "no", "same.", " ", None, f"why {turn}? ", "end!\n"])))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 4) for r in rows], CONVERSATIONS).repartition(5)


def by_conversation(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return out


def test_repairs_as_all_edits(spark):
    rows = some_conversations(1, 60, 3)
    found = {r["conv_id"]: r for r in repair.repaired_conversations(table(spark, rows)).collect()}
    assert set(found) == {r[0] for r in rows}
    for conv, own in by_conversation(rows).items():
        left = after_damage(own)
        faults, counts = measured(left)
        if len(left) > 3:
            continue
        cost, audit, text = min(all_edits(left, faults))
        assert text == followed(left, audit)
        expected = counts | {"conv_id": conv, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}
        assert found[conv].asDict() == expected


@pytest.mark.parametrize("length", [1000, 4])
def test_long_conversations_over_tasks_and_segments(spark, monkeypatch, length):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", length)
    rows = some_conversations(2, 20, 40) + [(99, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(1500)]
    rows += [(98, t // 3, ("user", "assistant")[t % 2], f"line {t % 50}") for t in range(400)]
    found = {r["conv_id"]: r.asDict() for r in repair.repaired_conversations(table(spark, rows)).collect()}
    for conv, own in by_conversation(rows).items():
        left = after_damage(own)
        faults, counts = measured(left)
        cost, audit = walked(left, faults)
        digest = hashlib.sha256(followed(left, audit).encode()).hexdigest()
        assert found[conv] == counts | {"conv_id": conv, "cost": cost, "audit": audit, "repaired_sha256": digest}
    con = duckdb.connect()
    given = table(spark, rows).toPandas()  # noqa: F841 - read by name
    con.execute("CREATE TABLE conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM given")
    con.execute(entry.oracle_sql()["op11_conversation_repair"])
    names = [d[0] for d in con.description]
    for row in con.fetchall():
        assert found[row[0]] == dict(zip(names, row, strict=True))


def test_rules_multiply_to_the_same_matrix():
    rng = random.Random(4)
    rules = repair.Grammar(["ua", "SA", "dd", chr(256) + chr(256), "ad"])
    for n in range(30):
        text = "".join(rng.choice("dsuaoSUAO") for _ in range(n))
        plain = repair.Grammar([]).segment(text)
        shown = [[None if c is None else (c[0], str(c[1])) for c in row] for row in plain]
        assert [[None if c is None else (c[0], str(c[1])) for c in row] for row in rules.segment(text)] == shown


def test_ropes_compare_as_their_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice("DK") for _ in range(rng.randrange(200))) for _ in range(40)]

    def rope(text):
        if len(text) < 3:
            return repair.Rope(text)
        cut = rng.randrange(1, len(text))
        return rope(text[:cut]) + rope(text[cut:])

    for a, b in itertools.product(texts, texts):
        assert (rope(a) < rope(b)) == (a < b) and str(rope(a)) == a


def test_repairs_of_edge_tables(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "gone.")]
    rows += [(None, None, None, None), (None, 5, "user", "a."), (None, 5, "user", "a."), (None, 7, "assistant", "b" * 200_000 + "?")]
    rows += [(7001, None, "assistant", ""), (7001, None, "", "x."), (7001, 9, "User", "y."), (7001, 9, "assistant", "é\x0b.\x0c")]
    found = {r["conv_id"]: r.asDict() for r in repair.repaired_conversations(table(spark, rows)).collect()}
    assert set(found) == {dropped, None, 7001}
    empty = hashlib.sha256(b"").hexdigest()
    assert found[dropped] == dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0) | {"conv_id": dropped, "audit": "", "repaired_sha256": empty}
    for conv, own in by_conversation(rows).items():
        left = after_damage(own)
        faults, counts = measured(left)
        cost, audit = walked(left, faults)
        digest = hashlib.sha256(followed(left, audit).encode()).hexdigest()
        assert found[conv] == counts | {"conv_id": conv, "cost": cost, "audit": audit, "repaired_sha256": digest}
    assert repair.repaired_conversations(table(spark, rows).limit(0)).count() == 0


# --- vectors -----------------------------------------------------------------


def brute_force(rows, k=10, step=100):
    """(query, rank) -> (id, distance) over (id, vector) of equal length."""
    points = np.array([v for _, v in rows], np.float64)
    out = {}
    for at, (query, own) in enumerate(rows):
        if query is None or query % step:
            continue
        far = np.sqrt(((points - np.array(own, np.float64)) ** 2).sum(1))
        order = sorted((far[i], rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if i != at)[:k]
        out[query] = [(None if none else i, d) for d, none, i in order]
    return out


def found_neighbours(frame):
    out = defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return dict(out)


@pytest.mark.parametrize("rows", [40, 200])
def test_recall_against_brute_force(spark, rows):
    folder = "/root/testdata/sf0.1"
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    true = brute_force([(r["vec_id"], r["embedding"]) for r in vectors.collect()])
    found = found_neighbours(posting_lists.nearest_vectors(vectors, list_rows=rows))
    assert set(found) == set(true)
    hits = total = 0
    for query, best in true.items():
        assert len(found[query]) == 10
        known = dict(best)
        for i, d in found[query]:
            assert i not in known or math.isclose(d, known[i], rel_tol=1e-12)
        hits += len({i for i, _ in found[query]} & set(known))
        total += 10
    assert hits / total >= 0.9


def test_memory_of_a_walk_and_of_held_neighbours():
    """Without clusters a walk goes through most lists; neither its differences nor the candidates of many queries pile up."""
    rng = np.random.default_rng(5)
    points = rng.normal(size=(2560, 64))
    points /= np.linalg.norm(points, axis=1)[:, None]
    index = posting_lists.Index.over(points[:2048])
    tracemalloc.start()
    met = index.walk(points[2048:], 1.25)
    _, peak = tracemalloc.get_traced_memory()
    assert peak < 128 << 20 and np.isfinite(met).mean() > 0.9
    exact = np.sqrt(((points[2048:2058, None] - points[None, :2048]) ** 2).sum(2))
    assert np.allclose(met[:10][np.isfinite(met[:10])], exact[np.isfinite(met[:10])])
    nearest, queries = posting_lists._Nearest(11), np.stack([np.arange(4000), rng.integers(0, 1 << 62, 4000)], 1)
    keys = rng.integers(0, 1 << 62, (300, 3))
    tracemalloc.reset_peak()
    before, _ = tracemalloc.get_traced_memory()
    for k in range(0, 4000, 250):
        nearest.compare(queries[k : k + 250], points[rng.integers(300, 2560, 250)], [None, *range(299)], keys, points[:300])
    after, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert after - before < 4000 * 1200
    rows = nearest.batch().to_pylist()
    assert len(rows) == 4000 * 11 and {r["no_id"] for r in rows} == {False, True} and all(r["vec_id"] == 0 for r in rows if r["no_id"])
    assert posting_lists._Nearest(11).batch().num_rows == 0


def test_clusters_need_few_lists_and_boundaries_are_replicated():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 10
    points = centres[rng.integers(40, size=4000)] + rng.normal(size=(4000, 16)) * 0.5
    index = posting_lists.fitted_index(points, 60)
    used = np.ones(len(index.centroids), bool)
    row, home = index.lists(points[:200], 3, used)
    assert len(row) / 200 < 0.15 * len(index.centroids)
    row, home = index.homes(points)
    assert len(points) < len(row) < 3 * len(points) and np.bincount(home).max() < 8 * 60
    # The walk finds the nearest centroid.
    met = index.walk(points[:300], 1.3)
    far = posting_lists._distances(points[:300], index.centroids)
    assert (met.argmin(1) == far.argmin(1)).mean() > 0.98


def test_vectors_of_edge_tables(spark):
    rng = random.Random(6)
    good = [(i, [rng.random() for _ in range(4)]) for i in range(95, 140)]
    good += [(None, [0.5, 0.5, 0.5, 0.5])] + [(1000 + i, [0.25, 0.5, 0.75, 1.0]) for i in range(30)] + [(200, [0.25, 0.5, 0.75, 1.0])]
    bad = [(300, None), (400, [0.0] * 4), (500, [1.0, None, 1.0, 1.0]), (600, [1.0, float("nan"), 1.0, 1.0]), (700, [float("inf"), 1.0, 1.0, 1.0]), (800, [1.0, 2.0]), (900, [])]
    schema = "vec_id bigint, embedding array<double>, label int, copy string, list string, score string"
    frame = spark.createDataFrame([(i, v, 1, "c", "l", "s") for i, v in good + bad], schema).repartition(3)
    for size in (1, 5, 512):
        found = found_neighbours(posting_lists.nearest_vectors(frame, list_rows=size, recall=1.0))
        true = brute_force(good)
        assert set(found) == set(true) == {100, 200, 1000}
        for query in true:
            assert [d for _, d in found[query]] == pytest.approx([d for _, d in true[query]])
            assert [i for i, _ in found[query]] == [i for i, _ in true[query]]
    assert posting_lists.nearest_vectors(frame.limit(0)).count() == 0
    few = frame.where("vec_id IN (100, 101, 102)")
    assert [len(v) for v in found_neighbours(posting_lists.nearest_vectors(few)).values()] == [2]
    alone = frame.where("vec_id = 100")
    assert posting_lists.nearest_vectors(alone).count() == 0
    twice = frame.where("vec_id = 100").union(frame.where("vec_id = 100"))
    assert [r["vec_id"] for r in posting_lists.nearest_vectors(twice).collect()] == [100, 100]


def test_few_vectors_with_very_many_copies(spark, monkeypatch):
    monkeypatch.setattr(posting_lists, "SAMPLE", 70)
    rows = [(i, [1.0, 2.0] if i % 3 else [float(i % 9), 1.0]) for i in range(1, 3001)]
    found = found_neighbours(posting_lists.nearest_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)))
    true = brute_force(rows)
    assert found == true and len(true) == 30


# --- divergence --------------------------------------------------------------


def plain_divergence(rows, least, top=10):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    table_ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, uses, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = term.findall((text or "").translate(table_))
        docs[lang].update(set(terms))
        uses[lang, source].update(terms)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        all_uses = sum((uses[lang, s] for s in sources), Counter())

        def share(counter, kept=kept):
            below = sum(counter[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counter[t] + 2) // below for t in kept}

        p, q = {s: share(uses[lang, s]) for s in sources}, share(all_uses)
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(far(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-far(p[s][t], q[t]), t.encode()) for t in kept if uses[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(sorted(found)[:most], 1)}
    return out


@pytest.mark.parametrize("held, bits", [(400_000, 1 << 16), (5, 64)])
def test_divergence_as_brute_force(spark, monkeypatch, held, bits):
    monkeypatch.setattr(source_divergence, "HELD", held)
    monkeypatch.setattr(source_divergence, "HELD_USES", held)
    monkeypatch.setattr(source_divergence, "LEAST_BITS", bits)
    monkeypatch.setattr(source_divergence, "MOST_BITS", bits)
    rng = random.Random(9)
    words = ["a", "I", "Straße", "слово", "東京東京東京", "prefix", "prefixes", "prefixed", "long" * 30, "long" * 31, "sixsix", "Zebra9zebra", "ÀÉ"]
    words += ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(80)]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "ü", None])) for _ in range(150)]
    rows += [(None, "en", "s9"), ("", "xx", "one"), ("!!", "xx", "two"), ("x" * 100_000, "en", "s1")] + [("y" * 5000, "en", "s2")] * 4
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id int, text string, lang string, source string").repartition(4)
    for least in (4, 10):
        found = source_divergence.divergence(docs, least=least)
        assert {tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect()} == plain_divergence(rows, least)
    assert ("xx", "one", "pair", "two", 0, 1) in {tuple(r) for r in found.collect()}


def test_divergence_of_edge_tables(spark):
    rows = [(r["text"], r["lang"], r["source"]) for r in edge_docs(spark).collect()]
    found = source_divergence.divergence(edge_docs(spark), least=2)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in found.collect()} == plain_divergence(rows, 2)
    assert source_divergence.divergence(no_docs(spark)).count() == 0 and "rank" in EXTRA
