"""Near duplicates, line dedup and decontamination against brute force."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from advigil.llm import contamination, line_dedup, near_duplicates
from advigil.llm.graph import components
from advigil.llm.queries import op5_line_dedup
from advigil.llm.words import shingles, word_hashes
from edge_tables import BODY, EXTRA, edge_docs, edge_rows, no_docs


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def sets(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def groups_of(nodes, linked):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in linked:
        up[top(a)] = top(b)
    return {n: top(n) for n in nodes}


def copies_with_changes(seed, groups=12, size=6, length=60):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        for _ in range(size):
            changed = list(base)
            for _ in range(rng.randrange(3)):
                changed[rng.randrange(length)] = f"x{rng.randrange(9)}"
            out.append(" ".join(changed))
    return out


def test_words_of_any_text():
    assert word_hashes(None).tolist() == [] and shingles(" .,_ ").tolist() == []
    assert len(word_hashes("Straße, “東京” слово_x")) == 4
    assert (word_hashes("Ab-c AB c")[:2] == word_hashes("ab c")).all()
    assert len(shingles("one two")) == 1 and len(shingles("a b c d e f")) == 2


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "u int, v int")).count() == 0


@pytest.mark.parametrize("tile", [512, 3])
def test_links_and_groups_as_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(near_duplicates, "TILE", tile)
    texts = copies_with_changes(3) + [f"only {i} " + " ".join(f"u{i}_{k}" for k in range(30)) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    classes = defaultdict(list)
    for i, t in enumerate(texts):
        classes[sets(t)].append(i)
    keys = list(classes)
    linked = [(a, b) for k, a in enumerate(keys) for b in keys[:k] if len(a & b) >= 0.8 * len(a | b)]
    count = Counter(x for pair in linked for x in pair)
    top = groups_of(keys, linked)
    least = defaultdict(lambda: 10**9)
    for k in keys:
        least[top[k]] = min(least[top[k]], *classes[k])
    expected = {i: (least[top[k]], count[k]) for k in keys for i in classes[k]}
    assert len(linked) > 10
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates.near_duplicates(docs).collect()}
    assert found == expected
    kept = {r["doc_id"] for r in near_duplicates.without_near_duplicates(docs).collect()}
    assert kept == {v[0] for v in expected.values()}


def test_pruning_bound_is_the_binomial_tail():
    least = near_duplicates.least_matches(0.8, 1e-6)
    assert least == sorted(least) and 0 < least[0] < 24 * 0.8 and least[-1] < 240 * 0.8


def test_near_duplicates_of_edge_tables(spark):
    found = near_duplicates.near_duplicates(edge_docs(spark)).collect()
    assert len(found) == len(edge_rows())
    by_id = defaultdict(set)
    for r in found:
        by_id[r["doc_id"]].add((r["class_id"], r["n_links"], r["group_size"]))
    assert by_id[2] == by_id[1] == {(1, 1, 5)} and by_id[3] == {(1, 1, 5)}
    assert by_id[4] == {(4, 0, 1)} and by_id[5] == {(5, 0, 1)} and by_id[8] == {(7, 0, 2)}
    assert by_id[None] == {(None, 0, 1), (1, 1, 5)}
    kept = near_duplicates.without_near_duplicates(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "4", "5", "None", "6", "7", "9", "50", "100"])
    assert near_duplicates.near_duplicates(no_docs(spark)).count() == 0
    assert near_duplicates.without_near_duplicates(no_docs(spark)).count() == 0


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_as_brute_force(spark):
    rng = random.Random(5)
    lines = [t for t in copies_with_changes(8, groups=8, size=4, length=70)]
    texts = ["\n".join(rng.sample(lines, 5) + [f"own {i} {rng.random()}", ""]) for i in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    norm = lambda x: " ".join(x.lower().split())
    place = {}
    for i, t in enumerate(texts):
        for n, line in enumerate(t.split("\n")):
            if norm(line):
                place.setdefault(norm(line), (i, n))
    # Every pair within the SimHash distance, by the operator's own hashes, and the edit similarity.
    sims = {r["norm"]: r["sim"] for r in (lambda d: d.join(line_dedup.simhashes(d), ["h1", "h2"]))(line_dedup.distinct_lines(docs)).collect()}
    assert set(sims) == set(place)
    keys = sorted(place)
    linked = [
        (a, b) for k, a in enumerate(keys) for b in keys[:k]
        if (sims[a] ^ sims[b]).bit_count() <= 3
        and (edit(a.split(), b.split()) <= 0.2 * max(len(a.split()), len(b.split())) or edit(a, b) <= 0.2 * max(len(a), len(b)))
    ]
    top = groups_of(keys, linked)
    first = {}
    for k in keys:
        first[top[k]] = min(first.get(top[k], (99, 0)), place[k])
    expected = {
        i: [n for n, line in enumerate(t.split("\n")) if norm(line) and first[top[norm(line)]] != (i, n)] for i, t in enumerate(texts)
    }
    assert linked
    found = {r["doc_id"]: r["dropped"] for r in line_dedup.line_report(docs).collect()}
    assert found == {i: ",".join(map(str, v)) for i, v in expected.items()}
    cut = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    for i, t in enumerate(texts):
        assert cut[i] == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in expected[i])


def test_many_hubs_end_with_all_lines_compared(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "_buckets", lambda: line_dedup.F.array(line_dedup.F.lit(1)))
    lines = [" ".join(f"g{g}w{k}" for k in range(40)) + f" tail{v}" for g in range(5) for v in range(4)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    found = line_dedup.similar_lines(line_dedup.stored(line_dedup.distinct_lines(docs), "t"), distance=12)
    assert Counter(Counter(r["root"] for r in found.collect()).values()) == {4: 5}


def test_recall_of_lines_by_edit_similarity_alone(spark, folder, monkeypatch):
    monkeypatch.setattr(line_dedup, "COMMON", 3)
    rng = random.Random(11)
    lines = []
    for n in (5, 9, 14, 14, 32, 32, 64):
        for _ in range(4):
            base = [rng.choice(["the", "of", f"w{rng.randrange(3000)}"]) for _ in range(n)]
            changed = list(base)
            for k in rng.sample(range(n), n // 5):
                changed[k] = f"longer{rng.randrange(10**6)}"
            lines += [" ".join(base), " ".join(changed)]
    spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    same = lambda a, b: edit(a.split(), b.split()) <= max(len(a.split()), len(b.split())) // 5 or edit(a, b) <= 0.2 * max(len(a), len(b))
    top = groups_of(range(len(lines)), [(b, a) for a in range(len(lines)) for b in range(a + 1, len(lines)) if same(lines[a], lines[b])])
    first = {}
    for i in range(len(lines)):
        first.setdefault(top[i], i)
    expected = {i: int(first[top[i]] != i) for i in range(len(lines))}
    assert sum(expected.values()) >= 28
    assert {r["doc_id"]: r["n_dropped"] for r in op5_line_dedup(spark, folder).collect()} == expected


def test_chains_within_a_bucket_are_whole(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "_buckets", lambda: line_dedup.F.array(line_dedup.F.lit(1)))
    # Neighbours differ in 3 of 30 words, lines two apart in 6: too many. Words of different chains share no letters.
    words = ["abcdefgh", "ijklmnop", "qrstuvwx"]
    spelled = lambda chain, changed, k: "".join(words[chain][(int(d) + 4 * changed) % 8] for d in f"{k:05o}")
    lines = [" ".join(spelled(chain, k < 3 * v, k) for k in range(30)) for chain in range(3) for v in range(9)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    found = line_dedup.similar_lines(line_dedup.stored(line_dedup.distinct_lines(docs), "t"), similarity=0.85, distance=63)
    assert Counter(Counter(r["root"] for r in found.collect()).values()) == {9: 3}


def test_lines_of_edge_tables(spark):
    report = {(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in line_dedup.line_report(edge_docs(spark)).collect()}
    assert {(1, 1, 0), (2, 1, 1), (4, 1, 0), (5, 0, 0), (8, 1, 1), (9, 3, 0), (50, 2, 0)} <= report
    kept = line_dedup.dedup_lines(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 2 and 2 not in ids and 8 not in ids and ids[4] == ids[5] == ids[9] == 1
    assert line_dedup.line_report(no_docs(spark)).count() == 0 and line_dedup.dedup_lines(no_docs(spark)).count() == 0


def test_reordered_passages_are_covered(spark):
    test = [f"t{i}" for i in range(30)]
    shuffled = ["x"] + test[20:] + ["y"] + test[:10] + ["z"] + test[10:20]
    half = ["a"] + test[:12] + ["b"]
    items = spark.createDataFrame([(7, " ".join(test)), (8, "too short"), (9, None), (None, "")], "item_id int, text string")
    rows = [(1, " ".join(shuffled)), (2, " ".join(half)), (3, None), (4, ""), (None, " ".join(test))]
    docs = spark.createDataFrame([(i, t, *["q"] * len(EXTRA.split(","))) for i, t in rows], "doc_id bigint, text string, " + ", ".join(f"c{k} string" for k in range(len(EXTRA.split(",")))))
    found = {r["doc_id"]: (r["item_id"], r["covered"], r["tiles"]) for r in contamination.contaminated_pairs(docs, items).collect()}
    assert found == {1: (7, 30, "1:20:10,12:0:10,23:10:10"), None: (7, 30, "0:0:30")}
    assert {r["doc_id"] for r in contamination.without_contamination(docs, items).collect()} == {2, 3, 4}
    few = contamination.contaminated_pairs(docs, items.limit(0))
    assert few.count() == 0 and contamination.contaminated_pairs(no_docs(spark), items).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = [(i, " ".join(f"i{i}w{k}" for k in range(20))) for i in range(12)]
    docs = spark.createDataFrame([(i, "start " + t + " end") for i, t in items], "doc_id bigint, text string")
    table = spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(contamination.contaminated_pairs(docs, table).collect())
    monkeypatch.setattr(contamination.benchmark_blocks, "__defaults__", (300,))
    assert sorted(contamination.contaminated_pairs(docs, table).collect()) == whole and len(whole) == 12


def test_tiles_as_plain_greedy_search():
    import numpy as np

    rng = random.Random(2)
    for _ in range(60):
        text, test = ([rng.randrange(4) for _ in range(n)] for n in (40, 18))
        marked_a, marked_b, expected = set(), set(), []
        while True:
            best = (0, 0, 0)
            for i in range(len(text)):
                for j in range(len(test)):
                    n = 0
                    while i + n < len(text) and j + n < len(test) and text[i + n] == test[j + n] and i + n not in marked_a and j + n not in marked_b:
                        n += 1
                    best = max(best, (n, -i, -j))
            if best[0] < 3:
                break
            n, i, j = best[0], -best[1], -best[2]
            expected.append((i, j, n))
            marked_a |= set(range(i, i + n))
            marked_b |= set(range(j, j + n))
        starts = [(i, j) for i in range(len(text) - 2) for j in range(len(test) - 2) if text[i : i + 3] == test[j : j + 3]]
        assert contamination.tiles(np.array(text), np.array(test), starts, 3) == expected


def test_body_is_one_line():
    assert "\n" not in BODY


def test_line_dedup_leaves_no_superseded_tables(spark, monkeypatch):
    kept, frames = [], line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, name: kept.append((name, frames(df, name))) or kept[-1][1])
    lines = [f"{a} two three four five six seven eight nine {b}" for a in ("one", "other") for b in ("ten", "eleven", "twelve")]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_report(docs, distance=None).collect()}
    assert found == {i: int(i > 0) for i in range(6)}
    left = Counter(name for name, df in kept if Path(df.inputFiles()[0].removeprefix("file://")).exists())
    assert not {"word-blocks", "simhashes", "meeting-rows", "buckets", "near-pairs"} & set(left)
    assert left["lines"] == 1


def test_lines_meet_a_part_of_the_buckets_at_a_time(spark, monkeypatch):
    sizes, frames = [], line_dedup.stored

    def kept(df, name):
        table = frames(df, name)
        sizes.append((name, table.count()))
        return table

    monkeypatch.setattr(line_dedup, "PART_ROWS", 10)
    monkeypatch.setattr(line_dedup, "PART_PAIRS", 3)
    monkeypatch.setattr(line_dedup, "PARTS", 3)
    monkeypatch.setattr(line_dedup, "stored", kept)
    lines = [f"{a} {b}two {b}three {b}four {b}five {b}six {b}seven {b}eight {b}nine {c}" for a in ("one", "other") for b in ("alpha", "bravo", "gamma") for c in ("ten", "eleven")]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_report(docs, distance=None).collect()}
    assert found == {i: int(i not in (0, 2, 4)) for i in range(12)}
    # The first round has a table a part; none holds the rows of all.
    first = [n for name, n in sizes if name == "buckets"][:3]
    assert max(first) < sum(first)
