import hashlib
import itertools
import math
import random

from pyspark.sql import functions as F

from advigil.operators import clustering, duplicates, enrichment, queue, reviews, rules, support
from advigil.operators.ordering import numbered_by_group
from advigil.schemas import REPORT, SIGNAL

REPORTS = REPORT


def signal(sid, drug="D", event="E", count=10, prr=3.0, ror=2.0, trend=None, risk=None, level=None, status="candidate", version=None):
    return (sid, drug, event, count, prr, ror, trend, risk, level, status, version)


def signals(spark, *rows):
    return spark.createDataFrame(list(rows), SIGNAL)


def report(rid, drug="D", events=("E",), age=30.0, sex="F", date="2026-01-01", quarter="2026Q1"):
    return (rid, drug, list(events), age, sex, date, "Unknown", [], quarter, "FDA_FAERS")


def test_ranking(spark):
    rows = [
        signal("a", risk=0.5, trend=0.1, version="Q1"), signal("b", risk=0.5, trend=0.2, version="Q1"),
        signal("c", risk=0.9, version="Q1"), signal("d", version="Q1"), signal("e", risk=0.5, trend=0.1, count=11, version="Q1"),
        signal("f", drug="a", risk=0.5, trend=0.1, version="Q1"), signal("g", risk=0.1), signal("h", risk=0.2),
    ]
    found = {r.signal_id: r["rank"] for r in enrichment.rank_signals(signals(spark, *rows)).collect()}
    assert found == {"c": 1, "b": 2, "e": 3, "f": 4, "a": 5, "d": 6, "h": 1, "g": 2}


def test_numbering_of_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else f"g{rng.randrange(5)}", rng.randrange(50), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    out = numbered_by_group(df, "g", [F.desc("v"), F.asc("i")], "n").collect()
    for g, members in itertools.groupby(sorted(rows, key=lambda r: (r[0], -r[1], r[2])), key=lambda r: r[0]):
        expected = {r[2]: n for n, r in enumerate(members, 1)}
        assert {r.i: r.n for r in out if r.g == g} == expected


def test_enrichment_keeps_inputs(spark):
    s = signals(spark, signal("a", prr=3.5, ror=2.8, count=50), signal("b", prr=3.5, ror=2.8, count=50))
    metrics = spark.createDataFrame(
        [("a", 50.0, 3.0, 2.5, [("2025Q1", 25.0), ("2025Q2", 40.0), ("2025Q3", 55.0)])],
        "signal_id string, chi_square double, prr_lower double, ror_lower double, trend_data array<struct<quarter:string,count:double>>")
    found = {r.signal_id: r for r in enrichment.enrich_signals(s, metrics).collect()}
    assert found["a"].trend_score == 0.375 and found["b"].trend_score is None
    assert found["a"].risk_score == round(0.4 * 3 / 20 + 0.25 * math.log1p(50) / 7 + 0.1 + 0.15 * 2.5 / 20, 6)
    assert (found["a"].prr, found["a"].ror, found["a"].supporting_report_count) == (3.5, 2.8, 50)
    summary = enrichment.enrichment_summary(enrichment.enrich_signals(s, metrics)).first()
    assert summary.total == 2 and summary.with_trend_score == 1 and summary.priority_none == 0


def test_support_and_quality(spark):
    rs = spark.createDataFrame(
        [report("1"), report("2", age=None), report("3", sex=None, date=" "), report("4", quarter="2025Q4"), report("5", drug="X"), report("6", events=["OTHER"])], REPORTS)
    s = signals(spark, signal("all", event="e"), signal("now", version="2026Q1"), signal("none", drug="Z", count=7))
    series = {r.signal_id: [(p.quarter, p["count"]) for p in r.trend_data] for r in support.trend_series(s, rs).collect()}
    assert series == {"all": [("2025Q4", 1.0), ("2026Q1", 3.0)], "now": [("2026Q1", 3.0)], "none": []}
    q = {r.signal_id: r for r in support.case_quality(s, rs).collect()}
    assert (q["all"].total_reports, q["all"].missing_age_count) == (4, 1)
    assert q["all"].quality_flags == ["minor_missing_age"] and q["all"].indicators[0].description == "25% of reports are missing patient age."
    assert q["all"].quality_score == round(1 - (0.25 * 0.3 + 0.25 * 0.3 + 0.25 * 0.4), 2)
    assert q["now"].quality_flags == ["high_missing_age", "high_missing_sex", "high_missing_date"]
    assert (q["none"].total_reports, q["none"].quality_score) == (7, 1.0)
    page = support.supporting_reports_page(support.supporting_reports(s, rs), page=2, page_size=3).collect()
    assert [(r.signal_id, r.report_id) for r in page] == [("all", "4")]


def test_event_named_twice_counts_once(spark):
    rs = spark.createDataFrame([report("1", events=["E", "e"])], REPORTS)
    assert support.supporting_reports(signals(spark, signal("s")), rs).count() == 1


def test_duplicate_blocks_of_any_size(spark):
    block = [f"r{i:03d}" for i in range(80)]
    rs = spark.createDataFrame(
        [report(r) for r in block] + [report("x1", age=40.0, sex=" m"), report("x2", age=40.0, sex="M"), report("y", age=None), report("z", sex="")], REPORTS)
    s = signals(spark, signal("s"))
    pairs = duplicates.duplicate_candidates(s, rs)
    assert {(r.report_id_a, r.report_id_b) for r in pairs.collect()} == {(block[0], b) for b in block[1:]} | {("x1", "x2")}
    # All pairs of both blocks are counted, though only the first report's are listed.
    count = len(list(itertools.combinations(block, 2))) + 1
    assert duplicates.duplicate_counts(s, rs).first().duplicate_count == count
    assert duplicates.candidate_summary(pairs).first().duplicate_count == count
    assert {r.report_id for r in duplicates.duplicate_groups(s, rs).collect()} == set(block) | {"x1", "x2"}
    text = pairs.filter("report_id_a = 'x1'").first().rationale
    assert "patient age 40, sex 'M', and event date 2026-01-01." in text


def test_facts_sample_all_duplicates(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "TILE", 3)
    ids = [f"r{i:02d}" for i in range(11)]
    rs = spark.createDataFrame([report(r) for r in ids] + [report(f"x{i}", drug="B") for i in range(3)], REPORTS)
    s = signals(spark, signal("s"), signal("t", drug="B", event="E"))
    found = duplicates.generated_candidates(s, rs, whole=True)
    rows = [(r.signal_id, r.report_id_a, r.report_id_b) for r in found.collect()]
    every = [("s", a, b) for a, b in itertools.combinations(ids, 2)] + [("t", f"x{a}", f"x{b}") for a, b in itertools.combinations(range(3), 2)]
    assert sorted(rows) == sorted(every)
    shown = {r.signal_id: (r.duplicate_count, [d.candidate_id for d in r.duplicates]) for r in duplicates.candidate_summary(found).collect()}
    named = {x: sorted("DUP-" + hashlib.sha256("|".join(row).encode()).hexdigest()[:12].upper() for row in every if row[0] == x) for x in "st"}
    assert shown == {x: (len(named[x]), named[x][:3]) for x in "st"}


def test_stored_duplicates_win(spark):
    rs = spark.createDataFrame([report("1"), report("2")], REPORTS)
    s = signals(spark, signal("s"), signal("t", event="E"))
    generated = duplicates.generated_candidates(s, rs).drop("block_size")
    stored = generated.filter("signal_id = 's'").withColumn("status", F.lit("stored"))
    out = {(r.signal_id, r.status) for r in duplicates.duplicate_candidates(s, rs, stored).collect()}
    assert out == {("s", "stored"), ("t", "potential_duplicate")}
    assert duplicates.first_candidates(generated, 1).count() == 2


def test_rules(spark):
    s = signals(spark, signal("a", prr=3.0, count=10, trend=0.8, risk=0.72, level="high"), signal("b", prr=1.0, count=1, status="closed"))
    q = spark.createDataFrame([("a", 0.95, ["high_missing_age"]), ("b", 0.9, [])], "signal_id string, quality_score double, quality_flags array<string>")
    found = {r.signal_id: r for r in rules.regulatory_impact(s, q).collect()}
    assert [m.rule_id for m in found["a"].rule_matches] == ["REG-001", "REG-002", "REG-003", "REG-004", "REG-005"]
    texts = [m.condition_matched for m in found["a"].rule_matches]
    assert texts[0] == "PRR=3.00 (>= 2.5) with 10 supporting reports (>= 10)."
    assert texts[2] == "Priority Level='high' and Risk Score=0.72 (>= 0.70)"
    assert texts[4] == "Quality Flags=['high_missing_age']"
    assert [a.priority for a in found["a"].review_areas] == ["high", "high", "high", "medium", "medium"]
    assert found["b"].rule_matches == [] and found["b"].review_areas == []


def test_queue(spark):
    s = signals(spark, signal("a", drug="ASPIRIN", risk=0.1), signal("b", drug="100% PURE", prr=9.0, risk=0.9), signal("c", drug="IBUPROFEN", status="closed"))
    assert [r.signal_id for r in queue.queue_filters(s, drug=" 0% ").collect()] == ["b"]
    assert {r.signal_id for r in queue.queue_filters(s, min_prr=4.0).collect()} == {"b"}
    assert [r.signal_id for r in queue.queue_page(s, "risk_score", True).collect()] == ["b", "a", "c"]
    assert [r.signal_id for r in queue.queue_page(s, "risk_score", False, page=2, page_size=2).collect()] == ["c"]
    assert tuple(queue.queue_total(s, 2).first()) == (3, 2, 2)
    assert queue.queue_total(s.limit(0)).first().pages == 1


def test_drug_search_falls_back_only_when_empty(spark):
    rs = spark.createDataFrame([report("1", drug="ZETA"), report("2", drug="ALPHA")], REPORTS)
    s = signals(spark, signal("a", drug="ALPHA"))
    assert [tuple(r) for r in support.drug_search(s, rs, "a").collect()] == [("ALPHA", 1)]
    assert [tuple(r) for r in support.drug_search(s, rs, "zet").collect()] == [("ZETA", 0)]


def test_clusters(spark):
    s = signals(
        spark, signal("s1", "A", "X", 500, 12.0, 12.0, risk=0.9), signal("s2", "A", "Y", 5, 2.0, 2.0, risk=0.1),
        signal("s3", "B", "X", 480, 11.0, 11.5, risk=0.85), signal("s4", "C", "Y", 6, 2.1, 2.2, risk=0.12),
        signal("s5", "D", "Z", 7, 2.2, 2.0, risk=0.15), signal("s6", "D", "W", 5, 2.0, None, risk=0.1))
    assert clustering.group_by_drug(s).filter("drug_name = 'A'").count() == 2
    members = clustering.feature_clusters(s, 2)
    sides = {}
    for r in members.collect():
        sides.setdefault(r.cluster_id, set()).add(r.signal_id)
    assert {frozenset(x) for x in sides.values()} == {frozenset({"s1", "s3"}), frozenset({"s2", "s4", "s5", "s6"})}
    sizes = {r.size: r.centroid_prr for r in clustering.cluster_centroids(members).collect()}
    assert sizes[2] == 11.5
    assert clustering.feature_clusters(s.limit(1)) is None
    assert [clustering.cluster_count(n) for n in (2, 18, 1000)] == [2, 3, 8] and clustering.cluster_count(3, 9) == 3


def test_reviews(spark):
    from advigil.schemas import REVIEW

    s = signals(spark, signal("a"), signal("b"))
    empty = spark.createDataFrame([], REVIEW)
    assert {r.review_status for r in reviews.review_join(s, empty).collect()} == {"not_started"}
    update = spark.createDataFrame(
        [("a", "in_review", (True, True, False, False, False, False), "n", ""), ("zz", "reviewed", None, "", "")],
        "signal_id string, review_status string, evidence_checklist " + REVIEW["evidence_checklist"].dataType.simpleString() + ", reviewer_notes string, reviewer_conclusion string")
    saved = reviews.save_reviews(empty, update, s).cache()
    assert [r.signal_id for r in saved.collect()] == ["a"] and saved.first().review_id.startswith("REV-")
    again = reviews.save_reviews(saved, update.withColumn("reviewer_notes", F.lit("m")), s).first()
    assert again.review_id == saved.first().review_id and again.reviewer_notes == "m"
    assert reviews.review_join(s, saved).filter("signal_id = 'a'").first().items_done == 2
