import random
import re
from collections import Counter

from pyspark.sql import functions as F

from advigil.operators import cases, pairs, reports
from advigil.operators.contingency import pair_counts

DEMO = "primaryid string, caseid string, caseversion string"
DRUG = "primaryid string, caseid string, drug_seq string, role_cod string, drugname string"
REAC = "primaryid string, caseid string, pt string"


def test_latest_version(spark):
    rows = [("P1", "C1", "1"), ("P2", "C1", "2"), ("P3", "C1", "10"), ("A1", "C2", "1"), ("B2", "C2", "1")]
    kept = cases.latest_case_versions(spark.createDataFrame(rows, DEMO)).collect()
    assert {(r.caseid, r.primaryid) for r in kept} == {("C1", "P3"), ("C2", "B2")}


def test_long_versions_are_not_cut(spark):
    rows = [("P1", "C1", "12345678901"), ("P2", "C1", "99")]
    assert cases.latest_case_versions(spark.createDataFrame(rows, DEMO)).first().primaryid == "P1"


def test_without_versions_nothing_is_removed(spark):
    frame = spark.createDataFrame([("P1", "C1"), ("P2", "C1")], "primaryid string, caseid string")
    assert cases.latest_case_versions(frame).count() == 2
    assert cases.case_version_stats(frame).first().case_version_policy == "no_dedup"


def test_hot_case_is_pruned_before_the_shuffle(spark):
    demo = spark.range(20000).select(
        F.col("id").cast("string").alias("primaryid"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("caseid"),
        (F.col("id") % 7).cast("string").alias("caseversion"),
    )
    latest = cases.latest_case_versions(demo)
    plan = latest._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning(caseid")
    assert plan.index("WindowGroupLimit", exchange) > exchange  # one below the exchange
    best = max((i for i in range(0, 20000, 3)), key=lambda i: (i % 7, i))
    assert latest.filter("caseid = 'hot'").first().primaryid == str(best)


def test_deleted_cases(spark):
    kept = spark.createDataFrame([("P1", "C1", "1"), ("P2", "C2", "1")], DEMO)
    deleted = spark.createDataFrame([("C2",), ("C9",)], "caseid string")
    assert [r.caseid for r in cases.exclude_deleted_cases(kept, deleted).collect()] == ["C1"]
    stats = cases.deleted_case_stats(kept, deleted, apply=True).first()
    assert tuple(stats) == (2, 1, 1)


def small(spark):
    drug = spark.createDataFrame(
        [("R1", "C1", "1", "PS", "Aspirin"), ("R1", "C1", "2", "PS", "aspirin."), ("R1", "C1", "3", "SS", "Other"),
         ("R2", "C2", "1", "PS", "Ibuprofen"), ("R3", "C3", "1", "PS", " . "), ("R4", "C4", "1", "PS", "Gone")], DRUG)
    reac = spark.createDataFrame(
        [("R1", "C1", "Bleeding"), ("R1", "C1", "bleeding "), ("R1", "C1", "Nausea"), ("R3", "C3", "Pain"), ("R4", "C4", "Pain")], REAC)
    kept = spark.createDataFrame([("R1", "C1", "1"), ("R2", "C2", "1"), ("R3", "C3", "1")], DEMO)
    return drug, reac, kept


def test_pairs_of_small_reports(spark):
    drug, reac, kept = small(spark)
    found = pairs.pair_universe(drug, reac, kept).collect()
    assert {(r.primaryid, r.drug_name, r.event_name) for r in found} == {("R1", "ASPIRIN", "BLEEDING"), ("R1", "ASPIRIN", "NAUSEA")}
    counts = pairs.orphan_accounting(drug, reac, kept).first()
    assert tuple(counts) == (2, 2, 1, 1, 1)
    stats = {r.stat: r.value for r in pairs.pair_stats(drug, reac, kept).collect()}
    assert stats["unique_pairs"] == 2 and stats["normalized_drug_names_missing"] == 1 and stats["ps_drug_rows_before_norm"] == 5


def test_audit_lists_a_row_twice_at_most(spark):
    """By its report and its name; pairs are counted without a key."""
    drug, reac, kept = small(spark)
    drug = drug.union(drug.where("primaryid = 'R3'")).union(spark.createDataFrame([(None, "C1", "1", "PS", "Aspirin"), ("R2", "C2", "1", "PS", None)], DRUG))
    reac = reac.union(spark.createDataFrame([(None, "C1", "Pain"), ("R2", "C2", " "), ("R2", "C2", " ")], REAC))
    built = pairs.pair_universe(drug, reac, kept)
    audit = pairs.pair_stats(drug, reac, kept, built)
    assert {r.stat: r.value for r in audit.collect()} == {
        "ps_drug_rows_before_norm": 8, "unique_ps_drugs_after_norm": 2, "normalized_drug_names_missing": 2,
        "reactions_before_norm": 8, "unique_reactions_after_norm": 3, "normalized_reactions_missing": 1,
        "unique_pairs": 2, "pairs_with_missing_drug_name": 0, "pairs_with_missing_reaction": 0,
        "primaryids_in_ps_drugs": 2, "primaryids_in_reactions": 2, "matched_primaryids": 1, "orphan_ps_drugs_primaryids": 1, "orphan_reactions_primaryids": 1,
    }
    assert audit._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2


def test_pairs_need_the_same_case(spark):
    drug = spark.createDataFrame([("R1", "C1", "1", "PS", "a"), ("R1", "C2", "1", "PS", "a"), ("R1", "C2", "2", "PS", "b")], DRUG)
    reac = spark.createDataFrame([("R1", "C1", "x"), ("R1", "C2", "x"), ("R1", "C3", "y")], REAC)
    found = pairs.pair_universe(drug, reac, spark.createDataFrame([("R1", "C1", "1")], DEMO)).collect()
    assert sorted((r.drug_name, r.event_name, r.caseid) for r in found) == [("A", "X", "C1"), ("B", "X", "C2")]


def test_one_shuffle_per_side_without_broadcasts(spark):
    """Report partitioning carries the dedups and the expanding join."""
    drug, reac, kept = small(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = pair_counts(pairs.pair_universe(drug, reac, kept))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan)
    by = {tuple(k.split("#")[0] for k in key.split(", ")) for key in keys}
    # cases by case, everything of a report by report, and the counts by pair
    assert by <= {("caseid",), ("primaryid",), ("drug_name", "event_name")}
    assert ("primaryid",) in by and ("drug_name", "event_name") in by


def test_skewed_reports_match_brute_force(spark):
    """A third of all rows belongs to one report, another third to one drug."""
    rng = random.Random(7)
    drug_rows, reac_rows = [], []
    for i in range(3000):
        report = "hot" if i % 3 == 0 else f"R{rng.randrange(600)}"
        name = f"drug {rng.randrange(40)}" if i % 3 != 1 else "common"
        drug_rows.append((report, report, str(i), rng.choice(["PS", "PS", "SS"]), name))
        reac_rows.append((report, report, f"event {rng.randrange(60)}"))
    drug, reac = spark.createDataFrame(drug_rows, DRUG), spark.createDataFrame(reac_rows, REAC)
    kept = spark.createDataFrame([(r, r, "1") for r in sorted({d[0] for d in drug_rows})], DEMO)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        counts = pair_counts(pairs.pair_universe(drug, reac, kept))
        found = {(r.drug_name, r.event_name): r.a for r in counts.collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    by_report = {}
    for r, _, _, role, name in drug_rows:
        if role == "PS":
            by_report.setdefault(r, (set(), set()))[0].add(name.upper())
    for r, _, pt in reac_rows:
        by_report.setdefault(r, (set(), set()))[1].add(pt.upper())
    expected = Counter((d, e) for ds, es in by_report.values() for d in ds for e in es)
    assert found == dict(expected)


def test_normalized_reports(spark):
    pair_rows = [("R1", "D", "B"), ("R1", "D", "A"), ("R2", "D", "A"), ("R3", "D", "A"), ("R4", "D", "A")]
    p = spark.createDataFrame(pair_rows, "primaryid string, drug_name string, event_name string")
    kept = spark.createDataFrame(
        [(r, 30.0, "F", None, "2026Q1") for r in ("R1", "R2", "R3", "R4")],
        "primaryid string, patient_age double, patient_sex string, event_date string, report_quarter string")
    outc = spark.createDataFrame([("R1", "ho"), ("R1", "DE"), ("R2", "ZZ"), ("R3", " ")], "primaryid string, outc_cod string")
    found = {r.report_id: r for r in reports.normalized_reports(p, kept, outc).collect()}
    assert found["R1"].reactions == ["A", "B"] and found["R1"].seriousness_codes == ["DE", "HO"]
    assert [found[r].seriousness for r in ("R1", "R2", "R3", "R4")] == ["Serious", "Non-serious", "Non-serious", "Unknown"]
    ingest = {r.primaryid: r.seriousness for r in reports.seriousness_ingest(outc).collect()}
    assert ingest == {"R1": "Serious", "R2": "Non-serious"}


def test_first_rows(spark):
    drug = spark.createDataFrame(
        [("R1", "other", "SS", 1), ("R1", "second", "ps", 3), ("R1", "first", "1", 2), ("R2", "only", "C", 5), ("R2", "later", "C", 6), ("R3", " ", "PS", 1)],
        "primaryid string, drugname string, role_cod string, _pos int")
    assert {r.primaryid: r.drug_name for r in reports.primary_drug(drug, "_pos").collect()} == {"R1": "FIRST", "R2": "ONLY"}
    reac = spark.createDataFrame([("R1", "b", 2), ("R1", "a", 3), ("R1", "B ", 1), ("R1", "", 0)], "primaryid string, pt string, _pos int")
    assert reports.reactions_in_order(reac, "_pos").first().reactions == ["B", "A"]
