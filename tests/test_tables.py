import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from advigil import fixed_values as V
from advigil.operators.duplicates import store_candidates
from advigil.plans import table_jobs as jobs
from advigil.plans.detection_job import run_detection
from advigil.plans.enrichment_job import run_enrichment
from advigil.schemas import RAW, RELEASE, REPORT, SIGNAL_STORED
from advigil.sinks import tables
from advigil.streaming.arrivals import ingest_arrivals
from advigil.streaming.report_files import arriving_rows, stream_report_files, streamed_table


def write(folder, name, header, rows):
    path = Path(folder) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(["$".join(header), *["$".join(r) for r in rows]]) + "\n")
    return str(path)


def short_files(folder, n, suffix="26Q1"):
    """Files with only the columns the lenient ingest reads."""
    ids = [f"R{i:03d}" for i in range(n)]
    write(folder, f"DEMO{suffix}.txt", ["primaryid", "caseid", "age", "age_cod", "sex", "event_dt"], [[i, i, "34", "801", "1", "20260101"] for i in ids])
    write(folder, f"DRUG{suffix}.txt", ["primaryid", "caseid", "drug_seq", "role_cod", "drugname"], [[i, i, "1", "PS", "drug a"] for i in ids])
    write(folder, f"REAC{suffix}.txt", ["primaryid", "caseid", "pt"], [[i, i, t] for i in ids for t in ("pain", "rash", "Pain")])
    write(folder, f"OUTC{suffix}.txt", ["primaryid", "caseid", "outc_cod"], [[ids[0], ids[0], "HO"]])
    return ids


def test_ingest_resume_and_refusal(spark, folder):
    ids = short_files(f"{folder}/files", 7)
    store = jobs.Store(f"{folder}/store")
    files = jobs.quarter_frames(spark, f"{folder}/files")
    built = jobs.ingest_reports(files["DEMO"], files["DRUG"], files["REAC"], files["OUTC"], "2026Q1")
    built.filter("report_id < 'R003'").write.partitionBy("report_quarter").parquet(store.reports)
    jobs.ingest_quarter(spark, f"{folder}/files", "2026q1", store)
    reports = spark.read.schema(REPORT).parquet(store.reports)
    assert sorted(r.report_id for r in reports.collect()) == ids
    first = reports.filter("report_id = 'R000'").first()
    assert (first.reactions, first.patient_age, first.patient_sex, first.seriousness) == (["PAIN", "RASH"], 34.0, "M", "Serious")
    assert reports.filter("seriousness = 'Unknown'").count() == 6
    pairs = {(r.event_name, r["count"]) for r in spark.read.parquet(store.pairs).collect()}
    assert pairs == {("PAIN", 7), ("RASH", 7)}
    assert spark.read.schema(RELEASE).parquet(store.releases).first().total_reports == 7
    loads = {r.kind: (r["rows"], r.short_rows) for r in spark.read.parquet(store.loads).collect()}
    assert loads == {"DEMO": (7, 0), "DRUG": (7, 0), "REAC": (21, 0), "OUTC": (1, 0)}
    with pytest.raises(jobs.AlreadyImportedError):
        jobs.ingest_quarter(spark, f"{folder}/files", "2026Q1", store)


def test_stream_handles_each_marker_once(spark, folder):
    store = jobs.Store(f"{folder}/store")
    short_files(f"{folder}/landing/2026Q1", 3)
    ready = Path(folder) / "landing/ready"
    ready.mkdir(parents=True)
    (ready / "a.ready").write_text("2026Q1\n")

    def run():
        query = ingest_arrivals(spark, f"{folder}/landing", store, f"{folder}/progress")
        query.awaitTermination()

    run()
    short_files(f"{folder}/landing/2026Q2", 2, "26Q2")
    (ready / "b.ready").write_text("2026q2\n2026Q1\n")
    run()
    run()
    releases = spark.read.schema(RELEASE).parquet(store.releases).collect()
    assert {(r.release_id, r.total_reports) for r in releases} == {("2026Q1", 3), ("2026Q2", 2)} and len(releases) == 2
    assert spark.read.parquet(store.pairs).agg(F.sum("count")).first()[0] == 10


def test_backfill(spark, folder):
    store = jobs.Store(f"{folder}/store")
    rows = [(f"B{i}", "D", ["E"], None, None, None, "Unknown", [], "2026Q1", "FDA_FAERS") for i in range(9)]
    other = [("B0", "D", ["E"], None, None, None, "Unknown", [], "2025Q4", "FDA_FAERS")]
    spark.createDataFrame(rows + other, REPORT).write.partitionBy("report_quarter").parquet(store.reports)
    outcomes = [[f"B{i}", f"B{i}", c] for i, c in enumerate(["DE", "LT", "HO", "DS", "CA", "RI", "OT", "ZZ"])] + [["B0", "B0", " ho "]]
    write(f"{folder}/files", "outc26q1.txt", V.OUTC_COLUMNS, outcomes)
    first = jobs.backfill_seriousness(spark, f"{folder}/files", "2026q1", store).first()
    assert tuple(first) == (9, 8, 7, 1, 1)
    second = jobs.backfill_seriousness(spark, f"{folder}/files", "2026Q1", store).first()
    assert tuple(second) == (9, 0, 7, 1, 1)
    stored = {(r.report_id, r.report_quarter): r for r in spark.read.schema(REPORT).parquet(store.reports).collect()}
    assert stored["B0", "2026Q1"].seriousness_codes == ["DE", "HO"] and stored["B0", "2025Q4"].seriousness == "Unknown"
    with pytest.raises(ValueError):
        jobs.backfill_seriousness(spark, folder, "2026-1", store)


def stored_signal(sid, status="candidate", prr=3.0, notes=None, event="E"):
    return (sid, "D", event, 5, prr, None, None, None, "low", status, "2026Q1", 1, notes)


def test_signal_import(spark, folder):
    existing = spark.createDataFrame([stored_signal("a", notes=["kept"]), stored_signal("b")], SIGNAL_STORED)
    existing.write.parquet(f"{folder}/v1")
    batch = spark.createDataFrame(
        [stored_signal("a", "closed"), stored_signal("a", "under_review"), stored_signal("c"), stored_signal("d", event=""),
         stored_signal("e", prr=float("inf")), stored_signal("f", status="open")], SIGNAL_STORED).drop("known_limitations")
    batch = batch.coalesce(1).withColumn("_pos", F.monotonically_increasing_id())
    counters = jobs.import_signals(spark, batch, f"{folder}/v1", f"{folder}/v2")
    assert tuple(counters.first()) == (6, 3, 3, 3)
    merged = {r.signal_id: r for r in spark.read.parquet(f"{folder}/v2").collect()}
    assert set(merged) == {"a", "b", "c"} and merged["a"].candidate_status == "under_review" and merged["a"].known_limitations == ["kept"]
    jobs.import_signals(spark, batch, f"{folder}/v1", f"{folder}/v3", dry_run=True)
    assert not Path(f"{folder}/v3").exists()


def test_report_upsert_touches_its_quarters_only(spark, folder):
    def row(rid, drug, quarter, source):
        return (rid, drug, ["E"], None, None, None, "Unknown", [], quarter, source)

    path = f"{folder}/reports"
    tables.upsert_reports(spark, path, spark.createDataFrame([row("1", "D", "2026Q1", "x"), row("1", "E", "2026Q1", "x"), row("2", "D", "2025Q4", "x")], REPORT), REPORT)
    old = {p.name for p in Path(f"{path}/report_quarter=2025Q4").glob("*.parquet")}
    tables.upsert_reports(spark, path, spark.createDataFrame([row("1", "D", "2026Q1", "y"), row("3", "D", "2026Q1", "y")], REPORT), REPORT)
    found = {(r.report_id, r.drug_name, r.source) for r in spark.read.schema(REPORT).parquet(path).collect()}
    assert found == {("1", "D", "y"), ("1", "E", "x"), ("3", "D", "y"), ("2", "D", "x")}
    assert {p.name for p in Path(f"{path}/report_quarter=2025Q4").glob("*.parquet")} == old
    # A report that comes with another quarter leaves its old one, and the larger of two equal keys stays.
    tables.upsert_reports(spark, path, spark.createDataFrame([row("2", "D", "2026Q1", "z"), row("2", "D", "2026Q1", "w")], REPORT), REPORT)
    found = [(r.report_id, r.drug_name, r.report_quarter, r.source) for r in spark.read.schema(REPORT).parquet(path).collect()]
    assert sorted(found) == [("1", "D", "2026Q1", "y"), ("1", "E", "2026Q1", "x"), ("2", "D", "2026Q1", "z"), ("3", "D", "2026Q1", "y")]


def full(kind, **cells):
    return [cells.get(c, "") for c in RAW[kind].names]


def test_detection_and_enrichment_of_files(spark, folder):
    reports = [("D1", "E1")] * 8 + [("D1", "E2")] * 4 + [("D2", "E1")] * 3 + [("D2", "E2")] * 9
    rows = {"DEMO": [], "DRUG": [], "REAC": [], "OUTC": []}
    for i, (drug, event) in enumerate(reports):
        key = {"primaryid": f"{i}1", "caseid": str(i)}
        rows["DEMO"].append(full("DEMO", **key, caseversion="1", age="30", age_cod="YR", sex="F", event_dt="20260101"))
        rows["DRUG"].append(full("DRUG", **key, drug_seq="1", role_cod="PS", drugname=f"{drug.lower()}."))
        rows["REAC"].append(full("REAC", **key, pt=event))
        rows["OUTC"].append(full("OUTC", **key, outc_cod="HO"))
    rows["DEMO"].append(full("DEMO", primaryid="old", caseid="0", caseversion="0"))
    for kind, lines in rows.items():
        write(f"{folder}/in", f"{kind}26Q1.txt", RAW[kind].names, lines)
    done = [run_detection(spark, f"{folder}/in", "2026Q1", f"{folder}/out{n}") for n in (1, 2)]
    signals = spark.read.parquet(done[0].signals).collect()
    assert {(s.drug_name, s.event_name, s.supporting_report_count) for s in signals} == {("D1", "E1", 8), ("D2", "E2", 9)}
    stages = {r.stage: r.rows for r in spark.read.json(done[0].reconciliation).collect()}
    assert stages["raw_demo_rows"] == 25 and stages["cases_after_version_handling"] == 24 and stages["unique_pairs"] == 24
    manifest = json.loads(next(Path(done[0].manifest).glob("part-*.json")).read_text())
    assert manifest["counts"]["candidates"] == 2 and manifest["inputs"]["files"] == 4 and manifest["inputs"]["loaded_rows"] == 97
    files = spark.read.json(f"{done[0].manifest}_files").collect()
    assert {(r.kind, r.loaded_rows, r.rejected_rows) for r in files} == {("DEMO", 25, 0), ("DRUG", 24, 0), ("REAC", 24, 0), ("OUTC", 24, 0)} and all(r.digest for r in files)
    assert {r.seriousness for r in spark.read.parquet(done[0].reports).collect()} == {"Serious"}
    same = [sorted(map(str, spark.read.parquet(d.metrics).select(sorted(spark.read.parquet(d.metrics).columns)).collect())) for d in done]
    assert same[0] == same[1]
    summary = run_enrichment(spark, f"{done[0].signals}_json", f"{done[0].metrics}_csv", f"{folder}/enriched").first()
    assert (summary.total, summary.with_risk_score, summary.with_trend_score) == (2, 2, 0)
    ranked = {r.signal_id: r["rank"] for r in spark.read.json(f"{folder}/enriched").collect()}
    assert sorted(ranked.values()) == [1, 2]


def test_batches_commit_by_themselves(spark, folder):
    ids = short_files(f"{folder}/files", 40)
    store = jobs.Store(f"{folder}/store")
    incoming = jobs.quarter_reports(spark, f"{folder}/files", "2026Q1")
    started = jobs.ingest_batches(spark, incoming, "2026Q1", store, batch_reports=10)
    assert next(started) == 0
    started.close()
    first = {r.report_id for r in spark.read.schema(REPORT).parquet(store.reports).collect()}
    assert 0 < len(first) < 40 and not jobs.is_imported(spark, store, "2026Q1")
    # A range that was written but not marked is not stored twice.
    started = jobs.ingest_batches(spark, incoming, "2026Q1", store, batch_reports=10)
    second = incoming.filter(jobs._place("report_id").between((1 << 31) // 4, (1 << 31) // 2 - 1))
    second.write.mode("append").partitionBy("report_quarter").parquet(store.reports)
    assert list(started) == [1, 2, 3]
    jobs.ingest_quarter(spark, f"{folder}/files", "2026Q1", store)
    assert sorted(r.report_id for r in spark.read.schema(REPORT).parquet(store.reports).collect()) == ids
    marks = spark.read.parquet(store.batches).collect()
    assert sorted(r.batch for r in marks) == [0, 1, 2, 3] and sum(r.reports for r in marks) == 40
    assert spark.read.schema(RELEASE).parquet(store.releases).first().total_reports == 40


def test_streamed_versions_in_any_order(spark, folder):
    def arrive(quarter, rows):
        suffix = f"{quarter[2:4]}Q{quarter[-1]}"
        for kind in RAW:
            cells = [full(kind, primaryid=i, caseid=c, caseversion=v, drugname="d", role_cod="PS", pt="e") for i, c, v in rows]
            write(f"{folder}/landing/{quarter}", f"{kind}{suffix}.txt", RAW[kind].names, cells + [["cut", "short"]])
        for run in stream_report_files(spark, f"{folder}/landing", f"{folder}/tables", f"{folder}/progress", files_at_once=1):
            run.awaitTermination()

    arrive("2026Q1", [("11", "A", "1"), ("21", "B", "2")])
    arrive("2026Q3", [("13", "A", "10"), ("31", "C", "1")])
    # The second quarter arrives last: its version of A is older, that of B is a tie with a larger report id.
    arrive("2026Q2", [("12", "A", "9"), ("22", "B", "2")])
    newest = streamed_table(spark, f"{folder}/tables", "DEMO").collect()
    assert {(r.caseid, r.primaryid, r.report_quarter) for r in newest} == {("A", "13", "2026Q3"), ("B", "22", "2026Q2"), ("C", "31", "2026Q3")}
    assert len(newest) == 3 and streamed_table(spark, f"{folder}/tables", "DRUG").count() == 6


def test_stored_candidates_grow_by_what_is_new(spark, folder):
    signals = spark.createDataFrame([("s", "D", "E", None), ("t", "D", "F", None)], "signal_id string, drug_name string, event_name string, dataset_version string")

    def report(i, events="E", age=30.0):
        return (i, "D", events.split("|"), age, "F", "2026-01-01", "Unknown", [], "2026Q1", "FDA_FAERS")

    def run(ids, refresh=True):
        return store_candidates(spark, f"{folder}/candidates", signals, spark.createDataFrame([report(i) for i in ids], REPORT), refresh)

    assert run(["3", "4", "5"]) == 2 and run(["3", "4", "5"]) == 0
    assert run(["2", "3", "4", "5"], refresh=False) == 0
    # One row for a new report, also if its id comes first.
    assert run(["2", "3", "4", "5"]) == 1 and run(["2", "3", "4", "5", "9"]) == 1 and run(["2", "3", "4", "5", "9"]) == 0
    rows = spark.read.parquet(f"{folder}/candidates").collect()
    linked = {frozenset((r.report_id_a, r.report_id_b)) for r in rows}
    assert len(linked) == 4 and set().union(*linked) == {"2", "3", "4", "5", "9"} and all(r.report_id_a < r.report_id_b for r in rows)


def test_streamed_cells_are_made_once_a_line(spark, folder, capsys):
    (Path(folder) / "landing" / "2025Q3").mkdir(parents=True)
    arriving_rows(spark, f"{folder}/landing", "DEMO").explain(True)
    plan = capsys.readouterr().out.split("== Physical Plan ==")[0].split("== Optimized Logical Plan ==")[1]
    assert plan.count("split(") == 1
