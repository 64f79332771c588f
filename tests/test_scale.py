"""What keeps the larger jobs linear: shared steps, single evaluation, positions without paths."""

from pathlib import Path

from pyspark.sql import functions as F

from advigil.operators.reports import reports_of_tables, seriousness
from advigil.plans import table_jobs as jobs
from advigil.plans.star_schema import StarSchema
from advigil.schemas import RAW, REPORT
from advigil.sources.faers import read_table_rows, scan_faers_unquoted, table_path
from conftest import SMALL


QUARTER = "2026Q1"


def _write(folder, kind, rows):
    path = Path(table_path(folder, kind, QUARTER))
    path.parent.mkdir(parents=True, exist_ok=True)
    names = RAW[kind].names
    lines = ["$".join(names)] + ["$".join(r.get(n, "") for n in names) for r in rows]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_codes_are_flags_that_are_combined_by_hash(spark):
    rows = [("1", " de"), ("1", "OT"), ("1", "DE"), ("2", "ZZ"), ("3", None), (None, "HO")]
    found = seriousness(spark.createDataFrame(rows, "primaryid string, outc_cod string"))
    assert {(r.primaryid, r.seriousness, tuple(r.seriousness_codes)) for r in found.collect()} == {
        ("1", "Serious", ("DE", "OT")), ("2", "Non-serious", ()), ("3", "Non-serious", ()), (None, "Serious", ("HO",))
    }
    assert "ObjectHashAggregate" not in _plan(found)


def test_names_and_cases_are_worked_out_once(spark):
    s = StarSchema(spark, SMALL)
    plan = _plan(s.stored_reports) + _plan(s.report_events)
    assert "orders.parquet" not in plan
    assert {"stored_cases", "stored_drugs", "stored_events"} <= set(vars(s))
    once = reports_of_tables(s.drug, s.reac, s.cases, s.outc)
    as_rows = lambda df: sorted(map(str, df.select(*once.columns).collect()))
    assert as_rows(s.stored_reports) == as_rows(once)
    pairs = s.pairs.select(F.col("primaryid").alias("report_id"), "drug_name", "event_name")
    assert as_rows_of(pairs) == as_rows_of(s.report_events.select(*pairs.columns))


def as_rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_cells_are_made_once(spark, folder):
    path = _write(folder, "REAC", [{"primaryid": "1", "caseid": "1", "pt": "a"}, {"primaryid": "2", "caseid": "2", "pt": '"b"'}])
    rows = read_table_rows(spark, path, "REAC").filter("_bad is null and primaryid <> ''")
    assert [r.pt for r in rows.orderBy("primaryid").collect()] == ["a", "b"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_positions_hold_the_number_of_a_file(spark, folder):
    kind = [{"primaryid": str(i), "caseid": "1", "pt": "x"} for i in range(5)]
    parts = f"{folder}/parts"
    for n, rows in enumerate((kind[:2], kind[2:])):
        source = Path(_write(f"{folder}/{n}", "REAC", rows))
        Path(parts).mkdir(exist_ok=True)
        (Path(parts) / f"part-{n}.txt").write_bytes(source.read_bytes())
    rows = scan_faers_unquoted(spark, parts)
    assert dict(rows.dtypes)["_pos"] == "struct<file:int,start:bigint,row:bigint>"
    found = [(r.primaryid, r["_pos"].file) for r in rows.orderBy("_pos").collect()]
    assert found == [("0", 0), ("1", 0), ("2", 1), ("3", 1), ("4", 1)]


def test_ids_stored_before_are_read_once_and_reports_are_not_ranged(spark, folder):
    """Ranges of an ingest hold their own reports, also those that a broken run left without a mark."""
    names = [f.name for f in REPORT.fields]
    rows = spark.range(40).select(F.col("id").cast("string").alias("report_id"))
    values = {f.name: F.lit(None).cast(f.dataType) for f in REPORT.fields if f.name != "report_id"} | {"report_quarter": F.lit(QUARTER)}
    incoming = rows.withColumns(values).select(*names)
    store = jobs.Store(f"{folder}/store")
    incoming.filter("report_id < 15").write.partitionBy("report_quarter").parquet(store.reports)
    plans = []
    seen = jobs.stored

    def watched(df, name):
        plans.append((name, _plan(df)))
        return seen(df, name)

    jobs.stored = watched
    try:
        assert list(jobs.ingest_batches(spark, incoming, QUARTER, store, 7)) == [0, 1, 2, 3, 4, 5]
    finally:
        jobs.stored = seen
    assert [name for name, _ in plans] == ["incoming-reports", "existing-reports"]
    assert "rangepartitioning" not in plans[0][1]
    ids = [r.report_id for r in spark.read.parquet(store.reports).select("report_id").collect()]
    assert sorted(ids, key=int) == [str(i) for i in range(40)]


def test_shuffles_of_reports_start_from_many_partitions(spark):
    StarSchema(spark, SMALL)
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) > int(spark.conf.get("spark.sql.shuffle.partitions"))
