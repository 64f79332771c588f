import csv
import hashlib
import io
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from advigil import fixed_values as V
from advigil.sinks import files as sink_files
from advigil.sinks import records, runs
from advigil.sources import documents, faers, openfda, signals, split_text

HEAD = "$".join(V.REAC_COLUMNS)


def write(folder, name, text, encoding="utf-8"):
    path = Path(folder) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_scan_counts_bad_rows(spark, folder):
    body = "\n".join(['1$1$"a$b"$', '2$2$short', '3$3$long$x$y', '', '4$4$"say ""hi"""$', '5$5$ok$'])
    path = write(folder, "REAC26Q1.txt", f"{HEAD}\n{body}\n")
    rows = faers.scan_faers_table(spark, path, "REAC").collect()
    assert {(r.primaryid, r.pt, r.drug_rec_act) for r in rows} == {("1", "a$b", ""), ("4", 'say "hi"', ""), ("5", "ok", "")}
    stats = faers.load_stats(faers.read_table_rows(spark, path, "REAC"), "REAC").first()
    assert (stats.scanned_data_lines, stats.loaded_rows, stats.skipped_bad_lines) == (6, 3, 3)
    assert faers.scan_faers_table(spark, path, "REAC").count() == 3


def test_quoted_line_break(spark, folder):
    path = write(folder, "REAC26Q1.txt", f'{HEAD}\n1$1$"two\nlines"$\n2$2$x$\n')
    assert {r.pt for r in faers.scan_faers_table(spark, path, "REAC").collect()} == {"two\nlines", "x"}


def test_header_and_keys(spark, folder):
    with pytest.raises(faers.HeaderError):
        faers.scan_faers_table(spark, write(folder, "a.txt", "primaryid$pt$caseid$drug_rec_act\n"), "REAC")
    with pytest.raises(faers.EmptyFileError):
        faers.scan_faers_table(spark, write(folder, "b.txt", ""), "REAC")
    with pytest.raises(faers.MissingFileError):
        faers.scan_faers_table(spark, f"{folder}/none.txt", "REAC")
    path = write(folder, "c.txt", f"{HEAD}\n1$ $x$\n")
    with pytest.raises(Exception, match="without primaryid or caseid"):
        faers.scan_faers_table(spark, path, "REAC").count()
    with pytest.raises(faers.MissingFileError):
        faers.scan_quarter(spark, folder, "2026Q1")


def test_deleted_cases(spark, folder):
    path = write(folder, "deleted.txt", "1111\n 2222 \n\n1111\n")
    assert {r.caseid for r in faers.scan_deleted_cases(spark, path).collect()} == {"1111", "2222"}


def test_lenient_scan(spark, folder):
    path = write(folder, "ascii/Drug26q1.TXT", ' PRIMARYID$CaseID$role_cod$drugname\n1$1$PS$"quoted\n2$2$SS$x$extra\n3$3\n')
    assert faers.find_quarter_member(spark, folder, "DRUG") == f"file:{path}"
    rows = faers.scan_faers_unquoted(spark, path)
    assert [r.drugname for r in rows.orderBy("_pos").collect()] == ['"quoted', "x", None]
    assert faers.short_rows(rows, "role_cod", "drugname").count() == 1
    with pytest.raises(faers.MissingFileError):
        faers.find_quarter_member(spark, folder, "DRUG", exact="DRUG26Q2.txt")


def test_latin1_fallback(spark, folder):
    path = write(folder, "REAC26Q1.txt", f"{HEAD}\n1$1$Fièvre$\n", "latin-1")
    assert faers.file_encodings(spark, path).first().encoding == "ISO-8859-1"
    assert faers.scan_faers_unquoted(spark, path).first().pt == "Fièvre"


def test_every_file_is_read_in_its_own_encoding(spark, folder):
    write(folder, "REAC26Q1.txt/part-0", f"{HEAD}\n1$1$café я$\n")
    write(folder, "REAC26Q1.txt/part-1", f"{HEAD}\n2$2$Fièvre$\n3$3\n", "latin-1")
    rows = faers.scan_faers_unquoted(spark, f"{folder}/REAC26Q1.txt")
    assert [(r.primaryid, r.pt) for r in rows.orderBy(faers.POS).collect()] == [("1", "café я"), ("2", "Fièvre"), ("3", None)]
    assert tuple(faers.lenient_load_stats(rows, "REAC", "primaryid", "pt").first()) == ("REAC", 3, 1)


def test_signals_json(spark, folder):
    record = {"signal_id": "s", "drug_name": "D", "event_name": "E", "supporting_report_count": 3, "prr": 2.5, "candidate_status": "candidate"}
    array = write(folder, "array.json", json.dumps([record, record], indent=2))
    assert signals.scan_signals_json(spark, array).count() == 2
    lines = write(folder, "lines.json", json.dumps(record) + "\n")
    assert signals.scan_signals_json(spark, lines).first().prr == 2.5
    with pytest.raises(ValueError):
        signals.scan_signals_json(spark, write(folder, "text.json", '"no records"'))


def test_metrics_csv(spark, folder):
    assert signals.scan_metrics_csv(spark, None).count() == 0
    assert signals.scan_metrics_csv(spark, f"{folder}/none.csv").count() == 0
    assert signals.scan_metrics_csv(spark, write(folder, "no_key.csv", "chi_square\n1\n")).count() == 0
    path = write(folder, "m.csv", 'signal_id,chi_square,other,trend_data\ns,nan,1,"[{""quarter"": ""2025Q1"", ""count"": 3}]"\n')
    row = signals.scan_metrics_csv(spark, path).first()
    assert row.chi_square is None and row.prr_lower is None and row.trend_data[0]["count"] == "3"


def test_reports_csv(spark, folder):
    path = write(folder, "r.csv", 'report_id,drug_name,reactions,patient_age,patient_sex\n 1 ,D,a|B|a, ,F\n')
    row = signals.scan_reports_csv(spark, path, "2026Q1").first()
    assert (row.report_id, row.reactions, row.patient_age, row.report_quarter, row.source, row.seriousness) == ("1", ["A", "B"], None, "2026Q1", "FDA_FAERS", "Unknown")


def test_saved_lookups(spark, folder):
    label = {"meta": {"results": {"total": 9}}, "results": [{"openfda": {"brand_name": ["B"], "product_type": ["P", "Q"]}, "warnings": ["w" * 600]}, {}]}
    rows = openfda.flatten_labels(openfda.read_saved(spark, write(folder, "l.json", json.dumps(label, indent=1)), openfda.LABEL_SCHEMA)).collect()
    assert rows[0].total == 9 and rows[0].product_type == "P" and len(rows[0].warnings_preview) == 500 < len(rows[0].warnings) and rows[1].brand_name == []
    event = {"results": [{"safetyreportid": 7, "patient": {"drug": [{"medicinalproduct": "A"}, {}], "reaction": [{"reactionmeddrapt": ""}]}}]}
    row = openfda.flatten_events(openfda.read_saved(spark, write(folder, "e.json", json.dumps(event)), openfda.EVENT_SCHEMA)).first()
    assert (row.total, row.safetyreportid, row.serious, row.drugs, row.reactions) == (1, "7", "", ["A"], [])


def test_documents(spark, folder):
    write(folder, "docs/a.txt", "  " + "é" * 600 + "\n")
    write(folder, "docs/b.txt", "Fièvre", "latin-1")
    (Path(folder) / "docs/c.txt").write_bytes(b"ab\x00c")
    (Path(folder) / "docs/d.txt").write_bytes(b"\x30\x00")
    (Path(folder) / "docs/e.pdf").write_bytes(b"%PDF-1.4")
    (Path(folder) / "docs/f.docx").write_bytes(b"nope")
    write(folder, "docs/g.exe", "x")
    write(folder, "docs/h.txt", "x" * 2000)
    found = {r.filename: r for r in documents.scan_documents_binary(spark, f"{folder}/docs", max_bytes=1500).collect()}
    status = {n: r.status for n, r in found.items()}
    assert status == {"a.txt": "accepted", "b.txt": "accepted", "c.txt": "corrupted", "d.txt": "corrupted", "e.pdf": "accepted", "f.docx": "corrupted", "g.exe": "unsupported_format", "h.txt": "accepted"}
    assert [n for n, r in found.items() if r.over_size] == ["h.txt"] and len(found["h.txt"].extracted_text) == 2000
    assert found["a.txt"].extracted_text == "é" * 600 and len(found["a.txt"].extracted_text_preview) == 500
    assert found["b.txt"].extracted_text == "Fièvre"


def test_contracts(spark):
    from advigil.schemas import SIGNAL

    good = ("s", "D", "E", 3, 2.5, None, None, None, "low", "candidate", None)
    bad = ("t", "D", "E", -1, float("nan"), None, None, None, "urgent", "open", None)
    frame = spark.createDataFrame([good, bad], SIGNAL)
    counts = {r.violation: r.rows for r in records.violation_counts(frame, records.SIGNAL_CONTRACT).collect()}
    assert counts == {"prr is not finite": 1, "priority_level not in value list": 1, "candidate_status not in value list": 1, "supporting_report_count below 0": 1}
    with pytest.raises(Exception, match="not in value list"):
        records.validate_records(frame, records.SIGNAL_CONTRACT, "signals").collect()
    with pytest.raises(records.ContractError):
        records.check_columns(frame.withColumn("extra", F.lit(1)), records.SIGNAL_CONTRACT)
    with pytest.raises(records.ContractError):
        records.check_columns(frame.drop("prr"), records.SIGNAL_CONTRACT)


def test_written_text_keeps_blanks_and_order(spark, folder):
    frame = spark.createDataFrame([(" b ", ["x", "y"]), ("a", [])], "k string, v array<string>")
    sink_files.write_dataset_csv(frame, f"{folder}/out")
    text = "".join(p.read_text() for p in sorted(Path(f"{folder}/out").glob("part-*")))
    assert " b ,x|y" in text
    sink_files.write_records_json(frame.withColumn("n", F.lit(None).cast("string")), f"{folder}/json")
    lines = "".join(p.read_text() for p in Path(f"{folder}/json").glob("part-*"))
    assert '{"k":"a","n":null,"v":[]}' in lines


def test_fingerprints_add_longs(spark, folder):
    """A decimal for every line would take most of the time."""
    path = f"{folder}/lines.txt"
    Path(path).write_text("".join(f"line {i}\n" for i in range(40)))
    found = runs.file_fingerprints(spark, [path])
    hashes = [hashlib.sha256(f"line {i}".encode()).hexdigest() for i in range(40)]
    assert found.first().digest == ":".join(map(str, [40, *(sum(int(h[15 * i : 15 * i + 15], 16) for h in hashes) for i in range(4))]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("as bigint)") >= 4 and "10) as decimal" not in plan


def test_fingerprints(spark, folder):
    import hashlib

    path = write(folder, "x.txt", "one\ntwo\ntwo\n")
    row = runs.file_fingerprints(spark, [path]).first()
    hashes = [hashlib.sha256(x).hexdigest() for x in (b"one", b"two", b"two")]
    sums = [sum(int(h[15 * i : 15 * i + 15], 16) for h in hashes) for i in range(4)]
    assert row.kind == "lines+sha256" and row.digest == ":".join(map(str, [3, *sums]))


def test_every_part_file_needs_the_header(spark, folder):
    write(folder, "REAC26Q1.txt/part-0", f"{HEAD}\n1$1$a$\n")
    write(folder, "REAC26Q1.txt/part-1", "caseid$primaryid$pt$drug_rec_act\n2$1$a$\n")
    with pytest.raises(Exception, match="(?i)header"):
        faers.scan_faers_table(spark, f"{folder}/REAC26Q1.txt", "REAC").collect()


def test_repeated_header_line_is_a_row(spark, folder):
    path = write(folder, "REAC26Q1.txt", f"{HEAD}\n1$1$a$\n{HEAD}\n")
    stats = faers.load_stats(faers.read_table_rows(spark, path, "REAC"), "REAC").first()
    assert (stats.scanned_data_lines, stats.loaded_rows, stats.skipped_bad_lines) == (2, 2, 0)


def test_only_a_missing_path_counts_as_absent(spark, folder):
    assert not faers.path_exists(spark, f"{folder}/nothing") and faers.path_exists(spark, folder)
    with pytest.raises(Exception):
        faers.path_exists(spark, "nosuchfilesystem://x/y")


# --- quotes over lines and splits ----------------------------------------------


def by_csv_module(text):
    """Rows and rejected records as the reader of the standard library gives them."""
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter="$"))[1:]
    return [r for r in rows if len(r) == 4], sum(len(r) != 4 for r in rows)


def read_split(spark, path, bytes_each):
    """Good rows in file order, rejected records and tasks of a read in small splits."""
    known = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in known:
            spark.conf.set(k, str(bytes_each))
        rows = faers.read_table_rows(spark, path, "REAC")
        found = rows.orderBy(faers.POS).collect()
        lines = split_text.text_lines(spark, path).rdd.getNumPartitions()
    finally:
        for k, v in known.items():
            spark.conf.set(k, v)
    names = V.REAC_COLUMNS
    return [[r[c] for c in names] for r in found if r[faers.BAD_ROW] is None], sum(r[faers.BAD_ROW] is not None for r in found), lines


PIECES = ["1", "ab", "", '"', '""', '"x', 'x"', '"a""b"', '"a$b"', '"two\nlines"', '"a"b"c', "$", "\n", "\r\n", '"\n\n"', 'say "hi"']


@pytest.mark.parametrize("seed", range(6))
def test_records_as_the_csv_module_reads_them(spark, folder, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        cells = [f"{i}", f"c{i}", "".join(rng.choice(PIECES) for _ in range(rng.randrange(3))), rng.choice(["", "x", '"q"', '"open'] if seed % 2 else ["", "x"])]
        rows.append("$".join(cells))
    text = HEAD + "\n" + rng.choice(["\n", "\r\n"]).join(rows) + '\n9$9$end"$\n'
    path = write(folder, "REAC26Q1.txt", text)
    good, bad = by_csv_module(text)
    for size in (37, 4096):
        assert read_split(spark, path, size)[:2] == (good, bad)


def test_a_stray_quote_leaves_the_splits_as_they_are(spark, folder):
    body = [f"{i}$c{i}$term {i}$" for i in range(3000)]
    clean = write(folder, "a/REAC26Q1.txt", "\n".join([HEAD, *body, ""]))
    body[1500] = '1500$c1500$"never closed$'
    stray = write(folder, "b/REAC26Q1.txt", "\n".join([HEAD, *body, ""]))
    body[2900] = '2900$c2900$a quote" inside$'
    closed = write(folder, "c/REAC26Q1.txt", "\n".join([HEAD, *body, ""]))
    good, bad, tasks = read_split(spark, clean, 4000)
    assert len(good) == 3000 and bad == 0 and tasks > 10
    assert (len(read_split(spark, stray, 4000)[0]), *read_split(spark, stray, 4000)[1:]) == (1500, 1, tasks)
    # The quote of line 2900 closes the cell; what follows is read again line by line.
    good, bad, same = read_split(spark, closed, 4000)
    assert same == tasks and bad == 0 and len(good) == 1500 + 1 + 99
    assert good[1500][2].startswith("never closed$\n1501$c1501$") and good[1501][0] == "2901"


def test_records_beyond_the_greatest_length_are_rejected(spark, folder, monkeypatch):
    monkeypatch.setattr(split_text, "MOST_CELL_CHARACTERS", 10)
    path = write(folder, "REAC26Q1.txt", f'{HEAD}\n1$1$"{"x" * 30}\n{"y" * 30}"$\n2$2$"a\nb"$\n')
    rows = faers.read_table_rows(spark, path, "REAC")
    assert [(r.primaryid, r.pt, r[faers.BAD_ROW]) for r in rows.orderBy(faers.POS).collect()] == [(None, None, ""), ("2", "a\nb", None)]


def test_quotes_end_with_their_file(spark, folder):
    write(folder, "REAC26Q1.txt/part-0", f'{HEAD}\n1$1$"open\n')
    write(folder, "REAC26Q1.txt/part-1", f"{HEAD}\n2$2$x$\n3$3$y$\n")
    rows = faers.scan_faers_table(spark, f"{folder}/REAC26Q1.txt", "REAC")
    assert [r.primaryid for r in rows.orderBy(faers.POS).collect()] == ["2", "3"]


# --- arrays over splits ----------------------------------------------------------


def test_array_elements_over_splits(spark, folder):
    rng = random.Random(3)
    odd = ["}", "{", "]", "[", '"', "\\", "a,b", "\\\\}", "é", '"}]', "\n"]
    records = []
    for i in range(200):
        text = "".join(rng.choice(odd) for _ in range(rng.randrange(6)))
        records.append({"signal_id": f"s{i}", "drug_name": text, "event_name": "E", "supporting_report_count": i, "prr": i / 8, "nested": [{"q": text}, {"r": [[], {}]}]})
    known = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for indent in (None, 1):
        path = write(folder, f"{indent}.json", json.dumps(records, indent=indent))
        for size in ("101", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", size)
            found = signals.scan_signals_json(spark, path).collect()
            tasks = split_text.text_lines(spark, path, "}").rdd.getNumPartitions()
            spark.conf.set("spark.sql.files.maxPartitionBytes", known)
            spark.conf.set("spark.sql.files.openCostInBytes", str(256 * 1024))
            assert sorted((r.signal_id, r.drug_name, r.supporting_report_count, r.prr) for r in found) == sorted((r["signal_id"], r["drug_name"], r["supporting_report_count"], r["prr"]) for r in records)
            assert (tasks > 50) == (size == "101")


def test_empty_arrays_and_elements_that_do_not_end(spark, folder, monkeypatch):
    assert signals.scan_signals_json(spark, write(folder, "e.json", " [ ]\n")).count() == 0
    monkeypatch.setattr(split_text, "MOST_ELEMENT_CHARACTERS", 50)
    with pytest.raises(ValueError, match="does not end"):
        signals.scan_signals_json(spark, write(folder, "f.json", '[{"signal_id": "' + "x" * 100 + '"}]'))


def test_json_arrays_are_numbered_by_small_splits(spark, folder, monkeypatch):
    """A large split would be sorted by one task; the setting of the session stays."""
    monkeypatch.setattr(split_text, "JSON_SPLIT_BYTES", 4096)
    records = [{"signal_id": f"S{i}", "drug_name": 'a "}[{' + "x" * (i % 50), "event_name": "e", "supporting_report_count": i, "prr": 1.5} for i in range(800)]
    path = write(folder, "signals.json", json.dumps(records))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen, keep = [], split_text.stored
    monkeypatch.setattr(split_text, "stored", lambda df, name, *rest: seen.append((name, keep(df, name, *rest))) or seen[-1][1])
    rows = signals.scan_signals_json(spark, str(path)).collect()
    assert sorted((r.signal_id, r.drug_name, r.supporting_report_count) for r in rows) == sorted((r["signal_id"], r["drug_name"], r["supporting_report_count"]) for r in records)
    assert dict(seen)["json-pieces"].select("start").distinct().count() > 10
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
