import pytest
from pyspark.sql import functions as F

from advigil.functions import demographics, identifiers, numbers, scores, text, texts

DRUGS = [
    ("aspirin", "ASPIRIN"),
    ("  Albuterol. ", "ALBUTEROL"),
    ("METOPROLOL,", "METOPROLOL"),
    ("drug-a", "DRUG-A"),
    ("a  b\tc", "A B C"),
    (" x　y ", "X Y"),
    ("(PARACETAMOL) 500 mg!", "PARACETAMOL) 500 MG"),
    ("straße", "STRASSE"),
    ("...", None),
    ("   ", None),
    (None, None),
]


def column_of(spark, pairs, function):
    rows = [(i, raw) for i, (raw, _) in enumerate(pairs)]
    out = spark.createDataFrame(rows, "i int, raw string").select("i", function(F.col("raw")).alias("v"))
    return [r.v for r in out.orderBy("i").collect()]


def test_drug_names(spark):
    assert column_of(spark, DRUGS, text.normalize_drug_name) == [x for _, x in DRUGS]


def test_drug_names_are_stable(spark):
    once = [(x, x) for _, x in DRUGS]
    assert column_of(spark, once, text.normalize_drug_name) == [x for x, _ in once]


def test_nameless_drugs_are_found_without_their_names(spark):
    odd = ["", " ", None, " . ", "\u00a0", "\x1c(-)", "\u0131", "\u017f.", "\ufb01", "é", "ß", "É-1", "\n", ".\n", "a\n", "日本", "..7"]
    rows = [(x, x) for x in odd]
    names = [x for x, _ in DRUGS]
    rows += [(x, x) for x in names]
    none = [x is None for x in column_of(spark, rows, text.normalize_drug_name)]
    assert column_of(spark, rows, text.has_no_drug_name) == none


def test_reactions_keep_punctuation(spark):
    pairs = [("Pain.", "PAIN."), (" Skin  rash ", "SKIN RASH"), ("", None), (None, None)]
    assert column_of(spark, pairs, text.normalize_reaction) == [x for _, x in pairs]


def test_numbers(spark):
    pairs = [("1", 1.0), (" 2.5 ", 2.5), ("1e3", 1000.0), ("1d", None), ("inf", None), ("nan", None), ("1e400", None), ("", None), ("-.5", -0.5)]
    assert column_of(spark, pairs, numbers.to_numeric) == [x for _, x in pairs]


def test_dates(spark):
    pairs = [("20260115", "2026-01-15"), ("20260230", None), ("202601", None), ("", None), (" 20251231 ", "2025-12-31"), (None, None)]
    assert column_of(spark, pairs, demographics.parse_event_date) == [x for _, x in pairs]


@pytest.mark.parametrize(
    "age,unit,years",
    [("34", "YR", 34.0), ("6", "mon", 0.5), ("52", "WK", 1.0), ("365.25", "DY", 1.0), ("8766", "HR", 1.0), ("4", "DEC", 4.0), ("4", "", None), ("x", "YR", None), ("1", "DY", 0.0)],
)
def test_age(evaluate, age, unit, years):
    value = demographics.parse_age_years(F.col("a"), F.col("u"))
    assert evaluate(value, "a string, u string", (age, unit)) == years


@pytest.mark.parametrize(
    "age,code,years",
    [("4", "800", 40.0), ("34", "801", 34.0), ("6", "802", 0.5), ("34", "YR", 34.0), ("131", "", None), ("14", "800", None), ("-1", "801", None), ("0", "", None), ("0", "801", 0.0)],
)
def test_age_of_ingest(evaluate, age, code, years):
    value = demographics.normalize_age_ingest(F.col("a"), F.col("u"))
    assert evaluate(value, "a string, u string", (age, code)) == years


def test_signal_id(evaluate):
    assert evaluate(identifiers.signal_id(F.lit("DUPIXENT"), F.lit("DERMATITIS ATOPIC"))) == "SIG-9A30F2C9A6"


def trend(evaluate, points):
    schema = "p array<struct<quarter:string,count:string>>"
    return evaluate(scores.trend_score(F.col("p")), schema, (points,))


@pytest.mark.parametrize(
    "points,score",
    [
        ([("2025Q1", "25"), ("2025Q2", "40"), ("2025Q3", "55")], 0.375),
        ([("2025Q3", "55"), ("2025Q1", "25"), ("2025Q2", "40")], 0.375),
        ([("2025Q4", "4907"), ("2026Q1", "4279")], -0.13673),
        ([("2025Q1", "10"), ("2025Q2", "10")], 0.0),
        ([("2025Q1", "1"), ("2025Q2", "100")], 1.0),
        ([("2025Q1", "5")], None),
        ([("2025Q1", "0"), ("2025Q2", "0")], None),
        ([("2025Q1", "5"), ("2025Q2", "-1")], None),
        ([("2025Q1", "5"), (None, "1")], None),
        ([("2025Q1", "5"), ("2025Q2", "x")], None),
        (None, None),
    ],
)
def test_trend(evaluate, points, score):
    assert trend(evaluate, points) == score


def risk(evaluate, prr, ror, n, chi=None, prr_lower=None, ror_lower=None):
    columns = [F.col(c) for c in ("p", "r", "n", "c", "pl", "rl")]
    schema = "p double, r double, n bigint, c double, pl double, rl double"
    return evaluate(scores.risk_score(*columns), schema, (prr, ror, n, chi, prr_lower, ror_lower))


def test_risk(evaluate):
    import math

    assert risk(evaluate, None, None, 10) is None
    assert risk(evaluate, 3.0, 2.0, 0) is None
    assert risk(evaluate, float("nan"), None, 5) is None
    assert risk(evaluate, 1e9, 1e9, 10**9, 1e9) == 1.0
    volume = 0.25 * math.log1p(50) / 7
    assert risk(evaluate, 3.5, 2.8, 50) == round(0.4 * 3.5 / 20 + volume + 0.15 * 2.8 / 20, 6)
    # a ratio below one counts nothing, a present lower bound is used
    assert risk(evaluate, 0.5, 0.5, 50) == round(volume, 6)
    assert risk(evaluate, 10.0, None, 50, 50.0, 2.0) == round(0.4 * 2 / 20 + volume + 0.2 * 0.5, 6)
    # an invalid lower bound scores nothing, there is no way back to the ratio
    assert risk(evaluate, 10.0, None, 50, None, -1.0) == round(volume, 6)


@pytest.mark.parametrize("r,level", [(0.75, "critical"), (0.7499, "high"), (0.5, "high"), (0.25, "medium"), (0.2499, "low"), (0.0, "low"), (None, None), (float("nan"), None)])
def test_priority(evaluate, r, level):
    assert evaluate(scores.priority_level(F.col("r")), "r double", (r,)) == level


def test_clean_points(evaluate):
    points = [("2025Q2", "4"), ("2025Q5", "9"), (" 2025Q1 ", "2"), ("2025Q2", "8"), ("2024Q1", "x"), ("2026Q1", "-1")]
    schema = "p array<struct<quarter:string,count:string>>"
    found = evaluate(scores.clean_trend_points(F.col("p")), schema, (points,))
    assert [(p.quarter, p["count"], p.width) for p in found] == [("2025Q1", 2.0, 0.5), ("2025Q2", 4.0, 1.0)]


def test_matched_fields(evaluate):
    def joined(items):
        return evaluate(text.join_with_and(F.col("a")), "a array<string>", (items,))

    assert joined([]) == "--"
    assert joined(["event_date"]) == "event date"
    assert joined(["a", "b"]) == "a, and b"
    assert joined(["drug", "event", "event_date"]) == "drug, event, and event date"


def test_reaction_cells(evaluate):
    def cell(value):
        return evaluate(text.parse_reactions_cell(F.col("c")), "c string", (value,))

    assert cell(" Pain|rash | |PAIN") == ["PAIN", "RASH"]
    assert cell('["b", "a", "B "]') == ["B", "A"]
    assert cell("") == [] and cell(None) == []


def test_why_flagged(evaluate):
    sentence = texts.why_flagged(F.lit("D"), F.lit("E"), F.lit(1234), F.lit(2.675))
    assert evaluate(sentence).endswith("supported by 1234 reports with a PRR of 2.67.") or evaluate(sentence).endswith("2.68.")


def test_rationale_round_trip(evaluate):
    sentence = (
        "reports 1 and 2 share drug 'A', event 'B', patient age 62, sex 'F', and event date 20260105. Exact"
    )
    d = evaluate(texts.rationale_details(F.lit(sentence)))
    assert (d.drug, d.event, d.age, d.sex, d.event_date) == ("A", "B", "62", "F", "05 Jan 2026")
    none = evaluate(texts.rationale_details(F.lit("nothing")))
    assert set(none) == {"--"}


def test_white_space_of_any_script_is_cut_off(evaluate):
    cells = F.array(*(F.lit(x) for x in ("\t40", "40\u00a0", "\u200340\x1c", "4 0")))
    assert evaluate(F.transform(cells, numbers.to_numeric)) == [40.0, 40.0, 40.0, None]
    assert evaluate(demographics.parse_sex(F.lit("F\t"))) == evaluate(demographics.parse_sex(F.lit("F")))
    assert evaluate(text.trimmed_upper(F.lit("de\u00a0"))) == "DE"
    assert evaluate(text.parse_reactions_cell(F.lit("a\u00a0|\tB"))) == ["A", "B"]
