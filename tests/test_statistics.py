import math
from dataclasses import replace

import pytest

from advigil.functions import disproportionality as stat
from advigil.operators import contingency, detection
from advigil.policy import DETECTION

CELLS = "a double, b double, c double, d double"


def values(spark, rows, policy=DETECTION):
    frame = spark.createDataFrame([tuple(map(float, r)) for r in rows], CELLS)
    return contingency.with_statistics(frame, policy).collect()


def test_known_cells(spark):
    first, second = values(spark, [(10, 90, 20, 880), (8, 4, 3, 9)])
    assert first.prr == pytest.approx(4.5) and first.ror == pytest.approx(4.8889, abs=1e-4)
    assert second.prr == pytest.approx(2.6667, abs=1e-4) and second.ror == pytest.approx(6.0)


@pytest.mark.parametrize("cells", [(0, 10, 5, 5), (5, 0, 5, 5), (5, 5, 0, 5), (5, 5, 5, 0), (0, 0, 0, 0), (3, 0, 0, 0)])
@pytest.mark.parametrize("correction", [0.0, 0.5])
def test_empty_cells_give_finite_or_null(spark, cells, correction):
    row = values(spark, [cells], replace(DETECTION, cell_correction=correction))[0]
    for name in ("prr", "prr_lower", "prr_upper", "chi_square", "ror", "ror_lower", "ror_upper"):
        assert row[name] is None or math.isfinite(row[name])


def test_empty_d_has_a_lower_bound_only(spark):
    row = values(spark, [(5, 5, 5, 0)])[0]
    assert (row.ror, row.ror_lower, row.ror_upper) == (0.0, 0.0, None)


def test_no_background_has_no_ratio(spark):
    row = values(spark, [(5, 5, 0, 5)])[0]
    assert (row.prr, row.prr_lower, row.ror) == (None, None, None)


def test_chi_square_formula(spark):
    a, b, c, d = 12, 30, 9, 200
    n = a + b + c + d
    expected = sum(
        (o - r * k / n) ** 2 / (r * k / n)
        for o, r, k in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d))
    )
    t = stat.Cells.of()
    frame = spark.createDataFrame([tuple(map(float, (a, b, c, d)))], CELLS)
    row = frame.select(stat.chi_square(t).alias("x"), stat.chi_square(t, yates=True).alias("y")).first()
    assert row.x == pytest.approx(expected)
    yates = n * max(abs(a * d - b * c) - n / 2, 0) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    assert row.y == pytest.approx(yates)


def universe(spark):
    rows = [("D1", "E1")] * 8 + [("D1", "E2")] * 4 + [("D2", "E1")] * 3 + [("D2", "E2")] * 9
    return spark.createDataFrame(
        [(str(i), str(i), d, e) for i, (d, e) in enumerate(rows)],
        "primaryid string, caseid string, drug_name string, event_name string",
    )


def test_cells_of_a_universe(spark):
    metrics = contingency.disproportionality(contingency.pair_counts(universe(spark)))
    row = metrics.filter("drug_name = 'D1' and event_name = 'E1'").first()
    assert (row.a, row.b, row.c, row.d, row.n_total) == (8, 4, 3, 9, 24)
    assert row.prr == pytest.approx(8 / 12 / (3 / 12)) and row.ror == pytest.approx(6.0)


def test_detection(spark):
    metrics = spark.createDataFrame(
        [("D1", "E1", 10, 3.0, 3.5, 9.0), ("D2", "E2", 2, 5.0, 5.0, 9.0), ("D3", "E3", 50, 1.5, 1.5, 2.0), ("D4", "E4", 5, None, None, None)],
        "drug_name string, event_name string, a bigint, prr double, ror double, chi_square double",
    )
    strict = detection.detect_signals(metrics, "2026Q1").collect()
    assert [r.drug_name for r in strict] == ["D1"] and strict[0].dataset_version == "2026Q1"
    relaxed = replace(DETECTION, min_reports=2, min_prr=1.6)
    assert detection.detect_signals(metrics, "2026Q1", relaxed).count() == 2
    stats = detection.detection_stats(metrics).first()
    assert (stats.total_pairs_evaluated, stats.finite_prr_pairs, stats.candidates_detected) == (4, 3, 1)
