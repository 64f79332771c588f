"""Substring search by the index of names."""

import random

from pyspark.sql import functions as F

from advigil.operators import name_index


def test_search_as_a_plain_scan(spark, folder):
    rng = random.Random(1)
    names = sorted({"".join(rng.choice("AB C") for _ in range(rng.randrange(1, 9))) for _ in range(300)} | {"straße", "X", "", "ABABABAB"})
    rows = [(("2026Q1", "2026Q2")[i % 2], kind, n) for i, n in enumerate(names) for kind in ("drug", "event") if i % 3 or kind == "drug"]
    frame = spark.createDataFrame([*rows, *rows], "quarter string, kind string, name string")
    name_index.write_name_index(frame.distinct(), f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")
    for text in ("a", "ab", "b c", "abab", " ababab ", "sse", "ß", "zzzz", "a" * 40):
        for kind in ("drug", "event"):
            found = sorted(r["name"] for r in name_index.search_names(index, text, kind).collect())
            assert found == sorted({n for _, k, n in rows if k == kind and text.strip().upper() in n.upper()}), text
    later = {r["name"] for r in name_index.search_names(index, "ab", quarter="2026Q2").collect()}
    assert later == {n for q, k, n in rows if q == "2026Q2" and k == "drug" and "AB" in n.upper()}


def test_search_reads_its_runs_only(spark, folder):
    frame = spark.createDataFrame([("2026Q1", "drug", "ASPIRIN")], "quarter string, kind string, name string")
    name_index.write_name_index(frame, f"{folder}/index")
    # Quarters are replaced, not added.
    name_index.write_name_index(frame.withColumn("name", F.lit("IBUPROFEN")), f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")
    found = name_index.search_names(index, "profen")
    assert [r["name"] for r in found.collect()] == ["IBUPROFEN"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(run, [FEN,OFE,PRO,ROF])" in plan and "ReadSchema: struct<kind:string,run:string,name:string>" in plan
