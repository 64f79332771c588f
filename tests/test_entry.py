import os

import pytest

import __spark_entry__ as entry
from advigil.queries import registry
from conftest import SMALL
from oracle import statements
from oracle.compare import database, difference

WITHOUT_SQL: set[str] = set()
CHECKED = ["prr_ci", "latest_case_version", "pair_expansion", "degenerate_cells", "ranked_signals", "case_quality", "load_stats", "duplicate_counts"]


def test_every_query_has_sql():
    assert set(registry()) - set(statements()) == WITHOUT_SQL
    assert set(registry()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 2 and {r["rank"] for r in rows} == {1}


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, name):
    assert difference(entry.queries()[name](spark, SMALL), database(SMALL), entry.oracle_sql()[name]) is None


class Cluster:
    """As much of a session as the folder lookup asks for."""

    def __init__(self, folder, master="yarn"):
        self.conf = self
        self.sparkContext = self
        self.folder, self.master = folder, master

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return None


def test_folder_of_the_cluster_is_used():
    from advigil.session import scratch_path, working_folder

    assert scratch_path(Cluster("hdfs:///shared"), "x").startswith("hdfs:///shared/")
    with pytest.raises(ValueError):
        working_folder(Cluster(None))
    with pytest.raises(ValueError):
        working_folder(Cluster(None, "local-cluster[2,1,1024]"))


def test_scratch_tables_are_dropped_together(spark):
    from advigil.session import drop_scratch, scratch_path, stored

    table = stored(spark.range(3), "x")
    assert table.count() == 3 and os.path.isdir(os.path.dirname(scratch_path(spark, "y")).removeprefix("file:"))
    drop_scratch(spark)
    assert not os.path.isdir(os.path.dirname(scratch_path(spark, "y")).removeprefix("file:"))
