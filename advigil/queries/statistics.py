"""Disproportionality statistics, detection and scores."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advigil.functions import scores
from advigil.functions import disproportionality as stat
from advigil.operators import clustering, contingency
from advigil.operators import detection as det
from advigil.operators import enrichment
from advigil.plans.star_schema import StarSchema
from advigil.policy import DETECTION
from advigil.queries.shown import collector, flat

QUERIES: dict = {}
query = collector(QUERIES)
NAMES = ["drug_name", "event_name"]


def _cells(s: StarSchema) -> DataFrame:
    return contingency.contingency(s.pair_counts)


@query
def prr(s: StarSchema) -> DataFrame:
    corrected = stat.Cells.of(replace(DETECTION, cell_correction=0.5))
    return flat(
        _cells(s).select(*NAMES, stat.prr(stat.Cells.of()).alias("prr"), stat.prr(corrected).alias("prr_corrected"))
    )


@query
def prr_ci(s: StarSchema) -> DataFrame:
    low, high = stat.prr_interval(stat.Cells.of())
    return flat(_cells(s).select(*NAMES, low.alias("prr_lower"), high.alias("prr_upper")))


@query
def chi_square(s: StarSchema) -> DataFrame:
    t = stat.Cells.of()
    return flat(
        _cells(s).select(
            *NAMES, stat.chi_square(t).alias("chi_square"), stat.chi_square(t, yates=True).alias("chi_square_yates")
        )
    )


@query
def ror(s: StarSchema) -> DataFrame:
    return flat(_cells(s).select(*NAMES, stat.ror(stat.Cells.of()).alias("ror")))


@query
def ror_ci(s: StarSchema) -> DataFrame:
    low, high = stat.ror_interval(stat.Cells.of())
    return flat(_cells(s).select(*NAMES, low.alias("ror_lower"), high.alias("ror_upper")))


@query
def degenerate_cells(s: StarSchema) -> DataFrame:
    """Statistics of tables with empty cells, made of the counts of each customer's
    orders by status."""
    orders = s.table("orders")
    cells = orders.groupBy("o_custkey").agg(
        F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 250000)).alias("a"),
        F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") <= 250000)).alias("b"),
        F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 250000)).alias("c"),
        F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") <= 250000)).alias("d"),
    )
    stats = contingency.with_statistics(cells)
    return flat(stats)


@query
def disproportionality(s: StarSchema) -> DataFrame:
    return flat(s.metrics)


@query
def detect_signals(s: StarSchema) -> DataFrame:
    return flat(
        s.candidates.select(
            "signal_id", *NAMES, "supporting_report_count", "prr", "ror", "candidate_status"
        )
    )


@query
def detect_signals_relaxed(s: StarSchema) -> DataFrame:
    """Lower thresholds, corrected cells and Yates' chi-square."""
    policy = replace(DETECTION, min_prr=1.2, min_chi_square=1.0, min_reports=2, cell_correction=0.5, yates=True)
    metrics = contingency.disproportionality(s.pair_counts, policy)
    return flat(det.detect_signals(metrics, "2026Q1", policy).select("signal_id", "supporting_report_count", "prr", "dataset_version"))


@query
def candidate_signals_export(s: StarSchema) -> DataFrame:
    return flat(det.candidate_signals_export(s.signals))


@query
def risk_score(s: StarSchema) -> DataFrame:
    """Risk of every pair."""
    risk = scores.risk_score(*[F.col(c) for c in ("prr", "ror", "a", "chi_square", "prr_lower", "ror_lower")])
    return flat(s.metrics.select("signal_id", risk.alias("risk_score")))


@query
def priority(s: StarSchema) -> DataFrame:
    """Pairs per priority level, on ten times the risk to reach all levels."""
    risk = scores.risk_score(*[F.col(c) for c in ("prr", "ror", "a", "chi_square", "prr_lower", "ror_lower")])
    levels = s.metrics.select(scores.priority_level(risk * 10).alias("priority_level"))
    return levels.groupBy("priority_level").agg(F.count(F.lit(1)).alias("pairs"))


@query
def enrich_signals(s: StarSchema) -> DataFrame:
    return flat(s.signals)


@query
def ranked_signals(s: StarSchema) -> DataFrame:
    """Flagship: detection, scores and ranks end to end."""
    return flat(enrichment.rank_signals(s.signals))


def pair_clusters(s: StarSchema) -> DataFrame:
    """Clusters of all pairs by their statistics."""
    rows = s.stored_metrics.select(
        "signal_id", "prr", "ror", F.col("a").alias("supporting_report_count"), F.lit(None).cast("double").alias("risk_score")
    )
    return s.stored(clustering.feature_clusters(rows), "clusters")


@query
def feature_cluster(s: StarSchema) -> DataFrame:
    """Every pair with its scaled features, and whether no other centre is nearer than the mean of its cluster."""
    members = pair_clusters(s)
    names = [f"s_{c}" for c in clustering.FEATURES]
    centres = members.groupBy("cluster_id").agg(F.array(*[F.avg(c) for c in names]).alias("centre"))
    listed = centres.agg(F.collect_list(F.struct("cluster_id", "centre")).alias("centres"))

    def far(centre):
        return F.aggregate(F.zip_with(F.array(*names), centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y)

    own = F.element_at(F.map_from_entries("centres"), F.col("cluster_id"))
    least = F.array_min(F.transform("centres", lambda c: far(c["centre"])))
    shown = members.crossJoin(F.broadcast(listed)).withColumn("is_nearest", far(own) <= least + 1e-12)
    return flat(shown.select("signal_id", *names, "is_nearest"))


@query
def cluster_centroids(s: StarSchema) -> DataFrame:
    """Members, number of clusters, and whether every shown centroid is the rounded mean of its members."""
    members = pair_clusters(s)
    again = members.groupBy("cluster_id").agg(F.avg("f_prr").alias("prr"), F.avg("f_ror").alias("ror"), F.expm1(F.avg("f_count")).alias("n"), F.count(F.lit(1)).alias("members"))
    rows = clustering.cluster_centroids(members).join(again, "cluster_id")
    near = (F.abs(F.col("centroid_prr") - F.col("prr")) <= 0.0005001) & (F.abs(F.col("centroid_ror") - F.col("ror")) <= 0.0005001)
    good = near & (F.abs(F.col("centroid_report_count") - F.col("n")) <= 0.05001) & (F.col("size") == F.col("members"))
    named = F.col("description").startswith(F.concat(F.lit("Cluster "), (F.col("cluster_id") + 1).cast("string"), F.lit(" of ")))
    return rows.agg(F.sum("size").alias("members"), F.count(F.lit(1)).alias("clusters"), F.bool_and(good & named).alias("means_of_members"))


@query
def cluster_features(s: StarSchema) -> DataFrame:
    return flat(clustering.cluster_features(s.signals))


@query
def cluster_signals(s: StarSchema) -> DataFrame:
    """Sizes of the drug and event clusters."""
    found = clustering.group_by_drug(s.candidates).select(
        F.lit("drug").alias("kind"), F.col("drug_name").alias("name"), "cluster_size"
    )
    events = clustering.group_by_event(s.candidates).select(
        F.lit("event").alias("kind"), F.col("event_name").alias("name"), "cluster_size"
    )
    return found.unionByName(events).distinct()
