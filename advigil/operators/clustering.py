"""Groups of signals by drug, by event and by statistical features."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advigil import fixed_values as V
from advigil.functions.numbers import finite, round_half_even
from advigil.functions.text import fill_template
from advigil.session import stored

SEEDS = range(42, 52)
MOST_ROUNDS = 100


def group_members(signals: DataFrame, name: str) -> DataFrame:
    """(name, signal id, cluster size) for every signal; a missing name is UNKNOWN.

    Membership is kept as rows instead of one array per name: a name that covers a
    large share of all signals stays spread over tasks.
    """
    label = F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("UNKNOWN"))
    members = signals.select(
        label.alias(name), F.coalesce("signal_id", F.lit("")).alias("signal_id")
    )
    sizes = members.groupBy(name).agg(F.count(F.lit(1)).alias("cluster_size"))
    return members.join(sizes, name)


def group_by_drug(signals: DataFrame) -> DataFrame:
    return group_members(signals, "drug_name")


def group_by_event(signals: DataFrame) -> DataFrame:
    return group_members(signals, "event_name")


def cluster_features(signals: DataFrame) -> DataFrame:
    """prr, ror (falls back to prr), log of reports and risk; missing counts as 0."""

    def zero(c: str):
        return F.coalesce(finite(F.col(c)), F.lit(0.0))

    prr = zero("prr")
    ror = F.when(zero("ror") == 0, prr).otherwise(zero("ror"))
    return signals.select(
        "signal_id",
        prr.alias("f_prr"),
        ror.alias("f_ror"),
        F.log1p(zero("supporting_report_count")).alias("f_count"),
        zero("risk_score").alias("f_risk"),
    )


def cluster_count(n: int, requested: int | None = None) -> int:
    if requested is not None and requested > 0:
        return min(requested, n)
    return max(2, min(8, int(math.sqrt(n / 2))))


FEATURES = ("prr", "ror", "count", "risk")


def scaled_features(features: DataFrame) -> DataFrame:
    """Features with s_prr, s_ror, s_count and s_risk from 0 to 1; a constant feature is 0."""
    ends = features.agg(*[f(f"f_{c}").alias(f"{n}_{c}") for c in FEATURES for n, f in (("low", F.min), ("high", F.max))])
    columns = {}
    for c in FEATURES:
        span = F.col(f"high_{c}") - F.col(f"low_{c}")
        columns[f"s_{c}"] = (F.col(f"f_{c}") - F.col(f"low_{c}")) / F.when(span == 0, 1.0).otherwise(span)
    # One row beside all others.
    return features.crossJoin(F.broadcast(ends)).select(*features.columns, *[v.alias(k) for k, v in columns.items()])


def squared_distance(centre: list[float]) -> Column:
    parts = [(F.col(f"s_{c}") - F.lit(float(x))) * (F.col(f"s_{c}") - F.lit(float(x))) for c, x in zip(FEATURES, centre, strict=True)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def nearest_centre(centres: list[list[float]]) -> Column:
    """Number of the nearest centre, the first of equal ones."""
    far = [F.struct(squared_distance(c).alias("far"), F.lit(i).alias("id")) for i, c in enumerate(centres)]
    return F.array_min(F.array(*far))["id"]


def settled_centres(scaled: DataFrame, centres: list[list[float]]) -> list[list[float]]:
    """Centres moved to the means of their members until no member changes; empty ones go.

    The driver holds the centres only. A round is one aggregate.
    """
    for _ in range(MOST_ROUNDS):
        members = scaled.withColumn("cluster_id", nearest_centre(centres))
        means = members.groupBy("cluster_id").agg(*[F.avg(f"s_{c}").alias(c) for c in FEATURES]).orderBy("cluster_id").collect()
        moved = [[row[c] for c in FEATURES] for row in means]
        if len(moved) == len(centres) and members.filter(nearest_centre(moved) != F.col("cluster_id")).isEmpty():
            return moved
        centres = moved
    return centres


def feature_clusters(signals: DataFrame, k: int | None = None) -> DataFrame | None:
    """Signal id, features, scaled features and cluster of the best of ten k-means fits.

    The best fit goes on until every member is nearest to the mean of its cluster. The driver
    sees the number of signals and the centres, never rows; nothing stays in executors' memory.
    """
    scaled = stored(scaled_features(cluster_features(signals)), "features")
    n = scaled.count()
    if n < 2:
        return None
    points = stored(VectorAssembler(inputCols=[f"s_{c}" for c in FEATURES], outputCol="_point").transform(scaled).select("_point"), "points")
    fits = [KMeans(k=cluster_count(n, k), seed=seed, featuresCol="_point").fit(points) for seed in SEEDS]
    best = min(fits, key=lambda model: model.summary.trainingCost)
    centres = settled_centres(scaled, [list(map(float, c)) for c in best.clusterCenters()])
    return scaled.withColumn("cluster_id", nearest_centre(centres)).withColumn("k", F.lit(len(centres)))


def cluster_centroids(members: DataFrame) -> DataFrame:
    """Size and mean features of every cluster, with a neutral description."""
    per_cluster = members.groupBy("cluster_id", "k").agg(
        F.count(F.lit(1)).alias("size"),
        round_half_even(F.avg("f_prr"), 3).alias("centroid_prr"),
        round_half_even(F.avg("f_ror"), 3).alias("centroid_ror"),
        round_half_even(F.avg("f_risk"), 3).alias("centroid_risk_score"),
        round_half_even(F.expm1(F.avg("f_count")), 1).alias("centroid_report_count"),
    )
    return per_cluster.withColumn(
        "description",
        fill_template(
            V.CLUSTER_TEXT,
            number=F.col("cluster_id") + 1,
            k=F.col("k"),
            size=F.col("size"),
            prr=F.col("centroid_prr"),
            risk=F.col("centroid_risk_score"),
        ),
    ).withColumn("disclaimer", F.lit(V.CLUSTER_DISCLAIMER))


def cluster_signals(signals: DataFrame, k: int | None = None) -> dict[str, DataFrame | None]:
    """The three groupings and the centroids."""
    members = feature_clusters(signals, k)
    return {
        "drug_clusters": group_by_drug(signals),
        "event_clusters": group_by_event(signals),
        "feature_members": members,
        "feature_clusters": None if members is None else cluster_centroids(members),
    }
