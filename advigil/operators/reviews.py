"""Human review state of signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advigil import fixed_values as V
from advigil.functions.texts import checklist_progress


def review_join(signals: DataFrame, reviews: DataFrame) -> DataFrame:
    """Review of every signal, with the defaults of a review that has not begun."""
    joined = signals.select("signal_id").join(reviews, "signal_id", "left")
    checklist = F.struct(
        *[
            F.coalesce(F.col("evidence_checklist")[item], F.lit(False)).alias(item)
            for item in V.CHECKLIST_ITEMS
        ]
    )
    return joined.select(
        "signal_id",
        "review_id",
        F.coalesce("review_status", F.lit(V.REVIEW_STATUSES[0])).alias("review_status"),
        checklist.alias("evidence_checklist"),
        F.coalesce("reviewer_notes", F.lit("")).alias("reviewer_notes"),
        F.coalesce("reviewer_conclusion", F.lit("")).alias("reviewer_conclusion"),
        "created_at",
        "updated_at",
    ).withColumn("items_done", checklist_progress(F.col("evidence_checklist")))


def save_reviews(reviews: DataFrame, updates: DataFrame, signals: DataFrame) -> DataFrame:
    """Review table after updates: one review per known signal, signals untouched.

    An update keeps the id and creation time of an existing review.
    """
    known = updates.join(signals.select("signal_id"), "signal_id", "left_semi")
    prior = reviews.select(
        "signal_id",
        F.col("review_id").alias("_id"),
        F.col("created_at").alias("_created"),
    )
    fresh_id = F.concat(F.lit("REV-"), F.upper(F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 12)))
    saved = known.join(prior, "signal_id", "left").select(
        F.coalesce("_id", fresh_id).alias("review_id"),
        "signal_id",
        "review_status",
        "evidence_checklist",
        "reviewer_notes",
        "reviewer_conclusion",
        F.coalesce("_created", F.current_timestamp()).alias("created_at"),
        F.current_timestamp().alias("updated_at"),
    )
    untouched = reviews.join(known.select("signal_id"), "signal_id", "left_anti")
    return untouched.select(*saved.columns).unionByName(saved)
