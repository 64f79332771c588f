"""Review rules: functions from fact columns to a nullable match struct.

A rule takes ``facts: dict[str, Column]`` and returns a ``Column`` that is null when
the rule does not apply. New rules are added to a registry (``RULES`` is the default
one) and evaluated with the rest; no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advigil.fixed_values import RULE_TEXTS
from advigil.functions.numbers import fixed_decimals
from advigil.functions.text import quoted_list

Facts = dict[str, Column]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    rule_name: str
    description: str
    document_type: str
    section_hint: str
    default_priority: str
    rationale: str
    confidence_rationale: str
    applies: Callable[[Facts], Column]
    condition_text: Callable[[Facts], Column]
    priority: Callable[[Facts], Column]

    def match(self, facts: Facts) -> Column:
        area = F.struct(
            F.lit(self.document_type).alias("document_type"),
            F.lit(self.section_hint).alias("section_hint"),
            F.lit(self.rationale).alias("rationale"),
            self.priority(facts).alias("priority"),
        )
        found = F.struct(
            F.lit(self.rule_id).alias("rule_id"),
            F.lit(self.rule_name).alias("rule_name"),
            self.condition_text(facts).alias("condition_matched"),
            area.alias("review_area"),
            F.lit(self.confidence_rationale).alias("confidence_rationale"),
        )
        return F.when(self.applies(facts), found)


def rule(rule_id: str, applies, condition_text, priority) -> Rule:
    """A rule whose texts come from the fixed values."""
    return Rule(rule_id, *RULE_TEXTS[rule_id], applies, condition_text, priority)


def _constant(level: str):
    return lambda f: F.lit(level)


def _high_from(fact: str, threshold: float):
    return lambda f: F.when(f[fact] >= threshold, "high").otherwise("medium")


def _level(f: Facts) -> Column:
    return F.lower(f["priority_level"])


def _status(f: Facts) -> Column:
    return F.lower(f["candidate_status"])


def _urgent_level(f: Facts) -> Column:
    return _level(f).isin("high", "critical")


def _urgent_text(f: Facts) -> Column:
    parts = F.array(
        F.when(_urgent_level(f), F.concat(F.lit("Priority Level='"), _level(f), F.lit("'"))),
        F.when(
            f["risk_score"] >= 0.7,
            F.concat(F.lit("Risk Score="), fixed_decimals(f["risk_score"]), F.lit(" (>= 0.70)")),
        ),
    )
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), " and ")


def _flagged(f: Facts) -> Column:
    return F.exists(f["quality_flags"], lambda x: x.contains("high_missing"))


RULES: tuple[Rule, ...] = (
    rule(
        "REG-001",
        lambda f: (f["prr"] >= 2.5) & (f["report_count"] >= 10),
        lambda f: F.concat(
            F.lit("PRR="),
            fixed_decimals(f["prr"]),
            F.lit(" (>= 2.5) with "),
            f["report_count"].cast("string"),
            F.lit(" supporting reports (>= 10)."),
        ),
        _high_from("prr", 3.0),
    ),
    rule(
        "REG-002",
        lambda f: f["trend_score"] >= 0.5,
        lambda f: F.concat(
            F.lit("Trend Score="), fixed_decimals(f["trend_score"]), F.lit(" (>= 0.50).")
        ),
        _high_from("trend_score", 0.75),
    ),
    rule(
        "REG-003",
        lambda f: F.coalesce(_urgent_level(f), F.lit(False)) | (f["risk_score"] >= 0.7),
        _urgent_text,
        _constant("high"),
    ),
    rule(
        "REG-004",
        lambda f: (f["report_count"] >= 5) & _status(f).isin("candidate", "under_review"),
        lambda f: F.concat(
            F.lit("Active status='"),
            _status(f),
            F.lit("' with "),
            f["report_count"].cast("string"),
            F.lit(" reports (>= 5)."),
        ),
        _constant("medium"),
    ),
    rule(
        "REG-005",
        lambda f: (f["quality_score"] < 0.8) | _flagged(f),
        lambda f: F.when(
            f["quality_score"] < 0.8,
            F.concat(F.lit("Quality Score="), f["quality_score"].cast("string"), F.lit(" (< 0.80)")),
        ).otherwise(F.concat(F.lit("Quality Flags="), quoted_list(f["quality_flags"]))),
        _constant("medium"),
    ),
)


def rule_matches(facts: Facts, rules: tuple[Rule, ...] = RULES) -> Column:
    """Matches of all rules in rule order."""
    return F.filter(F.array(*[r.match(facts) for r in rules]), lambda m: m.isNotNull())


def review_areas(matches: Column) -> Column:
    """One area per document type in first-seen order; a later high one replaces."""

    def merge(areas: Column, match: Column) -> Column:
        area = match["review_area"]
        known = F.exists(areas, lambda x: x["document_type"] == area["document_type"])
        upgraded = F.transform(
            areas,
            lambda x: F.when(x["document_type"] == area["document_type"], area).otherwise(x),
        )
        return (
            F.when(~known, F.concat(areas, F.array(area)))
            .when(area["priority"] == "high", upgraded)
            .otherwise(areas)
        )

    empty = F.array().cast(
        "array<struct<document_type:string,section_hint:string,rationale:string,priority:string>>"
    )
    return F.aggregate(matches, empty, merge)


def signal_facts() -> Facts:
    """Facts of a frame of signals joined to their case quality."""
    return {
        "prr": F.col("prr"),
        "report_count": F.col("supporting_report_count"),
        "trend_score": F.col("trend_score"),
        "risk_score": F.col("risk_score"),
        "priority_level": F.col("priority_level"),
        "candidate_status": F.col("candidate_status"),
        "quality_score": F.col("quality_score"),
        "quality_flags": F.coalesce("quality_flags", F.array().cast("array<string>")),
    }


def regulatory_impact(
    signals: DataFrame, quality: DataFrame, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Matches and review areas of every signal, on its stored trend score."""
    rows = signals.join(
        quality.select("signal_id", "quality_score", "quality_flags"), "signal_id", "left"
    )
    matched = rows.select("signal_id", rule_matches(signal_facts(), rules).alias("rule_matches"))
    return matched.withColumn("review_areas", review_areas(F.col("rule_matches")))


def rule_catalog(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Definitions of the rules in force."""
    return spark.createDataFrame(
        [
            (
                r.rule_id,
                r.rule_name,
                r.description,
                r.document_type,
                r.section_hint,
                r.default_priority,
            )
            for r in rules
        ],
        "rule_id string, rule_name string, description string, target_document_type string, "
        "section_hint string, default_priority string",
    )


def rule_usage(impact: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The catalogue with the number of signals each rule applies to."""
    spark = impact.sparkSession
    used = (
        impact.select(F.explode("rule_matches.rule_id").alias("rule_id"))
        .groupBy("rule_id")
        .agg(F.count(F.lit(1)).alias("matching_signals"))
    )
    return (
        rule_catalog(spark, rules)
        .join(used, "rule_id", "left")
        .withColumn("matching_signals", F.coalesce("matching_signals", F.lit(0)))
    )
