"""Queue, evidence, duplicates, rules, reviews and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advigil.fixed_values import CHECKLIST_ITEMS
from advigil.operators import documents, duplicates, investigation, queue, reviews, rules, support
from advigil.plans.star_schema import StarSchema
from advigil.queries.fields import _wide_signals, analysis_table, bundle, document_table
from advigil.session import scratch_path
from advigil.queries.shown import collector, flat, joined, points
from advigil.schemas import DUPLICATE, EXPLANATION
from advigil.sinks.tables import list_releases as newest_first
from advigil.sinks.tables import read_table, release_of

QUERIES: dict = {}
query = collector(QUERIES)


# --- order, pages and lookups -----------------------------------------------------


@query
def queue_page(s: StarSchema) -> DataFrame:
    """Second page by PRR, strongest first."""
    page = queue.queue_page(s.signals, sort_by="prr", descending=True, page=2, page_size=10)
    return flat(page.select("signal_id", "prr", "supporting_report_count"))


@query
def queue_page_of_pairs(s: StarSchema) -> DataFrame:
    """First hundred of all pairs by reports; ties by id."""
    rows = s.stored_metrics.select("signal_id", "a", "drug_name", "event_name")
    return queue.queue_page(rows, sort_by="a", descending=True, page=1, page_size=100)


@query
def queue_sort_ui(s: StarSchema) -> DataFrame:
    """First ten by release, nulls last."""
    page = queue.queue_page(s.signals, sort_by="dataset_version", page=1, page_size=10)
    return page.select("signal_id", "dataset_version")


@query
def queue_total(s: StarSchema) -> DataFrame:
    return queue.queue_total(s.signals, page_size=20)


@query
def supporting_reports_page(s: StarSchema) -> DataFrame:
    """Second page of five of the reports of every pair, and the first of fifty of every scored signal."""
    pairs = support.supporting_reports_page(support.supporting_events(_wide_signals(s), s.report_events), page=2, page_size=5)
    scored = support.supporting_reports_page(support.supporting_events(s.signals, s.report_events))
    rows = [r.select("signal_id", "report_id", "report_quarter", F.col("place").cast("bigint").alias("place")) for r in (pairs, scored)]
    return rows[0].withColumn("page", F.lit(2)).unionByName(rows[1].withColumn("page", F.lit(1)))


def release_table(s: StarSchema) -> DataFrame:
    """One release per quarter with its latest-version reports."""
    return s.cases.groupBy("report_quarter").agg(
        F.count(F.lit(1)).alias("total_reports"),
        F.to_date(F.concat(F.substring("report_quarter", 1, 4), F.lit("-12-31"))).alias("import_date"),
    ).select(
        F.col("report_quarter").alias("release_id"),
        F.col("report_quarter").alias("quarter"),
        F.concat(F.lit("FDA FAERS "), F.col("report_quarter")).alias("dataset_release"),
        "import_date",
        F.lit("v1.0.0").alias("processing_version"),
        "total_reports",
    )


@query
def list_releases(s: StarSchema) -> DataFrame:
    return flat(newest_first(release_table(s)))


@query
def release_by_id(s: StarSchema) -> DataFrame:
    """Releases named by the newest report of a case, one by one; an unknown id has none."""
    table = s.stored(release_table(s), "releases")
    ids = ("1998Q1", "1992Q3", "1890Q1")
    return flat(release_of(table, ids[0]).unionByName(release_of(table, ids[1])).unionByName(release_of(table, ids[2])))


@query
def get_report(s: StarSchema) -> DataFrame:
    """Reports whose id equals the largest report id."""
    largest = s.cases.agg(F.max(F.col("primaryid").cast("bigint")).cast("string").alias("m"))
    return flat(s.reports.filter(F.col("report_id") == largest.scalar()))


@query
def export_sort(s: StarSchema) -> DataFrame:
    return flat(s.candidates.orderBy("signal_id").select("signal_id", "drug_name", "event_name", "prr"))


# --- joins of the investigation -------------------------------------------------------


def _stored_series(s: StarSchema) -> DataFrame:
    """Stored series for closed signals only."""
    return s.signals.filter("candidate_status = 'closed'").select(
        "signal_id",
        F.array(
            F.struct(F.lit("2026Q1").alias("quarter"), F.lit(25.0).alias("count")),
            F.struct(F.lit("2026Q2").alias("quarter"), F.lit(40.0).alias("count")),
            F.struct(F.lit("2026Q3").alias("quarter"), F.lit(55.0).alias("count")),
        ).alias("trend_data"),
    )


@query
def queue_metrics_join(s: StarSchema) -> DataFrame:
    rows = queue.queue_with_metrics(s.signals, _stored_series(s), s.stored_reports, scope="all")
    return flat(rows.select("signal_id", "drug_name", "event_name", "trend_score", "risk_score"))


@query
def detail_join(s: StarSchema) -> DataFrame:
    quality = s.stored_metrics.select("signal_id", "chi_square").join(_stored_series(s), "signal_id")
    detail = investigation.signal_detail(s.signals, quality, release_table(s), s.stored_reports)
    return flat(
        detail.select(
            "signal_id",
            "dataset_version",
            "dataset_source",
            "processing_version",
            "import_date",
            "chi_square",
            "trend_score",
            "known_limitations",
        )
    )


@query
def duplicate_self_join(s: StarSchema) -> DataFrame:
    members = duplicates.block_members(_wide_signals(s), s.stored_reports)
    return flat(duplicates.listed_pairs(members))


@query
def duplicate_candidates(s: StarSchema) -> DataFrame:
    found = duplicates.duplicate_candidates(_wide_signals(s), s.reports, events=s.report_events)
    return flat(found.select("candidate_id", "signal_id", "report_id_a", "report_id_b", "rationale", "matched_fields", "status"))


@query
def duplicate_groups(s: StarSchema) -> DataFrame:
    return flat(duplicates.duplicate_groups(_wide_signals(s), s.stored_reports))


@query
def duplicate_groups_of_orders(s: StarSchema) -> DataFrame:
    """Blocks of large size: all reports of a drug regardless of the event."""
    drugs = s.stored_reports.select("drug_name").distinct()
    signals = drugs.select(
        F.col("drug_name").alias("signal_id"), "drug_name", F.lit("ANY").alias("event_name"), F.lit(None).cast("string").alias("dataset_version")
    )
    reports = s.stored_reports.withColumn("reactions", F.array(F.lit("ANY")))
    groups = duplicates.blocks(duplicates.block_members(signals, reports))
    return flat(groups.select("signal_id", "age", "sex", "date", "block_size", "first_report"))


@query
def duplicate_counts(s: StarSchema) -> DataFrame:
    return duplicates.duplicate_counts(_wide_signals(s), s.stored_reports)


@query
def duplicate_precedence(s: StarSchema) -> DataFrame:
    """Stored candidates of strong pairs win over generated ones."""
    wide = _wide_signals(s)
    found = duplicates.generated_candidates(wide, s.stored_reports).drop("block_size")
    strong = wide.filter(F.col("prr") > 1.1).select("signal_id")
    stored = found.join(strong, "signal_id", "left_semi").withColumn("status", F.lit("confirmed"))
    out = duplicates.duplicate_candidates(wide, s.stored_reports, stored)
    return out.select("candidate_id", "signal_id", "status")


@query
def stored_candidates(s: StarSchema) -> DataFrame:
    """Candidates stored from four fifths of the reports, again from the same, then from all of them."""
    path = scratch_path(s.spark, "stored-candidates")
    wide = s.stored(_wide_signals(s), "wide-signals")
    part = s.stored_reports.filter(F.pmod(F.col("report_id").cast("bigint"), F.lit(5)) != 0)
    duplicates.store_candidates(s.spark, path, wide, part)
    first = s.stored(read_table(s.spark, path, DUPLICATE).select("candidate_id", F.lit(True).alias("of_first_run")), "first-run")
    again = [duplicates.store_candidates(s.spark, path, wide, part, refresh) for refresh in (False, True)]
    duplicates.store_candidates(s.spark, path, wide, s.stored_reports, refresh=True)
    rows = read_table(s.spark, path, DUPLICATE).join(first, "candidate_id", "left")
    return rows.select(
        "candidate_id", "signal_id", "report_id_a", "report_id_b", F.coalesce("of_first_run", F.lit(False)).alias("of_first_run"), F.lit(again[1]).cast("bigint").alias("added_again")
    )


@query
def top3_duplicates(s: StarSchema) -> DataFrame:
    found = duplicates.generated_candidates(_wide_signals(s), s.stored_reports)
    return duplicates.first_candidates(found).select(
        "signal_id", "candidate_id", F.col("position").cast("bigint").alias("position")
    )


@query
def documents_latest_analysis(s: StarSchema) -> DataFrame:
    rows = documents.documents_latest_analysis(document_table(s), analysis_table(s))
    return flat(rows)


@query
def doc_signal_check(s: StarSchema) -> DataFrame:
    return documents.unknown_signal_documents(document_table(s), s.signals).select("document_id", "signal_id")


def review_table(s: StarSchema) -> DataFrame:
    """A review for every signal that is not a fresh candidate."""
    checklist = F.struct(
        *[
            (F.col("supporting_report_count") > 8 + 2 * i).alias(item)
            for i, item in enumerate(CHECKLIST_ITEMS)
        ]
    )
    begun = s.signals.filter("candidate_status <> 'candidate'")
    return begun.select(
        F.concat(F.lit("REV-"), F.substring("signal_id", 5, 10)).alias("review_id"),
        "signal_id",
        F.when(F.col("candidate_status") == "closed", "reviewed").otherwise("in_review").alias("review_status"),
        checklist.alias("evidence_checklist"),
        F.lit("note").alias("reviewer_notes"),
        F.lit("").alias("reviewer_conclusion"),
        F.timestamp_seconds(F.lit(0)).alias("created_at"),
        F.timestamp_seconds(F.lit(0)).alias("updated_at"),
    )


@query
def review_join(s: StarSchema) -> DataFrame:
    rows = reviews.review_join(s.signals, review_table(s))
    return flat(rows.select("signal_id", "review_id", "review_status", "reviewer_notes", "items_done"))


@query
def save_review(s: StarSchema) -> DataFrame:
    """All signals of one release state are updated, an unknown one is ignored."""
    checklist = F.struct(*[F.lit(True).alias(i) for i in CHECKLIST_ITEMS])
    updates = s.signals.filter("dataset_version is null").select(
        "signal_id",
        F.lit("reviewed").alias("review_status"),
        checklist.alias("evidence_checklist"),
        F.lit("updated").alias("reviewer_notes"),
        F.lit("done").alias("reviewer_conclusion"),
    )
    unknown = updates.withColumn("signal_id", F.concat(F.lit("X"), F.col("signal_id")))
    saved = reviews.save_reviews(review_table(s), updates.unionByName(unknown), s.signals)
    return saved.select(
        "signal_id",
        "review_status",
        "reviewer_notes",
        F.col("review_id").startswith("REV-").alias("has_id"),
        (F.col("created_at") == F.timestamp_seconds(F.lit(0))).alias("kept_creation_time"),
    )


@query
def evidence_bundle(s: StarSchema) -> DataFrame:
    rows = bundle(s)
    return flat(
        rows.select(
            "signal_id",
            "candidate_status",
            F.col("metrics.prr").alias("prr"),
            F.col("metrics.chi_square").alias("chi_square"),
            F.col("metrics.report_count").alias("report_count"),
            points(F.col("metrics.trend_data")).alias("trend"),
            F.col("case_quality.quality_score").alias("quality_score"),
            joined(F.col("case_quality.quality_flags")).alias("quality_flags"),
            "duplicate_count",
            joined(F.transform("rule_matches", lambda m: m["rule_id"])).alias("rules"),
            joined(F.transform("review_areas", lambda a: a["document_type"])).alias("areas"),
        )
    )


def explanation_table(s: StarSchema) -> DataFrame:
    """Two explanations of every closed signal, the second one newer."""
    closed = s.signals.filter("candidate_status = 'closed'")

    def of(n: int) -> DataFrame:
        return closed.select(
            F.concat(F.lit("exp-"), F.col("signal_id"), F.lit(f"-{n}")).alias("summary_id"),
            "signal_id",
            F.lit(f"reason {n}").alias("why_flagged"),
            F.col("drug_name").alias("evidence_summary"),
            F.array(F.lit("a")).alias("limitations"),
            F.array(F.lit("q")).alias("suggested_questions"),
            F.lit("stored").alias("model_used"),
            F.lit("").alias("prompt_hash"),
            F.timestamp_seconds(F.lit(n)).alias("created_at"),
        )

    return of(1).unionByName(of(2)).select(*EXPLANATION.names)


@query
def investigation_summary(s: StarSchema) -> DataFrame:
    rows = investigation.investigation_summary(
        bundle(s), review_table(s), explanation_table(s), document_table(s), analysis_table(s)
    )
    return flat(
        rows.select(
            "signal_id",
            F.col("human_review.review_status").alias("review_status"),
            F.col("human_review.items_done").alias("items_done"),
            F.col("ai_explanation.why_flagged").alias("explanation"),
            "document_count",
            "analysed_document_count",
            "coverage_gap_count",
            "duplicate_count",
            F.size("rule_matches").alias("rule_matches"),
        )
    )


# --- rules --------------------------------------------------------------------------------


def _facts(s: StarSchema) -> DataFrame:
    """All pairs with their scores as facts: trend and quality follow the counts."""
    risk = F.least(F.lit(1.0), F.round("prr", 6) / 3)
    return s.stored_metrics.select(
        "signal_id",
        F.col("prr"),
        (F.col("a") * 2).alias("supporting_report_count"),
        ((F.col("a") - 6) / F.lit(8.0)).alias("trend_score"),
        risk.alias("risk_score"),
        F.when(F.col("a") > 12, "critical").when(F.col("a") > 10, "High").otherwise("low").alias("priority_level"),
        F.when(F.col("a") % 5 == 0, "closed").when(F.col("a") % 5 == 1, "under_review").otherwise("candidate").alias("candidate_status"),
        F.when(F.col("a") > 3, F.lit(0.55)).otherwise(F.lit(0.8)).alias("quality_score"),
        F.when(F.col("a") == 2, F.array(F.lit("high_missing_age"), F.lit("minor"))).otherwise(F.array().cast("array<string>")).alias("quality_flags"),
    )


def _rule(rule_id: str):
    def run(s: StarSchema) -> DataFrame:
        r = next(x for x in rules.RULES if x.rule_id == rule_id)
        rows = _facts(s).select("signal_id", r.match(rules.signal_facts()).alias("m"))
        return rows.filter("m is not null").select(
            "signal_id",
            "m.rule_name",
            "m.condition_matched",
            F.col("m.review_area.document_type").alias("document_type"),
            F.col("m.review_area.priority").alias("priority"),
        )

    return run


for _n in range(1, 6):
    QUERIES[f"rule_reg_00{_n}"] = _rule(f"REG-00{_n}")


@query
def evaluate_rules(s: StarSchema) -> DataFrame:
    matched = _facts(s).select("signal_id", rules.rule_matches(rules.signal_facts()).alias("m"))
    return matched.select(
        "signal_id",
        joined(F.transform("m", lambda x: x["rule_id"])).alias("rules"),
        joined(
            F.transform(rules.review_areas(F.col("m")), lambda a: F.concat(a["document_type"], F.lit("="), a["priority"]))
        ).alias("areas"),
    )


def _own_rule() -> rules.Rule:
    """A user rule on a document type that another rule already uses."""
    return rules.Rule(
        "OWN-1",
        "Many reports",
        "Reports of at least 20.",
        "Reference Safety Information (RSI)",
        "Any",
        "high",
        "Many reports.",
        "Count.",
        lambda f: f["report_count"] >= 20,
        lambda f: F.concat(F.lit("n="), f["report_count"].cast("string")),
        lambda f: F.lit("high"),
    )


@query
def rule_callables(s: StarSchema) -> DataFrame:
    """A registry with one more rule: its high area replaces the medium one."""
    registry = (*rules.RULES, _own_rule())
    matched = _facts(s).select("signal_id", rules.rule_matches(rules.signal_facts(), registry).alias("m"))
    return matched.select(
        "signal_id",
        joined(F.transform(rules.review_areas(F.col("m")), lambda a: F.concat(a["document_type"], F.lit("="), a["priority"]))).alias("areas"),
    )


@query
def regulatory_impact(s: StarSchema) -> DataFrame:
    quality = support.case_quality(s.signals, s.stored_reports)
    impact = rules.regulatory_impact(s.signals, quality)
    return impact.select(
        "signal_id",
        joined(F.transform("rule_matches", lambda m: F.concat(m["rule_id"], F.lit(": "), m["condition_matched"]))).alias("matches"),
    )


@query
def rule_catalog(s: StarSchema) -> DataFrame:
    """Rule definitions with the number of signals each applies to."""
    quality = support.case_quality(s.signals, s.stored_reports)
    return rules.rule_usage(rules.regulatory_impact(s.signals, quality)).select(
        "rule_id", "rule_name", "target_document_type", "default_priority", "matching_signals"
    )


@query
def explain_responses(s: StarSchema) -> DataFrame:
    """A stored response for every signal, half of them not JSON."""
    text = F.when(
        F.col("supporting_report_count") % 2 == 0, F.lit('{"why_flagged": "w", "limitations": []}')
    ).otherwise(F.concat(F.lit("plain "), F.col("drug_name")))
    responses = s.signals.select("signal_id", text.alias("response"))
    rows = investigation.explain_responses(responses, bundle(s))
    return rows.select(
        "signal_id",
        "why_flagged",
        F.regexp_extract("evidence_summary", r"AI interpretation: (.*)$", 1).alias("interpretation"),
        F.size("limitations").cast("bigint").alias("limitations"),
        joined(F.col("suggested_questions")).alias("questions"),
    )
