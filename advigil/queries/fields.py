"""Typed fields and derived texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advigil import fixed_values as V
from advigil.functions import demographics, identifiers, numbers, responses, scores, text, texts
from advigil.operators import documents, duplicates, investigation
from advigil.plans.star_schema import StarSchema
from advigil.queries.shown import collector, flat, joined, points
from advigil.sources.signals import column_alias_fill as fill_aliases

QUERIES: dict = {}
query = collector(QUERIES)


@query
def to_numeric(s: StarSchema) -> DataFrame:
    """Numbers in several spellings, some of them not numbers."""
    orders = s.table("orders")
    spelled = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit(" "), F.col("o_totalprice"), F.lit(" ")))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("+"), F.col("o_custkey"), F.lit("e1")))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(F.col("o_custkey"), F.lit("d")))
        .otherwise("")
    )
    return flat(orders.select("o_orderkey", numbers.to_numeric(spelled).alias("number")))


@query
def parse_event_date(s: StarSchema) -> DataFrame:
    raw = F.when(F.col("age_cod") == "DY", F.replace("event_dt", F.lit("0701"), F.lit("1345"))).otherwise(
        F.concat(F.col("event_dt"), F.lit(" "))
    )
    return s.demo.select("primaryid", demographics.parse_event_date(raw).alias("event_date"))


@query
def parse_age_years(s: StarSchema) -> DataFrame:
    return flat(
        s.demo.select(
            "primaryid", demographics.parse_age_years(F.col("age"), F.col("age_cod")).alias("patient_age")
        )
    )


@query
def normalize_age_ingest(s: StarSchema) -> DataFrame:
    code = F.concat(F.lit("80"), F.col("caseversion"))
    return flat(
        s.demo.select("primaryid", demographics.normalize_age_ingest(F.col("age"), code).alias("patient_age"))
    )


@query
def parse_sex(s: StarSchema) -> DataFrame:
    coded = F.when(F.trim("sex") == "m", "1").when(F.col("sex") == "F", "female").otherwise("3")
    return s.demo.select(
        "primaryid",
        demographics.parse_sex(F.col("sex")).alias("patient_sex"),
        demographics.parse_sex_ingest(coded).alias("ingest_sex"),
    )


@query
def type_demo(s: StarSchema) -> DataFrame:
    return flat(s.typed)


@query
def demo_audit(s: StarSchema) -> DataFrame:
    from advigil.operators.cases import demo_audit as audit

    return audit(s.typed)


@query
def normalize_drug_name(s: StarSchema) -> DataFrame:
    return s.drug.select("drugname", text.normalize_drug_name(F.col("drugname")).alias("drug_name")).groupBy(
        "drugname", "drug_name"
    ).agg(F.count(F.lit(1)).alias("rows"))


@query
def normalize_reaction(s: StarSchema) -> DataFrame:
    return s.reac.select("pt", text.normalize_reaction(F.col("pt")).alias("event_name")).groupBy(
        "pt", "event_name"
    ).agg(F.count(F.lit(1)).alias("rows"))


@query
def signal_id(s: StarSchema) -> DataFrame:
    return s.pair_counts.select(
        "drug_name",
        "event_name",
        identifiers.signal_id(F.col("drug_name"), F.col("event_name")).alias("signal_id"),
    )


@query
def safe_float(s: StarSchema) -> DataFrame:
    """NaN, infinities and (second column) negative balances become null."""
    customer = s.table("customer")
    odd = (
        F.when(F.col("c_custkey") % 3 == 0, F.lit(float("nan")))
        .when(F.col("c_custkey") % 3 == 1, F.lit(float("-inf")))
        .otherwise(F.col("c_acctbal"))
    )
    return flat(
        customer.select(
            "c_custkey",
            numbers.finite(odd).alias("safe"),
            numbers.finite_non_negative(F.col("c_acctbal")).alias("non_negative"),
            numbers.safe_int(F.col("c_acctbal")).alias("whole"),
        )
    )


def _series(s: StarSchema) -> DataFrame:
    """Monthly-quarter event counts of every user as an array of points with faults."""
    events = s.table("events")
    day = F.date_format("ts", "dd").cast("int")
    label = F.concat(
        F.lit("20"), F.lpad((F.col("user_id") % 30).cast("string"), 2, "0"), F.lit("Q"), (day % 5 + 1).cast("string")
    )
    per = events.groupBy("user_id", label.alias("quarter")).agg(
        F.count(F.lit(1)).cast("string").alias("count")
    )
    return per.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("quarter", "count"))).alias("raw"))


@query
def parse_trend_data(s: StarSchema) -> DataFrame:
    """Series written as JSON text and parsed back; other text is no series."""
    as_text = F.when(F.col("user_id") % 7 == 0, F.lit("not a list")).otherwise(F.to_json("raw"))
    parsed = _series(s).select("user_id", scores.parse_trend_data(as_text).alias("p"))
    return parsed.select("user_id", points(F.col("p")).alias("series"))


@query
def clean_trend_points(s: StarSchema) -> DataFrame:
    """One row per kept point with its bar width."""
    doubled = F.concat("raw", F.reverse("raw"))
    cleaned = _series(s).select("user_id", F.explode(scores.clean_trend_points(doubled)).alias("p"))
    return flat(cleaned.select("user_id", "p.quarter", "p.count", "p.width"))


def _wide_signals(s: StarSchema) -> DataFrame:
    """Every pair taken as a signal without a release."""
    return s.stored_metrics.select(
        "signal_id",
        "drug_name",
        "event_name",
        F.col("a").alias("supporting_report_count"),
        "prr",
        "ror",
        F.lit(None).cast("string").alias("dataset_version"),
    )


@query
def parse_duplicate_rationale(s: StarSchema) -> DataFrame:
    found = duplicates.generated_candidates(_wide_signals(s), s.stored_reports)
    return found.select("candidate_id", texts.rationale_details(F.col("rationale")).alias("d")).select(
        "candidate_id", "d.drug", "d.event", "d.age", "d.sex", "d.event_date"
    )


@query
def format_matched_fields(s: StarSchema) -> DataFrame:
    """Missing fields of each report as a phrase."""
    fields = F.filter(
        F.array(
            F.when(F.col("patient_age").isNull(), "patient_age"),
            F.when(F.col("patient_sex").isNull(), "sex"),
            F.when(F.col("event_date").isNull(), "event_date"),
        ),
        lambda x: x.isNotNull(),
    )
    return s.reports.select("report_id", "drug_name", text.join_with_and(fields).alias("missing"))


@query
def why_flagged(s: StarSchema) -> DataFrame:
    return s.metrics.select(
        "signal_id",
        texts.why_flagged(F.col("drug_name"), F.col("event_name"), F.col("a"), numbers.round_half_even(F.col("prr"), 6)).alias("why_flagged"),
    )


@query
def dataset_source_label(s: StarSchema) -> DataFrame:
    return s.reports.groupBy("report_quarter").agg(F.min("source").alias("source")).select(
        "report_quarter", text.source_label(F.col("source")).alias("dataset_source")
    )


@query
def limitations_default(s: StarSchema) -> DataFrame:
    stored = F.when(
        F.col("priority_level") == "low", F.array(F.concat(F.lit(V.LIMITATION_TYPO), F.lit(" of "), F.col("drug_name")))
    )
    return s.signals.select("signal_id", joined(texts.limitations_or_default(stored)).alias("limitations"))


@query
def column_alias_fill(s: StarSchema) -> DataFrame:
    short = s.candidates.select(
        "signal_id",
        F.col("drug_name").alias("drug"),
        F.col("event_name").alias("event"),
        F.col("supporting_report_count").alias("report_count"),
        F.col("dataset_version").alias("release_id"),
    )
    return fill_aliases(short).select("signal_id", "drug_name", "event_name", "supporting_report_count")


def bundle(s: StarSchema, whole: bool = False) -> DataFrame:
    """Evidence of every signal with generated duplicate candidates, all of them if ``whole``."""
    stored = s.stored_metrics.select(
        "signal_id",
        "prr",
        "ror",
        F.col("a").alias("report_count"),
        F.struct("a", "b", "c", "d").alias("contingency_table"),
        F.lit(None).cast("array<struct<quarter:string,count:double>>").alias("trend_data"),
        "chi_square",
    ).filter(F.col("prr") >= 2.1)
    found = duplicates.generated_candidates(s.signals, s.stored_reports, whole)
    return investigation.evidence_bundle(s.signals, stored, s.stored_reports, found)


@query
def fact_map(s: StarSchema) -> DataFrame:
    """Facts with the first three of all candidates, not only of the listed ones."""
    facts = investigation.fact_map(bundle(s, whole=True)).select("facts.*")
    return flat(
        facts.select(
            "signal_id",
            "drug_name",
            "event_name",
            "candidate_status",
            "report_count",
            "prr",
            "chi_square",
            points(F.col("trend_data")).alias("trend"),
            F.col("case_quality.quality_score").alias("quality_score"),
            "duplicate_count",
            F.size("duplicate_sample").alias("sample_size"),
            F.size("regulatory_rule_matches").alias("rule_matches"),
        )
    )


@query
def prompt_hash(s: StarSchema) -> DataFrame:
    """Hash over a struct of facts with sorted keys, nulls kept."""
    facts = F.struct("drug_name", "event_name", "priority_level", "signal_id")
    return s.signals.select("signal_id", identifiers.facts_hash(facts).alias("prompt_hash"))


@query
def document_prompt_hash(s: StarSchema) -> DataFrame:
    """Every document is hashed whole, with the facts of its signal."""
    return documents.document_prompt_hash(document_table(s), s.candidates)


@query
def evidence_sentence(s: StarSchema) -> DataFrame:
    rows = investigation.evidence_sentences(bundle(s))
    sentence = F.col("evidence_sentence")
    return rows.select(
        "signal_id",
        F.regexp_extract(sentence, r"^Reports=(\d+);", 1).alias("reports"),
        F.regexp_extract(sentence, r"case quality \((.*?)\); potential", 1).alias("quality"),
        F.regexp_extract(sentence, r"trend data=(.*?); potential review", 1).alias("trend"),
        F.regexp_extract(sentence, r"deterministic rule matches=(\d+)\.$", 1).alias("matches"),
    )


def _responses(s: StarSchema) -> DataFrame:
    """Every turn as a stored response: JSON, fenced JSON, or plain text."""
    turns = s.table("conversations")
    record = F.to_json(
        F.struct(
            F.concat(F.lit("turn "), F.col("turn")).alias("why_flagged"),
            F.col("text").alias("evidence_summary"),
            F.array(F.lit("Case quality data not available."), F.col("role")).alias("limitations"),
        )
    )
    kind = F.col("conv_id") % 3
    return turns.withColumn(
        "response",
        F.when(kind == 0, record)
        .when(kind == 1, F.concat(F.lit("```json\n"), record, F.lit("\n```")))
        .otherwise(F.concat(F.lit("  "), F.col("text"), F.lit(" "))),
    )


@query
def parse_explanation_json(s: StarSchema) -> DataFrame:
    parsed = responses.parse_explanation(
        F.col("response"),
        F.lit("D"),
        F.lit("E"),
        F.array(F.lit("known")),
        F.lit("facts."),
        F.lit(True),
    )
    rows = _responses(s).select("conv_id", "turn", parsed.alias("e"))
    return rows.select(
        "conv_id",
        "turn",
        "e.why_flagged",
        "e.evidence_summary",
        joined(F.col("e.limitations")).alias("limitations"),
        joined(F.col("e.suggested_questions")).alias("questions"),
    )


@query
def filter_contradictory_limitations(s: StarSchema) -> DataFrame:
    """Sentences of each turn; those that deny quality data are dropped."""
    stated = F.array(
        F.col("text"),
        F.concat(F.lit("Quality of "), F.col("role"), F.lit(" data is unavailable")),
        F.lit("No case missing-field counts"),
        F.lit("Quality is fine"),
    )
    kept = texts.without_contradictions(stated, F.col("turn") % 2 == 0)
    return s.table("conversations").select("conv_id", "turn", joined(kept).alias("limitations"))


@query
def parse_document_analysis_json(s: StarSchema) -> DataFrame:
    turns = s.table("conversations")
    record = F.concat(
        F.lit('{"relevant_sections": [{"section_name": "S'),
        F.col("turn").cast("string"),
        F.lit('"}, "plain"], "existing_related_content": '),
        F.to_json(F.array("text")),
        F.lit(', "analysis_status": "'),
        F.col("role"),
        F.lit('"}'),
    )
    # Sections hold one object and one plain name; the content is an array cell.
    response = F.when(F.col("conv_id") % 2 == 0, record).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", responses.parse_document_analysis(response).alias("a"))
    sections = F.transform(
        F.col("a.relevant_sections"),
        lambda x: F.concat(x["section_name"], F.lit(":"), x["relevance_reason"]),
    )
    return rows.select(
        "conv_id",
        "turn",
        joined(sections).alias("sections"),
        F.col("a.analysis_status").alias("analysis_status"),
        F.col("a.potential_coverage_gap").alias("gap"),
    )


@query
def page_count(s: StarSchema) -> DataFrame:
    counts = s.reports.groupBy("report_quarter").agg(F.count(F.lit(1)).alias("reports"))
    return counts.select(
        "report_quarter", "reports", numbers.page_count(F.col("reports"), 50).alias("pages")
    )


def document_table(s: StarSchema) -> DataFrame:
    """Documents as uploads: each belongs to a signal found by the length of its drug
    name, some to a signal that does not exist."""
    slot = F.length("drug_name") % 7
    slots = s.signals.groupBy(slot.alias("slot")).agg(F.min("signal_id").alias("signal_id"))
    docs = s.table("documents").withColumn("slot", F.col("doc_id") % 7)
    return docs.join(slots, "slot", "left").select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.concat(F.col("source"), F.lit(".txt")).alias("filename"),
        F.when(F.col("lang") == "de", F.lit("SIG-0000000000")).otherwise(F.col("signal_id")).alias("signal_id"),
        F.col("text").alias("extracted_text"),
        F.timestamp_seconds(F.col("doc_id")).alias("created_at"),
    )


def analysis_table(s: StarSchema) -> DataFrame:
    """Analyses of the labelled documents: one of each kind of label."""
    labels = s.table("labels")

    def of(kind: str, second: int) -> DataFrame:
        return labels.select(
            F.concat(F.lit(kind), F.col("doc_id")).alias("analysis_id"),
            F.col("doc_id").cast("string").alias("document_id"),
            F.when(F.col(kind) == 1, "completed").otherwise("needs_review").alias("analysis_status"),
            F.when(F.col(kind) == 0, F.concat(F.lit("gap "), F.col("doc_id"))).alias("potential_coverage_gap"),
            F.array_repeat(
                F.struct(F.lit(kind).alias("section_name"), F.lit("label").alias("relevance_reason")),
                F.col("quality") + 1,
            ).alias("relevant_sections"),
            F.lit(True).alias("human_review_required"),
            F.timestamp_seconds(F.lit(second) * (1 + F.col("toxic"))).alias("created_at"),
        )

    return of("quality", 20).unionByName(of("toxic", 30))


@query
def document_context(s: StarSchema) -> DataFrame:
    """Facts of the signal that each document names by its language and source."""
    docs = s.table("documents").select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.when(F.col("lang") == "en", identifiers.signal_id(F.lit("BLUE ANVIL"), F.lit("SUPPLIER#000000000")))
        .when(F.col("lang") == "fr", F.lit("SIG-0000000000"))
        .otherwise(F.lit(""))
        .alias("signal_id"),
    )
    context = documents.document_context(docs, s.candidates)
    return flat(context.select("document_id", "signal_id", "drug_name", "event_name", "report_count", "prr"))
