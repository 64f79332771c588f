"""Sentences and display fields derived from facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from advigil import fixed_values as V
from advigil.functions.numbers import fixed_decimals
from advigil.functions.text import fill_template, json_or_none_text, quoted_list


def why_flagged(drug: Column, event: Column, count: Column, prr: Column) -> Column:
    return fill_template(V.WHY_FLAGGED, drug=drug, event=event, count=count, prr=fixed_decimals(prr))


def limitations_or_default(limitations: Column) -> Column:
    """Stored limitations with the known misprint corrected, else the default two."""
    default = F.array(*[F.lit(x) for x in V.DEFAULT_LIMITATIONS])
    chosen = F.when(F.size(F.coalesce(limitations, F.array())) == 0, default).otherwise(limitations)
    return F.transform(chosen, lambda x: F.replace(x, F.lit(V.LIMITATION_TYPO), F.lit(V.LIMITATION_FIXED)))


def evidence_sentence(f: dict[str, Column]) -> Column:
    """One line of facts. ``f`` maps fact names to columns."""
    quality = F.when(f["quality_score"].isNull(), F.lit(V.NOT_IN_BUNDLE)).otherwise(
        fill_template(
            V.QUALITY_SENTENCE,
            score=json_or_none_text(f["quality_score"]),
            reports=json_or_none_text(f["total_reports"]),
            age=json_or_none_text(f["missing_age_count"]),
            sex=json_or_none_text(f["missing_sex_count"]),
            date=json_or_none_text(f["missing_date_count"]),
            flags=quoted_list(F.coalesce(f["quality_flags"], F.array())),
        )
    )
    return fill_template(
        V.EVIDENCE_SENTENCE,
        report_count=json_or_none_text(f["report_count"]),
        prr=json_or_none_text(f["prr"]),
        ror=json_or_none_text(f["ror"]),
        chi_square=json_or_none_text(f["chi_square"]),
        quality=quality,
        duplicate_count=json_or_none_text(f["duplicate_count"]),
        trend_data=F.coalesce(trend_text(f["trend_data"]), F.lit(V.NOT_IN_BUNDLE)),
        areas=F.size(F.coalesce(f["review_areas"], F.array())),
        matches=F.size(F.coalesce(f["rule_matches"], F.array())),
    )


def trend_text(points: Column) -> Column:
    """``[{'quarter': '2026Q1', 'count': 3}]`` for an array of points."""
    inner = F.transform(
        points,
        lambda p: F.concat(
            F.lit("{'quarter': '"),
            p["quarter"],
            F.lit("', 'count': "),
            p["count"].cast("bigint").cast("string"),
            F.lit("}"),
        ),
    )
    return F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]"))


def without_contradictions(limitations: Column, quality_present: Column) -> Column:
    """Drop limitations that deny quality data which is in fact present."""

    def denies(x: Column) -> Column:
        t = F.lower(x)
        about = t.contains("quality") | t.contains("missing-field") | t.contains("missing field")
        absent = t.contains("not available") | t.contains("unavailable") | t.contains("no case")
        return about & absent

    return F.when(quality_present, F.filter(limitations, lambda x: ~denies(x))).otherwise(limitations)


def rationale_details(rationale: Column) -> Column:
    """Drug, event, age, sex and date of a duplicate rationale, ``--`` if it does not match."""

    def group(i: int) -> Column:
        return F.regexp_extract(rationale, V.RATIONALE_PATTERN, i)

    raw_date = group(5)
    day = F.coalesce(
        F.try_to_timestamp(raw_date, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(raw_date, F.lit("yyyyMMdd")),
    )

    def shown(x: Column) -> Column:
        return F.coalesce(F.nullif(x, F.lit("")), F.lit(V.ABSENT_DETAIL))

    return F.struct(
        shown(group(1)).alias("drug"),
        shown(group(2)).alias("event"),
        shown(group(3)).alias("age"),
        shown(group(4)).alias("sex"),
        F.coalesce(F.date_format(day, "dd MMM yyyy"), F.lit(V.ABSENT_DETAIL)).alias("event_date"),
    )


def checklist_progress(checklist: Column) -> Column:
    """Number of checklist items that are true."""
    done = F.lit(0)
    for item in V.CHECKLIST_ITEMS:
        done = done + F.coalesce(checklist[item], F.lit(False)).cast("int")
    return done
