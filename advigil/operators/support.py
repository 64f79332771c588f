"""Supporting reports of a signal, reporting trend and case quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from advigil import fixed_values as V
from advigil.functions.numbers import round_half_even
from advigil.functions.scores import trend_score
from advigil.functions.text import strip, trimmed_upper


def mentions_event(reactions: Column, event: Column, ignore_case: bool = False) -> Column:
    """Does the reaction list contain the event."""
    if ignore_case:
        return F.exists(reactions, lambda x: F.upper(x) == F.upper(event))
    return F.array_contains(reactions, F.upper(event))


def _blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def exploded_reports(reports: DataFrame, *columns: str) -> DataFrame:
    """One row per report and distinct upper-case event, with the named columns."""
    events = F.array_distinct(F.transform("reactions", lambda x: F.upper(x)))
    return reports.select(*columns, F.explode(events).alias("event_key"))


def signal_keys(signals: DataFrame, scope: str = "release") -> DataFrame:
    """Join keys of the signals; ``scope='all'`` ignores the release of a signal."""
    release = F.nullif("dataset_version", F.lit("")) if scope == "release" else F.lit(None)
    return signals.select(
        "signal_id",
        "drug_name",
        F.upper("event_name").alias("event_key"),
        release.cast("string").alias("_release"),
    )


def _in_scope() -> Column:
    return F.col("_release").isNull() | (F.col("_release") == F.col("report_quarter"))


def supporting_reports(signals: DataFrame, reports: DataFrame, scope: str = "release") -> DataFrame:
    """(signal id, report) for every report that names the signal's drug and event.

    The reaction list is exploded once, so the match is an equi join on (drug,
    event) with the quarter as a residual condition.
    """
    rows = exploded_reports(reports, *reports.columns)
    return (
        rows.join(signal_keys(signals, scope), ["drug_name", "event_key"])
        .filter(_in_scope())
        .select("signal_id", *reports.columns)
    )


def supporting_events(signals: DataFrame, events: DataFrame, scope: str = "release") -> DataFrame:
    """``supporting_reports`` from the report-event table: no list is exploded and no report shuffled."""
    rows = events.withColumn("event_key", F.col("event_name")).drop("event_name", "block")
    return rows.join(signal_keys(signals, scope), ["drug_name", "event_key"]).filter(_in_scope()).drop("event_key", "_release")


def supporting_reports_page(found: DataFrame, page: int = 1, page_size: int = 50) -> DataFrame:
    """One page of the supporting reports of every signal, in report id order.

    Spark keeps the first rows of each signal before it shuffles them.
    """
    place = F.row_number().over(W.partitionBy("signal_id").orderBy("report_id", "drug_name"))
    numbered = found.withColumn("place", place).filter(F.col("place") <= page * page_size)
    return numbered.filter(F.col("place") > (page - 1) * page_size)


def support_by_quarter(signals: DataFrame, reports: DataFrame) -> DataFrame:
    """Per (drug, event, quarter): reports and missing fields, for signal pairs only.

    Reports are counted before they meet the signals. The left-semi filter keeps the
    pairs some signal asks for, the counts are combined on the map side, and only
    sums travel: a pair with a very large share of all reports costs no more than
    one row per map task and quarter.
    """
    flags = reports.select(
        "drug_name",
        "report_quarter",
        "reactions",
        F.col("patient_age").isNull().cast("int").alias("no_age"),
        _blank(F.col("patient_sex")).cast("int").alias("no_sex"),
        _blank(F.col("event_date")).cast("int").alias("no_date"),
    )
    wanted = signal_keys(signals).select("drug_name", "event_key").distinct()
    rows = exploded_reports(flags, "drug_name", "report_quarter", "no_age", "no_sex", "no_date")
    return (
        rows.join(wanted, ["drug_name", "event_key"], "left_semi")
        .groupBy("drug_name", "event_key", "report_quarter")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("no_age").alias("no_age"),
            F.sum("no_sex").alias("no_sex"),
            F.sum("no_date").alias("no_date"),
        )
    )


def event_counts_by_quarter(events: DataFrame) -> DataFrame:
    """``support_by_quarter`` of all pairs, from the report-event table: what is shuffled are sums."""
    return events.groupBy("drug_name", F.col("event_name").alias("event_key"), "report_quarter").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("patient_age").isNull().cast("int")).alias("no_age"),
        F.sum(_blank(F.col("patient_sex")).cast("int")).alias("no_sex"),
        F.sum(_blank(F.col("event_date")).cast("int")).alias("no_date"),
    )


def support_per_signal(
    signals: DataFrame, reports: DataFrame, scope: str = "release", counts: DataFrame | None = None
) -> DataFrame:
    """Per signal: reports, missing fields and the quarterly series, in one pass.

    The series has one entry per quarter. ``counts`` is a stored ``support_by_quarter``; it
    serves every scope and spares the reports.
    """
    counts = support_by_quarter(signals, reports) if counts is None else counts
    rows = counts.join(signal_keys(signals, scope), ["drug_name", "event_key"])
    point = F.struct(
        F.col("report_quarter").alias("quarter"), F.col("n").cast("double").alias("count")
    )
    return rows.filter(_in_scope()).groupBy("signal_id").agg(
        F.sum("n").alias("matched"),
        F.sum("no_age").alias("no_age"),
        F.sum("no_sex").alias("no_sex"),
        F.sum("no_date").alias("no_date"),
        F.array_sort(F.collect_list(point)).alias("trend_data"),
    )


def trend_series(
    signals: DataFrame, reports: DataFrame, scope: str = "release", counts: DataFrame | None = None
) -> DataFrame:
    """Quarterly report counts of every signal, empty when no report matches."""
    support = support_per_signal(signals, reports, scope, counts).select("signal_id", "trend_data")
    empty = F.array().cast("array<struct<quarter:string,count:double>>")
    return signals.select("signal_id").join(support, "signal_id", "left").select(
        "signal_id", F.coalesce("trend_data", empty).alias("trend_data")
    )


def trend_slopes(
    signals: DataFrame, reports: DataFrame, scope: str = "release", counts: DataFrame | None = None
) -> DataFrame:
    return trend_series(signals, reports, scope, counts).select(
        "signal_id", trend_score(F.col("trend_data")).alias("trend_score")
    )


def _quality_columns(rows: DataFrame) -> DataFrame:
    """Flags, indicators and score from total and missing counts."""
    total = F.col("total_reports")

    def share(c: str) -> Column:
        return F.coalesce(F.try_divide(F.col(c).cast("double"), total.cast("double")), F.lit(0.0))

    age, sex, date = share("missing_age_count"), share("missing_sex_count"), share("missing_date_count")
    present = {
        "high_missing_age": (age > 0.3, age),
        "minor_missing_age": ((age > 0) & (age <= 0.3), age),
        "high_missing_sex": (sex > 0.3, sex),
        "high_missing_date": (date > 0.3, date),
    }

    def indicator(flag: str) -> Column:
        condition, part = present[flag]
        text, impact = V.QUALITY_FLAGS[flag]
        percent = F.floor(part * F.lit(100)).cast("int").cast("string")
        return F.when(
            condition,
            F.struct(
                F.lit(flag).alias("flag"),
                F.concat(percent, F.lit(text)).alias("description"),
                F.lit(impact).alias("impact_level"),
            ),
        )

    indicators = F.filter(F.array(*[indicator(f) for f in present]), lambda x: x.isNotNull())
    penalty = age * F.lit(0.3) + sex * F.lit(0.3) + date * F.lit(0.4)
    score = F.greatest(F.lit(0.0), round_half_even(F.lit(1.0) - penalty, 2))
    return rows.withColumn("quality_score", score).withColumn("indicators", indicators).select(
        "signal_id",
        "total_reports",
        "missing_age_count",
        "missing_sex_count",
        "missing_date_count",
        "quality_score",
        F.transform("indicators", lambda x: x["flag"]).alias("quality_flags"),
        "indicators",
    )


def quality_from_support(signals: DataFrame, support: DataFrame) -> DataFrame:
    """Case quality from ``support_per_signal``; without reports the stored count is used."""
    rows = signals.select("signal_id", "supporting_report_count").join(support, "signal_id", "left")
    return _quality_columns(
        rows.select(
            "signal_id",
            F.coalesce("matched", "supporting_report_count", F.lit(0)).cast("bigint").alias("total_reports"),
            F.coalesce("no_age", F.lit(0)).cast("bigint").alias("missing_age_count"),
            F.coalesce("no_sex", F.lit(0)).cast("bigint").alias("missing_sex_count"),
            F.coalesce("no_date", F.lit(0)).cast("bigint").alias("missing_date_count"),
        )
    )


def case_quality(
    signals: DataFrame,
    reports: DataFrame,
    stored: DataFrame | None = None,
    scope: str = "release",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Quality of every signal; a stored row wins over the computed one."""
    if stored is None:
        return quality_from_support(signals, support_per_signal(signals, reports, scope, counts))
    missing = signals.join(stored.select("signal_id"), "signal_id", "left_anti")
    computed = quality_from_support(missing, support_per_signal(missing, reports, scope, counts))
    kept = stored.join(signals.select("signal_id"), "signal_id", "left_semi")
    return kept.select(*computed.columns).unionByName(computed)


def drug_search(signals: DataFrame, reports: DataFrame, text: str) -> DataFrame:
    """Drugs whose name contains the text with their number of signals.

    Only when no signal matches, matching report drugs are listed with 0.
    """
    wanted = text.strip().upper()

    def matching(frame: DataFrame) -> DataFrame:
        return frame.filter(F.upper("drug_name").contains(wanted))

    from_signals = (
        matching(signals).groupBy("drug_name").agg(F.count("signal_id").alias("candidate_signals_count"))
    )
    any_signal = from_signals.agg(F.count(F.lit(1)).alias("n"))
    from_reports = (
        matching(reports)
        .select("drug_name")
        .distinct()
        .filter(any_signal.scalar() == 0)
        .withColumn("candidate_signals_count", F.lit(0).cast("bigint"))
    )
    return from_signals.unionByName(from_reports).orderBy(F.desc("candidate_signals_count"), "drug_name")


def block_sex(sex: Column) -> Column:
    return trimmed_upper(sex)
