"""Drug x event pairs per report.

Shuffle layout on a large input: the restriction to surviving reports hashes the
drug and reaction rows by report id, and the name dedup, the expanding join and the
pair dedup all reuse that partitioning. The only other shuffle is the one of the
pair counts, which is combined on the map side. A hot report is split by AQE's
skew join (see ``session.SQL_DEFAULTS``). Rows of superseded case versions are left
out before their names are normalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advigil.functions.text import normalize_drug_name, normalize_reaction
from advigil.operators.cases import restrict_to_cases
from advigil.policy import DETECTION, DetectionPolicy


def filter_role(drug: DataFrame, policy: DetectionPolicy = DETECTION) -> DataFrame:
    """Drug rows in one of the analysed roles (exact match)."""
    return drug.filter(F.col("role_cod").isin(*policy.roles))


def suspect_drugs(
    drug: DataFrame, cases: DataFrame, policy: DetectionPolicy = DETECTION
) -> DataFrame:
    """Distinct (report, case, drug name) of the analysed roles."""
    rows = filter_role(drug, policy).select("primaryid", "caseid", "drugname")
    named = restrict_to_cases(rows, cases).select(
        "primaryid",
        "caseid",
        normalize_drug_name(F.col("drugname")).alias("drug_name"),
        F.col("drugname").alias("raw_drug_name"),
    )
    return (
        named.filter(F.col("drug_name").isNotNull())
        .groupBy("primaryid", "caseid", "drug_name")
        .agg(F.min("raw_drug_name").alias("raw_drug_name"))
    )


def report_events(reac: DataFrame, cases: DataFrame) -> DataFrame:
    """Distinct (report, case, event name)."""
    named = restrict_to_cases(reac.select("primaryid", "caseid", "pt"), cases).select(
        "primaryid",
        "caseid",
        normalize_reaction(F.col("pt")).alias("event_name"),
        F.col("pt").alias("raw_reaction"),
    )
    return (
        named.filter(F.col("event_name").isNotNull())
        .groupBy("primaryid", "caseid", "event_name")
        .agg(F.min("raw_reaction").alias("raw_reaction"))
    )


def pair_universe(
    drug: DataFrame, reac: DataFrame, cases: DataFrame, policy: DetectionPolicy = DETECTION
) -> DataFrame:
    """One row per distinct (report, drug, event).

    Both sides are deduplicated before the join, so repeated rows of a report do
    not multiply. Columns nobody reads later (raw spellings, case) are pruned.
    """
    return pairs_of_sides(suspect_drugs(drug, cases, policy), report_events(reac, cases), policy)


def pairs_of_sides(drugs: DataFrame, events: DataFrame, policy: DetectionPolicy = DETECTION) -> DataFrame:
    """``pair_universe`` out of ``suspect_drugs`` and ``report_events``.

    Report and case have to agree. Only the report is an equality for the planner:
    with a second key Spark would shuffle both sides again by both keys, although the
    partitioning by report already brings equal rows together. The case, nearly
    always one per report, is compared within the join.
    """
    events = events.select("primaryid", F.col("caseid").alias("_case"), "event_name", "raw_reaction")
    joined = drugs.join(events, "primaryid")
    same_case = (F.col("caseid") >= F.col("_case")) & (F.col("caseid") <= F.col("_case"))
    return (
        joined.filter(same_case)
        .groupBy("primaryid", "drug_name", "event_name")
        .agg(
            F.min("caseid").alias("caseid"),
            F.min("raw_drug_name").alias("raw_drug_name"),
            F.min("raw_reaction").alias("raw_reaction"),
        )
        .select(
            "primaryid",
            "caseid",
            "drug_name",
            "raw_drug_name",
            "event_name",
            "raw_reaction",
            F.lit(policy.source).alias("source"),
        )
    )


def report_sides(
    drug: DataFrame, reac: DataFrame, cases: DataFrame, policy: DetectionPolicy = DETECTION
) -> DataFrame:
    """Per report: does it have an analysed drug, does it have a reaction.

    One grouped union instead of three set operations: ids are combined before the
    shuffle and every id is looked at once.
    """
    ps = filter_role(drug, policy).filter(normalize_drug_name(F.col("drugname")).isNotNull())
    rc = reac.filter(normalize_reaction(F.col("pt")).isNotNull())
    ids = ps.select("primaryid", F.lit(1).alias("in_drug"), F.lit(0).alias("in_reac")).unionByName(
        rc.select("primaryid", F.lit(0).alias("in_drug"), F.lit(1).alias("in_reac"))
    )
    return restrict_to_cases(ids, cases).groupBy("primaryid").agg(
        F.max("in_drug").alias("in_drug"), F.max("in_reac").alias("in_reac")
    )


def orphan_accounting(
    drug: DataFrame, reac: DataFrame, cases: DataFrame, policy: DetectionPolicy = DETECTION
) -> DataFrame:
    """Matched and orphan reports of the two sides; one row."""
    has_drug, has_reac = F.col("in_drug") == 1, F.col("in_reac") == 1
    return report_sides(drug, reac, cases, policy).agg(
        F.count_if(has_drug).alias("primaryids_in_ps_drugs"),
        F.count_if(has_reac).alias("primaryids_in_reactions"),
        F.count_if(has_drug & has_reac).alias("matched_primaryids"),
        F.count_if(has_drug & ~has_reac).alias("orphan_ps_drugs_primaryids"),
        F.count_if(~has_drug & has_reac).alias("orphan_reactions_primaryids"),
    )


def matched_reports(
    drug: DataFrame, reac: DataFrame, cases: DataFrame, policy: DetectionPolicy = DETECTION
) -> DataFrame:
    """Report ids present on both sides."""
    return (
        report_sides(drug, reac, cases, policy)
        .filter("in_drug = 1 and in_reac = 1")
        .select("primaryid")
    )


def orphan_reports(
    drug: DataFrame, reac: DataFrame, cases: DataFrame, policy: DetectionPolicy = DETECTION
) -> DataFrame:
    """Report ids present on one side only, with that side."""
    return (
        report_sides(drug, reac, cases, policy)
        .filter("in_drug + in_reac = 1")
        .select("primaryid", F.when(F.col("in_drug") == 1, "drug").otherwise("reaction").alias("side"))
    )


_DRUG_FACTS = ("ps_drug_rows_before_norm", "unique_ps_drugs_after_norm", "normalized_drug_names_missing")
_REACTION_FACTS = ("reactions_before_norm", "unique_reactions_after_norm", "normalized_reactions_missing")
_PAIR_FACTS = ("unique_pairs", "pairs_with_missing_drug_name", "pairs_with_missing_reaction")
_REPORT = "report"


def _facts(rows: DataFrame, side: str, named: Column, surviving: Column, kinds: tuple[str, str, str], name: Column, whole: Column) -> DataFrame:
    """(kind, key, in_drug, in_reac) of a side's rows: each row by its report, its raw row or neither, and by its name."""
    none = F.lit(None).cast("string")
    place = (
        F.when(surviving & named, F.struct(F.lit(_REPORT).alias("kind"), F.col("primaryid").cast("string").alias("key")))
        .when(surviving, F.struct(F.lit(kinds[2]).alias("kind"), whole.alias("key")))
        .otherwise(F.struct(F.lit(kinds[0]).alias("kind"), none.alias("key")))
    )
    by_name = F.struct(F.lit(kinds[1]).alias("kind"), name.alias("key"))
    listed = F.when(surviving & named, F.array(place, by_name)).otherwise(F.array(place))
    found = rows.select(F.explode(listed).alias("it")).select("it.kind", "it.key")
    return found.withColumns({"in_drug": F.lit(int(side == "drug")), "in_reac": F.lit(int(side == "reac"))})


def pair_stats(
    drug: DataFrame,
    reac: DataFrame,
    cases: DataFrame,
    pairs: DataFrame | None = None,
    policy: DetectionPolicy = DETECTION,
) -> DataFrame:
    """The audit counts of pair building as (stat, value) rows.

    Drugs, reactions and pairs are each read once. A row counts for its report, or, without a
    name, for its raw row, or for itself if its report did not survive, and besides for its name. These are combined by key on the
    map side, then counted by kind. The counts of missing names are taken over distinct raw rows.
    """
    pairs = pair_universe(drug, reac, cases, policy) if pairs is None else pairs
    known = cases.select("primaryid").distinct().withColumn("_known", F.lit(True))
    surviving = F.col("_known").isNotNull()

    def side(rows: DataFrame, name: Column, kinds: tuple[str, str, str], label: str, raw: list[str]) -> DataFrame:
        whole = F.sha2(F.to_json(F.struct(*raw)), 256)
        joined = rows.join(known, "primaryid", "left").withColumn("_name", name)
        return _facts(joined, label, F.col("_name").isNotNull(), surviving, kinds, F.col("_name"), whole)

    drugs = side(filter_role(drug, policy), normalize_drug_name(F.col("drugname")), _DRUG_FACTS, "drug", drug.columns)
    columns = ["primaryid", "caseid", "pt"]
    reactions = side(reac.select(*columns), normalize_reaction(F.col("pt")), _REACTION_FACTS, "reac", columns)
    built = pairs.agg(
        F.count(F.lit(1)).alias(_PAIR_FACTS[0]), F.count_if(F.col("drug_name").isNull()).alias(_PAIR_FACTS[1]), F.count_if(F.col("event_name").isNull()).alias(_PAIR_FACTS[2])
    )
    keyed = drugs.unionByName(reactions).groupBy("kind", "key").agg(F.sum("in_drug").alias("drug_rows"), F.sum("in_reac").alias("reac_rows"))
    in_drug, in_reac, kind = F.col("drug_rows") > 0, F.col("reac_rows") > 0, F.col("kind")
    report = kind == _REPORT
    sides = {
        "primaryids_in_ps_drugs": in_drug,
        "primaryids_in_reactions": in_reac,
        "matched_primaryids": in_drug & in_reac,
        "orphan_ps_drugs_primaryids": in_drug & ~in_reac,
        "orphan_reactions_primaryids": ~in_drug & in_reac,
    }
    counted = []
    for (before, unique, missing), n in ((_DRUG_FACTS, "drug_rows"), (_REACTION_FACTS, "reac_rows")):
        once = F.sum(F.when(report | kind.isin(before, missing), F.col(n)))
        counted += [F.coalesce(once, F.lit(0)).alias(before), F.count_if(kind == unique).alias(unique), F.count_if(kind == missing).alias(missing)]
    stats = keyed.agg(*counted, *[F.count_if(report & holds).alias(name) for name, holds in sides.items()]).crossJoin(built)
    names = [*_DRUG_FACTS, *_REACTION_FACTS, *_PAIR_FACTS, *sides]
    return stats.select(*names).unpivot([], names, "stat", "value")
