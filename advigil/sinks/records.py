"""Contract checks on records before they are written."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from advigil import fixed_values as V
from advigil.schemas import REPORT, SIGNAL


@dataclass(frozen=True)
class Contract:
    """A fixed set of typed fields with required ones, value lists and bounds."""

    schema: T.StructType
    required: tuple[str, ...]
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    constants: dict[str, str] = field(default_factory=dict)
    minimums: dict[str, float] = field(default_factory=dict)


SIGNAL_CONTRACT = Contract(
    SIGNAL,
    ("signal_id", "drug_name", "event_name", "supporting_report_count", "prr", "candidate_status"),
    {"priority_level": V.PRIORITY_LEVELS, "candidate_status": V.CANDIDATE_STATUSES},
    minimums={"supporting_report_count": 0},
)
REPORT_CONTRACT = Contract(
    REPORT,
    ("report_id", "drug_name", "reactions", "report_quarter", "seriousness", "seriousness_codes"),
    {"seriousness": V.SERIOUSNESS_LEVELS},
    constants={"source": V.SOURCE_MARKER},
)


class ContractError(Exception):
    """The columns of a frame differ from the contract."""


def check_columns(df: DataFrame, contract: Contract, ignore: tuple[str, ...] = ()) -> None:
    """Undeclared or absent columns and wrong types, from the schema alone."""
    declared = {f.name: f.dataType for f in contract.schema.fields}
    found = {f.name: f.dataType for f in df.schema.fields if f.name not in ignore}
    extra = sorted(set(found) - set(declared))
    absent = [c for c in contract.required if c not in found]
    wrong = [
        c for c in found if c in declared and found[c].simpleString() != declared[c].simpleString()
    ]
    if extra or absent or wrong:
        raise ContractError(f"undeclared={extra} missing={absent} wrong type={wrong}")


def violations(df: DataFrame, contract: Contract) -> Column:
    """Array of texts, one per broken rule of the row; every row is checked fully."""
    found: list[Column] = []

    def add(condition: Column, text: str) -> None:
        found.append(F.when(F.coalesce(condition, F.lit(False)), F.lit(text)))

    for f in contract.schema.fields:
        if f.name not in df.columns:
            continue
        c = F.col(f.name)
        if not f.nullable:
            add(c.isNull(), f"{f.name} must not be null")
        if isinstance(f.dataType, T.ArrayType):
            add(F.exists(c, lambda x: x.isNull()), f"{f.name} has a null item")
        if isinstance(f.dataType, T.DoubleType):
            add(F.isnan(c) | (F.abs(c) == float("inf")), f"{f.name} is not finite")
    for name, values in contract.enums.items():
        add(F.col(name).isNotNull() & ~F.col(name).isin(*values), f"{name} not in value list")
    for name, value in contract.constants.items():
        add(F.col(name) != value, f"{name} differs from {value}")
    for name, value in contract.minimums.items():
        add(F.col(name) < value, f"{name} below {value}")
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def violation_counts(df: DataFrame, contract: Contract) -> DataFrame:
    """Number of rows per broken rule."""
    return (
        df.select(F.explode(violations(df, contract)).alias("violation"))
        .groupBy("violation")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def validate_records(
    df: DataFrame, contract: Contract, artifact: str, ignore: tuple[str, ...] = ()
) -> DataFrame:
    """The frame itself; a job that reads it fails at the first broken record."""
    check_columns(df, contract, ignore)
    first = contract.schema.names[0]
    broken = violations(df, contract)
    message = F.concat(F.lit(f"{artifact}: "), F.array_join(broken, "; "))
    checked = F.when(F.size(broken) > 0, F.raise_error(message).cast("string")).otherwise(F.col(first))
    return df.withColumn(first, checked)


def valid_import_record() -> Column:
    """May a signal record be imported."""
    prr = F.col("prr")
    return (
        (F.coalesce("signal_id", F.lit("")) != "")
        & (F.coalesce("drug_name", F.lit("")) != "")
        & (F.coalesce("event_name", F.lit("")) != "")
        & F.coalesce(F.col("candidate_status").isin(*V.CANDIDATE_STATUSES), F.lit(False))
        & (F.col("priority_level").isNull() | F.col("priority_level").isin(*V.PRIORITY_LEVELS))
        & F.coalesce(~F.isnan(prr) & (F.abs(prr) < float("inf")), F.lit(False))
    )
