"""Statistics of a 2x2 table with cells a, b, c, d (doubles, null = undefined)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from advigil.functions.numbers import finite
from advigil.policy import DETECTION, DetectionPolicy


@dataclass(frozen=True)
class Cells:
    """The four cells, with the policy's correction already added."""

    a: Column
    b: Column
    c: Column
    d: Column

    @staticmethod
    def of(policy: DetectionPolicy = DETECTION, a="a", b="b", c="c", d="d") -> "Cells":
        def cell(x):
            x = (F.col(x) if isinstance(x, str) else x).cast("double")
            return x + F.lit(policy.cell_correction) if policy.cell_correction else x

        return Cells(cell(a), cell(b), cell(c), cell(d))


def prr(t: Cells) -> Column:
    """Proportional reporting ratio."""
    exposed = F.try_divide(t.a, t.a + t.b)
    background = F.try_divide(t.c, t.c + t.d)
    return finite(F.try_divide(exposed, background))


def ror(t: Cells) -> Column:
    """Reporting odds ratio."""
    return finite(F.try_divide(t.a * t.d, t.b * t.c))


def _inverse(x: Column) -> Column:
    return F.try_divide(F.lit(1.0), x)


def _interval(ratio: Column, error: Column, z: float) -> tuple[Column, Column]:
    centre = F.ln(ratio)
    return (
        finite(F.exp(centre - F.lit(z) * error)),
        finite(F.exp(centre + F.lit(z) * error)),
    )


def prr_interval(t: Cells, z: float = DETECTION.z) -> tuple[Column, Column]:
    error = F.sqrt(_inverse(t.a) - _inverse(t.a + t.b) + _inverse(t.c) - _inverse(t.c + t.d))
    return _interval(prr(t), error, z)


def ror_interval(t: Cells, z: float = DETECTION.z) -> tuple[Column, Column]:
    """With d = 0 the ratio is 0: the lower bound is 0 and the upper undefined."""
    error = F.sqrt(_inverse(t.a) + _inverse(t.b) + _inverse(t.c) + _inverse(t.d))
    lower, upper = _interval(ror(t), error, z)
    return F.when((t.d == 0) & (t.b * t.c > 0), F.lit(0.0)).otherwise(lower), upper


def chi_square(t: Cells, yates: bool = False) -> Column:
    """Pearson chi-square in closed form, null when a margin is empty."""
    n = t.a + t.b + t.c + t.d
    diff = t.a * t.d - t.b * t.c
    if yates:
        diff = F.greatest(F.abs(diff) - n / F.lit(2.0), F.lit(0.0))
    margins = (t.a + t.b) * (t.c + t.d) * (t.a + t.c) * (t.b + t.d)
    return finite(F.when(margins > 0, n * (diff * diff) / margins))
