"""Settings of a run, as plain frozen data classes."""

from __future__ import annotations

from dataclasses import dataclass

from advigil.fixed_values import SOURCE_MARKER


@dataclass(frozen=True)
class DetectionPolicy:
    """Statistical policy of signal detection."""

    roles: tuple[str, ...] = ("PS",)
    min_reports: int = 3
    min_prr: float = 2.0
    min_chi_square: float = 4.0
    cell_correction: float = 0.0
    yates: bool = False
    z: float = 1.96
    exclude_deleted_cases: bool = False
    source: str = SOURCE_MARKER
    dec_years: float = 1.0


@dataclass(frozen=True)
class RiskPolicy:
    """Weights, caps and thresholds of the risk score and priority level."""

    prr_weight: float = 0.40
    volume_weight: float = 0.25
    chi_square_weight: float = 0.20
    ror_weight: float = 0.15
    prr_cap: float = 20.0
    ror_cap: float = 20.0
    chi_square_cap: float = 100.0
    log_count_cap: float = 7.0
    min_reports: int = 1
    critical: float = 0.75
    high: float = 0.50
    medium: float = 0.25


DETECTION = DetectionPolicy()
RISK = RiskPolicy()
