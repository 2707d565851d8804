"""Thresholds of the audit operators, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    approval: float = 250_000.0
    near_share: float = 0.9
    dup_tolerance: float = 0.005
    dup_days: int = 14
    reference_days: tuple[int, int] = (30, 180)
    split_days: int = 14
    split_score: float = 0.85
    scrutiny_days: tuple[int, ...] = (3, 7)
    name_confirm: float = 80.0
    match_posterior: float = 0.5
    em_rounds: int = 200
    price_z: float = 5.5
    min_category: int = 20
    benford_min: int = 30
    min_distinct_amounts: int = 20
    min_transactions: int = 20
    new_vendor_days: int = 90
    min_reference_pairs: int = 50
    fdr_alpha: float = 0.05
    round_unit: int = 1000
    severity_reference: float = 1e7
    band_high: float = 66.0
    band_medium: float = 33.0


DEFAULT = Thresholds()
