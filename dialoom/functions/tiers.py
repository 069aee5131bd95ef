"""Tier thresholds and weights of speaker evidence (primary, aux, fallback, anything else)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
ASSIGN_SIM = {"primary": 0.20, "aux": 0.22, "fallback": 0.26}
VOTE_WEIGHT = {"primary": 3.0, "aux": 1.5, "fallback": 0.75}
ROW_WEIGHT = {"primary": 1.00, "aux": 0.70, "fallback": 0.20}
RESEG_ROW_WEIGHT = 0.90
NEIGHBOR_BLOCK_RATIO = 0.45
NEIGHBOR_BLOCK_FACTOR = 0.10


def _pick(tier: Column, table: dict[str, float], other: float) -> Column:
    c = None
    for name, v in table.items():
        c = F.when(tier == name, F.lit(v)) if c is None else c.when(tier == name, F.lit(v))
    return c.otherwise(F.lit(other))


def assign_threshold(tier: Column) -> Column:
    return _pick(tier, ASSIGN_SIM, ASSIGN_SIM["fallback"])


def vote_weight(tier: Column) -> Column:
    return _pick(tier, VOTE_WEIGHT, VOTE_WEIGHT["fallback"])


def row_weight(tier: Column) -> Column:
    return _pick(tier, ROW_WEIGHT, RESEG_ROW_WEIGHT)


def fallback_ratio(tier: Column, stored: Column | None = None) -> Column:
    default = F.when(tier == "fallback", F.lit(1.0)).otherwise(F.lit(0.0))
    return default if stored is None else F.coalesce(stored, default)


def fallback_heavy(tier: Column, threshold: float, stored: Column | None = None) -> Column:
    return fallback_ratio(tier, stored) >= threshold


def support_weight(tier: Column, stored: Column | None = None) -> Column:
    """Row weight in hundredths, a tenth of it for fallback-heavy rows."""
    w = row_weight(tier)
    heavy = fallback_heavy(tier, NEIGHBOR_BLOCK_RATIO, stored)
    return F.round(F.when(heavy, w * NEIGHBOR_BLOCK_FACTOR).otherwise(w) * 100).cast("long")


def tier_of(n: Column) -> Column:
    """A tier derived from a row number, for tables that carry none."""
    return F.when(n % 3 == 0, F.lit("primary")).when(n % 3 == 1, F.lit("aux")).otherwise(F.lit("fallback"))
