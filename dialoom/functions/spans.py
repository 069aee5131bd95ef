"""Scalar interval arithmetic on millisecond columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_len(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def temporal_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over the hull of both spans (not their union), 0 for an empty hull."""
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull > 0, overlap_len(a0, a1, b0, b1) / hull).otherwise(F.lit(0.0))


def pad(start: Column, end: Column, total: Column, left: int, right: int) -> tuple[Column, Column]:
    return F.greatest(F.lit(0), start - left), F.least(total, end + right)


def trim(start: Column, end: Column, by_ms: int) -> tuple[Column, Column]:
    """Shrink both sides only where more than twice the trim and a tenth of a second remain."""
    roomy = (F.lit(by_ms) > 0) & (end - start > 2 * by_ms + 100)
    return F.when(roomy, start + by_ms).otherwise(start), F.when(roomy, end - by_ms).otherwise(end)
