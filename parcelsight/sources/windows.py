"""Load windows over a date column."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelsight.functions.times import to_ts
from parcelsight.rules.shipments import (
    LOOKBACK_DEFAULT_DAYS, LOOKBACK_MAX_DAYS, PRUNE_BUFFER_DAYS)


def clamp_lookback(requested, fallback: int = LOOKBACK_DEFAULT_DAYS,
                   maximum: int = LOOKBACK_MAX_DAYS) -> int:
    try:
        return max(1, min(maximum, int(requested)))
    except (TypeError, ValueError):
        return fallback


@dataclass(frozen=True)
class Window:
    """Inclusive date bounds, either side open."""

    start: date | None = None
    end: date | None = None

    @classmethod
    def lookback(cls, days, as_of: date) -> "Window":
        """The last N days; N+1 calendar days with the as-of day."""
        return cls(start=as_of - timedelta(days=clamp_lookback(days)))

    @classmethod
    def between(cls, start: str | None, end: str | None) -> "Window":
        return cls(date.fromisoformat(start) if start else None,
                   date.fromisoformat(end) if end else None)

    def predicate(self, day: Column) -> Column:
        pred = F.lit(True)
        if self.start:
            pred = pred & (day >= F.lit(self.start))
        if self.end:
            pred = pred & (day <= F.lit(self.end))
        return pred

    def partition_predicate(self, column: Column) -> Column:
        """Lower bound on the partition column, a few days early, so Catalyst skips files.

        Catalyst prunes only on the partition column itself; it cannot derive this bound from
        the window date.
        """
        if not self.start:
            return F.lit(True)
        return column >= F.lit(self.start - timedelta(days=PRUNE_BUFFER_DAYS))


def window_date(order: Column, pickup: Column, order_type: T.DataType,
                pickup_type: T.DataType) -> Column:
    """Order date, else pickup date: reverse pickups carry no order date."""
    return F.coalesce(to_ts(order, order_type), to_ts(pickup, pickup_type)).cast("date")
