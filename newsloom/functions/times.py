"""Time column expressions. Every clock reading is an explicit `as_of`; zone is UTC."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000.0
# Age given to a time that cannot be read.
UNREADABLE_AGE_HOURS = 999.0


def moment(as_of: str | datetime | Column) -> Column:
    """A literal (or column) as a zone-less timestamp."""
    return (as_of if isinstance(as_of, Column) else F.lit(str(as_of))).cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def hours_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(MICROS_PER_HOUR)


def shift_hours(ts: Column, hours: float) -> Column:
    return F.timestamp_micros(micros(ts) + F.lit(int(hours * MICROS_PER_HOUR))).cast("timestamp_ntz")


def parse_iso(text: Column) -> Column:
    """Lenient ISO time: `Z` or an offset is honoured, zone-less text is UTC, bad text is NULL."""
    clean = F.trim(text)
    return F.when(
        clean.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"),
        F.try_to_timestamp(clean),
    ).cast("timestamp_ntz")


def age_hours(ts: Column, as_of: str | datetime | Column) -> Column:
    """Hours since `ts`; an unreadable time counts as very old."""
    return F.coalesce(hours_between(moment(as_of), ts), F.lit(UNREADABLE_AGE_HOURS))


def rfc822(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss '+0000'"), F.lit(""))


def temporal_steps(hours: Column) -> Column:
    """1 within 6 h, 0.8 within 24 h, 0.5 within 72 h, else 0.1."""
    return F.when(hours <= 6, 1.0).when(hours <= 24, 0.8).when(hours <= 72, 0.5).otherwise(0.1)


def temporal_score(a: Column, b: Column, window_hours: Column) -> Column:
    """As `temporal_steps` with 0.3 for a longer gap inside the event window; a missing time gives 0."""
    gap = F.abs(hours_between(a, b))
    return (
        F.when(gap.isNull(), 0.0)
        .when(gap <= 72, temporal_steps(gap))
        .when(gap <= window_hours, 0.3)
        .otherwise(0.1)
    )


def lifecycle(last_seen: Column, as_of: str | datetime | Column) -> Column:
    """Thread state: under 24 h active, under 72 h watching, else (or unreadable) settled."""
    age = hours_between(moment(as_of), last_seen)
    return F.when(age < 24, "active").when(age < 72, "watching").otherwise("settled")


def recency(ts: Column, as_of: str | datetime | Column, half_life_hours: float = 6.0) -> Column:
    """Full within 24 h, then halved every `half_life_hours`."""
    age = age_hours(ts, as_of)
    return F.when(age <= 24, 1.0).otherwise(F.pow(F.lit(0.5), (age - 24) / half_life_hours))


def freshness(ts: Column, as_of: str | datetime | Column) -> Column:
    """Health freshness steps 100/90/70/40/10 at 1/6/24/72 h; no run gives 0."""
    age = hours_between(moment(as_of), ts)
    return (
        F.when(age.isNull(), 0.0).when(age <= 1, 100.0).when(age <= 6, 90.0)
        .when(age <= 24, 70.0).when(age <= 72, 40.0).otherwise(10.0)
    )
