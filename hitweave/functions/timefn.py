"""Time expressions: fixed clocks, day/month/year windows, age scores.

``now`` is always an argument (a string ``'YYYY-MM-DD[ HH:MM:SS]'`` or a
datetime); no job reads the wall clock.  The session must be UTC (see
``hitweave.session.prepare``).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-back of each time filter, in days.
TIME_FILTER_DAYS = {"day": 1, "month": 30, "year": 365}

# Age score steps (strictly younger than N days -> score), then the
# score for older, and for a missing or unparseable date.
AGE_STEPS = ((7, 1.0), (30, 0.9), (90, 0.8), (365, 0.7))
AGE_OLDER = 0.6
AGE_UNKNOWN = 0.5
# A time of day alone is no date (the parser would take the day from the wall clock).
DATE_PREFIX = r"^\s*\d{4}-\d"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ts_lit(now) -> Column:
    """A TIMESTAMP literal, parsed in the session zone (UTC)."""
    if isinstance(now, Column):
        return now
    if isinstance(now, _dt.datetime):
        now = now.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(now, _dt.date):
        now = now.isoformat()
    return F.to_timestamp(F.lit(str(now)))


def days_ago(now, days: int) -> Column:
    return ts_lit(now) - F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(int(days)))


def window_days(time_filter: str | None) -> int | None:
    """Days of a time filter; falsy -> None (no filter); unknown -> ValueError."""
    if not time_filter:
        return None
    if time_filter not in TIME_FILTER_DAYS:
        raise ValueError(f"unknown time filter {time_filter!r}; expected one of {sorted(TIME_FILTER_DAYS)}")
    return TIME_FILTER_DAYS[time_filter]


def window_cutoff_col(time_filter, now) -> Column:
    """Per-row cutoff for a ``time_filter`` column: null when the filter is blank."""
    tf = _c(time_filter)
    expr = None
    for name, days in TIME_FILTER_DAYS.items():
        expr = (F.when(tf == name, days_ago(now, days)) if expr is None
                else expr.when(tf == name, days_ago(now, days)))
    return expr


def parse_published(text) -> Column:
    """ISO date/time text -> TIMESTAMP; a trailing ``Z`` or offset is honoured, bad text -> null."""
    return F.when(_c(text).rlike(DATE_PREFIX), F.try_to_timestamp(_c(text)))


def age_score(ts, now) -> Column:
    """Freshness score of a publication time; future dates count as fresh."""
    t = _c(ts)
    out = F.when(t.isNull(), F.lit(AGE_UNKNOWN))
    for days, score in AGE_STEPS:
        out = out.when(t > days_ago(now, days), F.lit(score))
    return out.otherwise(F.lit(AGE_OLDER))
