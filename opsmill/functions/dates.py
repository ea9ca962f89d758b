"""Date and duration helpers. Every helper takes ``as_of``
explicitly; nothing calls ``current_date()``, so reruns give the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def date_window(kind: str, as_of: str, n: int = 0, since: str | None = None) -> tuple[Column, Column]:
    """relative phrases -> absolute half-open [start, end) dates.

    ``last_n_days`` = the n days ending with as_of; ``since`` = since..as_of;
    ``this_week`` = Monday..as_of; ``this_month`` = 1st..as_of."""
    d = F.to_date(F.lit(as_of))
    end = F.date_add(d, 1)
    if kind == "last_n_days":
        return F.date_sub(d, n - 1), end
    if kind == "since":
        return F.to_date(F.lit(since)), end
    if kind == "this_week":
        return F.to_date(F.date_trunc("week", d)), end
    if kind == "this_month":
        return F.to_date(F.date_trunc("month", d)), end
    raise ValueError(kind)


def in_window(ts, window: tuple[Column, Column]) -> Column:
    start, end = window
    return (F.to_date(_c(ts)) >= start) & (F.to_date(_c(ts)) < end)


def day_key(ts) -> Column:
    """``completed_at[:10]`` = the calendar day."""
    return F.to_date(_c(ts))


def bucket(ts, unit: str) -> Column:
    """start of the hour/day/week/month/quarter/year containing ts."""
    return F.date_trunc(unit, _c(ts))


def within_sla(start, end, limit_seconds) -> Column:
    """end - start <= limit; an open item (NULL end) is judged against as_of by the
    caller."""
    return (F.unix_timestamp(_c(end)) - F.unix_timestamp(_c(start))) <= limit_seconds


# Remediation deadline per severity.
REMEDIATION_HOURS = {"critical": 24, "high": 7 * 24, "medium": 30 * 24, "low": 90 * 24}


def remediation_deadline_hours(severity) -> Column:
    """hours allowed for a finding of the given severity (NULL when unknown)."""
    m = F.create_map(*[x for k, v in REMEDIATION_HOURS.items() for x in (F.lit(k), F.lit(v))])
    return m[F.lower(_c(severity))]


def days_until(ts, as_of: str) -> Column:
    """Whole days from as_of to ts (negative when past)."""
    return F.datediff(F.to_date(_c(ts)), F.to_date(F.lit(as_of)))


# Age bands (days, points), tested from the oldest.
AGE_POINTS = [(365, 30), (180, 20), (90, 10)]


def age_points(age_days, bands: Sequence[tuple[int, int]] = AGE_POINTS) -> Column:
    """points for age over each band limit (first band that applies)."""
    expr = None
    for limit, pts in bands:
        cond = _c(age_days) > limit
        expr = F.when(cond, pts) if expr is None else expr.when(cond, pts)
    return expr.otherwise(0)
