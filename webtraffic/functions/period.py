"""Time predicates.

Every relative window takes an explicit ``as_of`` instead of a wall clock, so results are
reproducible. The reference compares ``datetime(col) > datetime('now', '-1 day')``: both sides
are cut to whole seconds. For a whole-second bound ``X`` that is ``trunc(col) > X``, which is
exactly ``col >= X + 1 second`` — a bare-column comparison with a literal, so Parquet pushes it
down. Tables written by :func:`webtraffic.sources.tables.write_tables` also carry a ``dt``
date partition; when present, a matching ``dt >=`` bound is added for partition pruning.
"""

from __future__ import annotations

import re
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# The period names the reports accept and their lengths.
PERIODS = {
    "24h": timedelta(days=1),
    "7d": timedelta(days=7),
    "30d": timedelta(days=30),
}
DEFAULT_PERIOD = "24h"
ONE_DAY = timedelta(days=1)
LIVE_WINDOW = timedelta(minutes=5)
HOURLY_WINDOW = timedelta(hours=24)
DAILY_WINDOW = timedelta(days=30)


_FORM = re.compile(r"(\d{4})-(\d{2})-(\d{2})(?:[T ]+(\d{2}):(\d{2})(?::(\d{2})(\.\d+)?)?\s*(?:(Z)|([+-])(\d{2}):(\d{2}))?)?", re.I)


def to_datetime(value) -> datetime | None:
    """Read an ``as_of``/bound value as UTC; ``None`` when it cannot be read as a date-time.

    Texts follow SQLite's date functions: ``YYYY-MM-DD``, optionally ``HH:MM``, seconds and a
    fraction after ``T`` or a space, optionally ``Z`` or an offset, which is applied. A day up to 31
    that its month lacks runs over into the next one, and 24:00 into the next day. Julian day
    numbers, ``now`` and modifiers are not supported and give ``None``, as do other texts.
    Aware datetimes are converted to UTC.
    """
    if value is None:
        return None
    if isinstance(value, datetime):
        return value.astimezone(UTC).replace(tzinfo=None) if value.tzinfo else value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    m = _FORM.fullmatch(str(value).strip())
    if not m:
        return None
    y, mo, d, h, mi, s = (int(x or 0) for x in m.group(1, 2, 3, 4, 5, 6))
    if not (1 <= mo <= 12 and 1 <= d <= 31 and h <= 24 and mi <= 59 and s <= 59 and y >= 1):
        return None
    east = timedelta(hours=int(m[10]), minutes=int(m[11])) if m[9] else timedelta(0)
    if m[9] and (int(m[10]) > 14 or int(m[11]) > 59):
        return None
    micro = round(float(m[7] or 0) * 1_000_000)
    try:
        local = datetime(y, mo, 1) + timedelta(days=d - 1, hours=h, minutes=mi, seconds=s, microseconds=micro)
        return local - east if m[9] != "-" else local + east
    except OverflowError:
        return None


def ts_lit(value: datetime) -> Column:
    """A ``timestamp_ntz`` literal (Python datetimes would become session-zone timestamps)."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def _whole_second(dt: datetime) -> datetime:
    return dt.replace(microsecond=0)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def after(col, as_of, window: timedelta, partition_col: str | None = None) -> Column:
    """``datetime(col) > datetime(as_of, -window)``."""
    a = to_datetime(as_of)
    if a is None:
        raise ValueError(f"as_of is not a date-time: {as_of!r}")
    bound = _whole_second(a) - window + timedelta(seconds=1)
    pred = _col(col) >= ts_lit(bound)
    if partition_col:
        pred = pred & (F.col(partition_col) >= F.lit(bound.date()))
    return pred


def period_filter(col, period: str | None = DEFAULT_PERIOD, as_of=None,
                  partition_col: str | None = None) -> Column:
    """``24h``/``7d``/``30d`` → trailing window; missing or empty → ``24h``;
    ``all`` or any other string → no filter (the literal ``true``, dropped by Catalyst)."""
    p = period or DEFAULT_PERIOD
    if p not in PERIODS:
        return F.lit(True)
    return after(col, as_of, PERIODS[p], partition_col)


def date_range_filter(col, start, end, partition_col: str | None = None) -> Column:
    """``datetime(col) >= datetime(start) AND datetime(col) <= datetime(end)``.

    Inclusive at second granularity; a date-only bound means midnight; an unreadable bound
    compares with NULL, so no row passes.
    """
    s, e = to_datetime(start), to_datetime(end)
    if s is None or e is None:
        return F.lit(False)
    lo = _whole_second(s)
    hi = _whole_second(e) + timedelta(seconds=1)
    pred = (_col(col) >= ts_lit(lo)) & (_col(col) < ts_lit(hi))
    if partition_col:
        pred = pred & F.col(partition_col).between(F.lit(lo.date()), F.lit(hi.date()))
    return pred


def time_filter(col, period: str | None = DEFAULT_PERIOD, start=None, end=None, as_of=None,
                partition_col: str | None = None) -> Column:
    """The enhanced report's rule: an absolute range only when both ends are given, else P01."""
    if start and end:
        return date_range_filter(col, start, end, partition_col)
    return period_filter(col, period, as_of, partition_col)


def on_day(col, as_of, partition_col: str | None = None) -> Column:
    """``date(col) = date(as_of)`` as a half-open range on the bare column."""
    a = to_datetime(as_of)
    day = datetime(a.year, a.month, a.day)
    pred = (_col(col) >= ts_lit(day)) & (_col(col) < ts_lit(day + ONE_DAY))
    if partition_col:
        pred = pred & (F.col(partition_col) == F.lit(day.date()))
    return pred


def day_start(as_of, window: timedelta) -> datetime:
    """Midnight of the first date a trailing window can touch."""
    a = _whole_second(to_datetime(as_of)) - window + timedelta(seconds=1)
    return datetime(a.year, a.month, a.day)


def pcol(df, enabled: bool = True) -> str | None:
    """The date-partition column of a table written by ``write_tables``, if it has one."""
    return "dt" if enabled and "dt" in df.columns else None


def before_period(col, period: str | None = DEFAULT_PERIOD, start=None, end=None, as_of=None,
                  partition_col: str | None = None) -> Column | None:
    """Rows strictly earlier than every row :func:`time_filter` keeps (non-NULL ``col`` below
    its lower bound), or ``None`` when the period has no lower bound or keeps no rows."""
    if start and end:
        s, e = to_datetime(start), to_datetime(end)
        if s is None or e is None:
            return None
        lo = _whole_second(s)
    else:
        p = period or DEFAULT_PERIOD
        if p not in PERIODS:
            return None
        a = to_datetime(as_of)
        if a is None:
            raise ValueError(f"as_of is not a date-time: {as_of!r}")
        lo = _whole_second(a) - PERIODS[p] + timedelta(seconds=1)
    pred = _col(col) < ts_lit(lo)
    if partition_col:
        pred = pred & (F.col(partition_col) <= F.lit(lo.date()))
    return pred
