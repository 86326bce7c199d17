"""Dates as timestamps without a zone, because the stored columns have none."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_PATTERN = "yyyy-MM-dd HH:mm:ss"

# Day, month name, year and time of an RFC 822 date; weekday and zone are left out.
_RFC822 = (
    r"^\s*(?:[A-Za-z]+\.?,?\s+)?(\d{1,2})[\s-]+([A-Za-z]{3})[A-Za-z]*\.?[\s-]+(\d{4}|\d{2})"
    r"\s+(\d{1,2}):(\d{2})(?::(\d{2}))?(?s:.*)"
)
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def stringify_timestamp(ts: Column) -> Column:
    """Fixed text form; null stays null."""
    return F.date_format(ts, TEXT_PATTERN)


def parse_feed_date(text: Column) -> Column:
    """Feed date to timestamp_ntz: wall clock time as written, null if it is no date.

    RFC 822 dates are cut once into their parts, since Spark's formatter refuses weekday
    names; two-digit years up to 49 are of this century, the others of the last. Everything
    else goes through the ISO cast.
    """
    parts = F.split(F.regexp_replace(text, _RFC822, "$3 $2 $1 $4 $5 $6"), " ")
    year, month, day, hour, minute, second = (F.try_element_at(parts, F.lit(i)) for i in range(1, 7))
    century = F.when(F.length(year) == 4, "").when(year < "50", "20").otherwise("19")
    number = F.floor((F.instr(F.lit(_MONTHS), F.lower(month)) + 2) / 3).cast("string")
    iso = F.concat(
        century, year, F.lit("-"), F.lpad(number, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"), F.lit(" "),
        F.lpad(hour, 2, "0"), F.lit(":"), minute, F.lit(":"), F.when(second == "", "00").otherwise(second),
    )
    rewritten = (F.size(parts) == 6) & month.rlike("^[A-Za-z]{3}$")
    return F.when(rewritten, iso).otherwise(F.trim(text)).try_cast("timestamp_ntz")


def _as_date(value: dt.date | str) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def _literal(moment: dt.datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ", timespec="microseconds")).cast("timestamp_ntz")


def date_bounds(
    ts: Column,
    start: dt.date | str | None = None,
    end: dt.date | str | None = None,
    today: dt.date | str | None = None,
) -> Column:
    """Condition for whole days `start`..`end`, both inclusive.

    Without `start` the range is open below; without `end` it stops at the last
    microsecond of `today`, the session's current date unless given. Literal bounds
    and a bare column, so the condition reaches the Parquet reader.
    """
    last = end if end is not None else today
    if last is not None:
        upper = _literal(dt.datetime.combine(_as_date(last), dt.time.max))
    else:
        upper = F.date_add(F.current_date(), 1).cast("timestamp_ntz") - F.expr(
            "INTERVAL 1 MICROSECOND"
        )
    inside = ts <= upper
    if start is not None:
        inside = (ts >= _literal(dt.datetime.combine(_as_date(start), dt.time.min))) & inside
    return inside
