"""Timestamps as they occur in posts, forum tables and sync state."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from talkloom.functions.text import strip

# Accepted timestamp shapes.
WEEKDAY_FORM = (
    r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun) [a-z]{3} \d{1,2} \d{1,2}:\d{1,2}:\d{1,2} [+-]\d{2}:?\d{2} \d{4}$"
)
BASIC_DATE = r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])"
BASIC_TIME = r"(?<=[T ])(\d{2})(\d{2})(?:(\d{2}))?(?=$|[.,+-])"
HOUR_ONLY = r"([T ]\d{2})(?=$|[+-])"
NO_SECONDS = r"([T ]\d{1,2}:\d{1,2})(?=$|[+-])"
WEEK_DATE = r"^(\d{4})(?:-W(\d{2})(?:-(\d))?|W(\d{2})(\d)?)(?=$|[T ])"
HOUR_OFFSET = r"([T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?[+-]\d{2})$"
ISO_DATE = r"\d{4}-\d{1,2}-\d{1,2}"
ISO_TIME = r"\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d+)?)?"
ISO_FORM = rf"^{ISO_DATE}(?:[T ]{ISO_TIME}(?:[+-]\d{{2}}:?\d{{2}})?)?$"


def _week_date(raw: Column) -> Column:
    """The calendar date of a year, week and weekday (Monday unless given); null where there is none."""
    group = lambda *numbers: F.concat(*[F.regexp_extract(raw, WEEK_DATE, n) for n in numbers])
    week = group(2, 4).try_cast("int")
    day = F.coalesce(F.nullif(group(3, 5), F.lit("")).try_cast("int"), F.lit(1))
    # The fourth of January lies in the first week.
    first = F.trunc(F.concat(group(1), F.lit("-01-04")).try_cast("date"), "week")
    date = F.date_add(first, (week - 1) * 7 + day - 1)
    return F.when((F.weekofyear(date) == week) & day.between(1, 7), date.cast("string"))


def _extended(raw: Column) -> Column:
    """ISO forms without dashes and colons, of week dates, with hours only or a decimal comma, written out; others as they are."""
    by_week = F.concat(_week_date(raw), F.regexp_replace(raw, WEEK_DATE, ""))
    dated = F.when(F.rlike(raw, F.lit(WEEK_DATE)), by_week).otherwise(F.regexp_replace(raw, BASIC_DATE, "$1-$2-$3"))
    timed = F.regexp_replace(dated, BASIC_TIME, "$1:$2:$3")
    seconds = F.regexp_replace(timed, r"(?<=[T ]\d{2}:\d{2}):(?=$|[.,+-])", ":00")
    hours = F.regexp_replace(seconds, HOUR_ONLY, "$1:00")
    whole = F.regexp_replace(hours, NO_SECONDS, "$1:00")
    pointed = F.regexp_replace(F.replace(whole, F.lit(","), F.lit(".")), HOUR_OFFSET, "$1:00")
    return F.when(F.rlike(raw, F.lit(r"^\d")), pointed).otherwise(raw)


def parse_ts(c: Column) -> Column:
    """Timestamp in any accepted form; no zone means UTC; anything else is null."""
    raw = _extended(F.replace(strip(c), F.lit("Z"), F.lit("+00:00")))
    weekday_free = F.regexp_replace(F.initcap(F.substring(raw, 5, 40)), r"([+-]\d{2}):(\d{2})", "$1$2")
    dated = F.when(F.rlike(raw, F.lit(rf"^{ISO_DATE}$")), F.concat(raw, F.lit(" 00:00:00"))).otherwise(raw)
    offset = F.regexp_replace(dated, r"([+-]\d{2})(\d{2})$", "$1:$2")
    zoned = F.when(F.rlike(offset, F.lit(r"[+-]\d{2}:\d{2}$")), offset).otherwise(F.concat(dated, F.lit("+00:00")))
    return F.when(
        F.rlike(raw, F.lit(WEEKDAY_FORM)), F.try_to_timestamp(weekday_free, F.lit("MMM d H:m:s xx yyyy"))
    ).when(F.rlike(raw, F.lit(ISO_FORM)), F.try_to_timestamp(zoned))


def next_start(mark: Column) -> Column:
    """The mark plus one second in its own offset; unreadable marks stay as they are."""
    raw = F.replace(mark, F.lit("Z"), F.lit("+00:00"))
    zone = F.regexp_extract(raw, r"[T ].*?([+-]\d{2}:?\d{2})$", 1)
    local = F.substring(raw, F.lit(1), F.length(raw) - F.length(zone))
    moved = F.when(F.rlike(raw, F.lit(ISO_FORM)), local.try_cast("timestamp_ntz")) + F.expr("INTERVAL 1 SECOND")
    text = F.regexp_replace(F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
    suffix = F.replace(F.regexp_replace(zone, r"^([+-]\d{2})(\d{2})$", "$1:$2"), F.lit("+00:00"), F.lit("Z"))
    return F.coalesce(F.concat(text, suffix), mark)
