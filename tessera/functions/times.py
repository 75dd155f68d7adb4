"""Durations, relative times and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.numbers import round_half_up

#: A working day has 8 hours and a week 5 days.
HOUR, DAY, WEEK = 3600, 8 * 3600, 5 * 8 * 3600


def duration_seconds(text: Column) -> Column:
    """Seconds of ``1:30``, ``1.5h``, ``90m``, ``1w 2d 3h 4m`` or ``1 hour 30 minutes``; null for anything else."""
    x = F.lower(F.trim(text))
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(x, rf"([0-9]+(?:\.[0-9]+)?)\s*{unit}", 1), F.lit("")).try_cast("double"), F.lit(0.0))
    clock = F.regexp_extract(x, r"^([0-9]+):([0-5][0-9])$", 1).try_cast("double") * HOUR + F.regexp_extract(x, r"^([0-9]+):([0-5][0-9])$", 2).try_cast("double") * 60
    units = r"(w(?:eeks?)?|d(?:ays?)?|h(?:ours?|rs?)?|m(?:in(?:ute)?s?)?)"
    whole = x.rlike(rf"^(?:[0-9]+(?:\.[0-9]+)?\s*{units}\s*)+$")
    sums = part(r"w") * WEEK + part(r"d") * DAY + part(r"h") * HOUR + part(r"m") * 60
    return F.when(x.rlike("^[0-9]+:[0-5][0-9]$"), round_half_up(clock)).when(whole, round_half_up(sums)).cast("long")


def compact_duration(seconds: Column) -> Column:
    """``1w 2d 3h 4m`` of seconds; parts of zero are left out, and less than a minute is ``0m``."""
    parts, rest = [], seconds
    for size, unit in ((WEEK, "w"), (DAY, "d"), (HOUR, "h"), (60, "m")):
        n = F.floor(rest / size)
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))))
        rest = rest - n * size
    joined = F.concat_ws(" ", *parts)
    return F.when(joined == "", "0m").otherwise(joined)


def spoken_duration(seconds: Column) -> Column:
    """``2 hours 1 minute`` of seconds."""
    hours, minutes = F.floor(seconds / HOUR), F.floor(F.pmod(seconds, F.lit(HOUR)) / 60)
    word = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s")))
    joined = F.concat_ws(" ", word(hours, "hour"), word(minutes, "minute"))
    return F.when(joined == "", "0 minutes").otherwise(joined)


def round_duration(seconds: Column, minutes: int, mode: str = "nearest") -> Column:
    step = minutes * 60
    x = seconds / step
    return ({"nearest": round_half_up(x), "up": F.ceil(x), "down": F.floor(x)}[mode] * step).cast("long")


def months_between_calendar(earlier: Column, later: Column) -> Column:
    """Difference of calendar months whatever the days, not below 0."""
    return F.greatest(F.lit(0), (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier))


def months_before(as_of: Column, months: int) -> Column:
    """``months`` before a time where days beyond a month's end run on into the next (31 March - 1 gives 2 or 3 March)."""
    first = F.add_months(F.trunc(as_of, "month"), -months)
    return F.date_add(first, F.dayofmonth(as_of) - 1)


def relative_period(text: Column, as_of: Column, minutes: bool = False) -> Column:
    """A time ``7d``, ``2w``, ``1m`` or ``1h`` before another; ``m`` is months, or minutes where stated."""
    n = F.regexp_extract(text, "^([0-9]+)[hdwm]$", 1).try_cast("int")
    unit = F.regexp_extract(text, "^[0-9]+([hdwm])$", 1)
    zero = F.lit(0)
    back = lambda **k: as_of - F.make_interval(**k)
    month = back(mins=n) if minutes else back(months=n)
    return F.when(unit == "h", back(hours=n)).when(unit == "d", back(days=n)).when(unit == "w", back(days=n * 7 + zero)).when(unit == "m", month)


def time_ago(then: Column, as_of: Column) -> Column:
    """``today``, ``yesterday``, ``n days / months / years ago``."""
    days = F.datediff(as_of, then)
    months, years = F.floor(days / 30), F.floor(days / 365)
    plural = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    return (
        F.when(then.isNull(), "unknown").when(days <= 0, "today").when(days == 1, "yesterday").when(days < 30, plural(days, "day"))
        .when(days < 365, plural(months, "month")).otherwise(plural(years, "year"))
    )


def search_date(text: str, as_of: Column) -> Column:
    """A search's date word: today, yesterday, thisWeek, thisMonth, ``7d``, ``2w``, ``1m``, or a date."""
    day = F.to_date(as_of)
    words = {"today": day, "yesterday": F.date_sub(day, 1), "thisWeek": F.to_date(F.date_trunc("week", as_of)), "thisMonth": F.trunc(day, "month")}
    if text in words:
        return words[text]
    if text[:-1].isdigit() and text[-1:] in "dwm":
        n = int(text[:-1])
        return F.add_months(day, -n) if text[-1] == "m" else F.date_sub(day, n * (7 if text[-1] == "w" else 1))
    return F.to_date(F.lit(text))


def worklog_date(at: Column) -> Column:
    """A time as work logs write it: with milliseconds and ``+0000`` instead of ``Z`` (the session's zone is UTC)."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSxx")
