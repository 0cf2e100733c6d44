"""Dates in Turkish sentences as Column functions: numeric and ISO dates, day and month, relative words, weekdays, times.

Defined cases: a null or empty text has no dates; days that don't exist are left out; of equal mentions the first counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months and weekdays (Monday is 0), with their spellings without marks.
MONTHS = {"ocak": 1, "şubat": 2, "subat": 2, "mart": 3, "nisan": 4, "mayıs": 5, "mayis": 5, "haziran": 6, "temmuz": 7, "ağustos": 8, "agustos": 8, "eylül": 9, "eylul": 9, "ekim": 10, "kasım": 11, "kasim": 11, "aralık": 12, "aralik": 12}
WEEKDAYS = {"pazartesi": 0, "salı": 1, "sali": 1, "çarşamba": 2, "carsamba": 2, "perşembe": 3, "persembe": 3, "cuma": 4, "cumartesi": 5, "pazar": 6}
# What counts as a mention of a date, in the order in which they are looked for.
START, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
NUMERIC = START + r"[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}" + END
ISO = START + r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}" + END
DAY_MONTH = START + r"[0-9]{1,2}\s+(?:" + "|".join(MONTHS) + r")(?:['’]?(?:da|de|ta|te))?(?:\s+[0-9]{4})?" + END
RELATIVE = START + r"(?:bugün|bugun|yarın|yarin)" + END
WEEKDAY = START + r"(?:" + "|".join(sorted(WEEKDAYS, key=len, reverse=True)) + r")(?:\s+günü|\s+gunu)?" + END
TIME = START + r"saat\s+[0-9]{1,2}:[0-9]{2}" + END


def _map(values: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd"))


def _parsed(m: Column, now: Column) -> Column:
    """The time that a mention (in lower case) stands for, seen from now."""
    today = F.date_trunc("day", now)
    parts = F.split(m, "[./-]")
    n = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    short = F.when(F.length(F.get(parts, F.lit(2))) == 2, n(2) + 2000 - F.when(n(2) + 2000 > F.year(now) + 50, 100).otherwise(0)).when(F.length(F.get(parts, F.lit(2))) == 4, n(2))
    numeric = F.when(n(1) > 12, _day(short, n(0), n(1))).otherwise(_day(short, n(1), n(0)))  # month before day where only that can be
    words = F.split(F.regexp_replace(F.regexp_replace(m, r"\s+", " "), r"(?:['’](?:da|de|ta|te))(?= |$)", ""), " ")
    bare = F.regexp_replace(F.get(words, F.lit(1)), "(?<=[a-zçğıöşü]{3})(?:da|de|ta|te)$", "")
    month = F.coalesce(F.try_element_at(_map(MONTHS), F.get(words, F.lit(1))), F.try_element_at(_map(MONTHS), bare))
    day, year = F.get(words, F.lit(0)).try_cast("int"), F.get(words, F.lit(2)).try_cast("int")
    near = _day(F.year(now), month, day)
    rolled = F.when(year.isNotNull(), _day(year, month, day)).when(near.isNull() | (near < today), _day(F.year(now) + 1, month, day)).otherwise(near)  # 29 February may be of the next year only
    weekday = F.try_element_at(_map(WEEKDAYS), F.regexp_replace(m, r"\s+(?:günü|gunu)$", ""))
    ahead = F.pmod(weekday - F.weekday(now), F.lit(7))
    add = lambda days: now + F.make_dt_interval(days)
    clock = F.split(F.regexp_extract(m, "[0-9]{1,2}:[0-9]{2}", 0), ":")
    return (
        F.when(m.rlike("^[0-9]{1,2}[./]"), numeric)
        .when(m.rlike("^[0-9]{4}-"), _day(n(0), n(1), n(2)))
        .when(m.rlike("^[0-9]"), rolled)
        .when(m.isin("bugün", "bugun"), now)
        .when(m.isin("yarın", "yarin"), add(F.lit(1)))
        .when(m.startswith("saat"), _at(today, clock))
        .otherwise(add(F.when(ahead == 0, 7).otherwise(ahead)))
    )


def _at(day: Column, clock: Column) -> Column:
    h, m = F.get(clock, F.lit(0)).try_cast("int"), F.get(clock, F.lit(1)).try_cast("int")
    return F.when((h < 24) & (m < 60), F.date_trunc("day", day) + F.make_dt_interval(F.lit(0), h, m))


def dates(sentence: Column, now: Column) -> Column:
    """The times that a sentence names, by kind and then by place; a time of day is the first one's."""
    low = F.lower(F.translate(F.coalesce(sentence, F.lit("")), "İI", "iı"))
    found = F.array_distinct(F.concat(*(F.regexp_extract_all(low, F.lit(p), 0) for p in (NUMERIC, ISO, DAY_MONTH, RELATIVE, WEEKDAY, TIME))))
    times = F.filter(F.transform(found, lambda m: _parsed(m, now)), lambda t: t.isNotNull())
    clock = F.split(F.regexp_extract(F.regexp_extract(low, TIME, 0), "[0-9]{1,2}:[0-9]{2}", 0), ":")
    return F.when(low.rlike(TIME), F.transform(times, lambda t, i: F.when(i == 0, F.coalesce(_at(t, clock), t)).otherwise(t))).otherwise(times)
