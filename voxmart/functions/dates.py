"""Every date shape the sources emit -> ``TIMESTAMP`` in UTC; anything else -> NULL.

Reference instants are arguments: results never depend on the wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"

# Fixed values: (shape, pattern). Weekday names are stripped before matching because the
# day-of-week letter is not a parse pattern.
_SHAPES = (
    (rf"^\d{{1,2}} (?:{_MONTHS}) \d{{4}} \d{{2}}:\d{{2}}:\d{{2}} [+-]\d{{4}}$",
     "d MMM yyyy HH:mm:ss Z"),
    (rf"^\d{{1,2}} (?:{_MONTHS}) \d{{4}} \d{{2}}:\d{{2}}:\d{{2}}$", "d MMM yyyy HH:mm:ss"),
    (rf"^\d{{1,2}} (?:{_MONTHS}) \d{{4}} \d{{2}}:\d{{2}}$", "d MMM yyyy HH:mm"),
    (rf"^(?:{_MONTHS}) \d{{1,2}} \d{{2}}:\d{{2}}:\d{{2}} [+-]\d{{4}} \d{{4}}$",
     "MMM d HH:mm:ss Z yyyy"),
    (r"^\d{8}T\d{6}Z$", "yyyyMMdd'T'HHmmss'Z'"),
    (rf"^(?:{_MONTHS}) \d{{1,2}}, \d{{4}}$", "MMM d, yyyy"),
    (rf"^\d{{1,2}} (?:{_MONTHS}) \d{{4}}$", "d MMM yyyy"),
    (r"^[A-Z][a-z]{3,8} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{3,8} \d{4}$", "d MMMM yyyy"),
)
_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?: ?(?:Z|[+-]\d{2}:?\d{2}))?)?$"


def parse_datetime(raw: Column) -> Column:
    """ISO with or without offset, RFC-822, legacy post date, date only, epoch s / ms, compact."""
    s = F.trim(raw)
    bare = F.regexp_replace(s, r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? ", "")
    bare = F.regexp_replace(bare, r" (?:GMT|UTC|Z)$", " +0000")
    iso = F.regexp_replace(s, r"([+-]\d{2})(\d{2})$", "$1:$2")
    out = F.when(s.rlike(_ISO), F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s.try_cast("timestamp"))
                 .otherwise(F.when(iso.rlike(r":\d{2}$"), iso).otherwise(s).try_cast("timestamp")))
    out = out.when(s.rlike(r"^\d{10}$"), F.timestamp_seconds(s.try_cast("bigint")))
    out = out.when(s.rlike(r"^\d{13}$"), F.timestamp_millis(s.try_cast("bigint")))
    # "HH:mm +0000" has no seconds: give it some, so one pattern covers both.
    with_seconds = F.regexp_replace(bare, r" (\d{2}:\d{2}) ([+-]\d{4})$", " $1:00 $2")
    for shape, pattern in _SHAPES:
        out = out.when(with_seconds.rlike(shape), F.try_to_timestamp(with_seconds, F.lit(pattern)))
    return out


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


# Seconds per unit of the two kinds of relative dates.
AGO_UNITS = {"sec": 1, "min": 60, "hour": 3600, "hr": 3600, "day": 86400, "week": 604800,
             "month": 2592000, "year": 31536000}
CALENDAR_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800,
                  "month": 2629800, "year": 31557600}


def _unit_map(units: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(v) for kv in units.items() for v in kv])


def ago(text: Column, as_of: Column, first_only: bool = False) -> Column:
    """"17 hrs 27 mins ago": all units summed, taken off ``as_of`` floored to the minute."""
    rx = r"(?i)\b(\d+|an?)\s*(sec|min|hour|hr|day|week|month|year)"
    counts = F.regexp_extract_all(text, F.lit(rx), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(rx), F.lit(2))
    if first_only:
        counts, units = F.slice(counts, 1, 1), F.slice(units, 1, 1)
    table = _unit_map(AGO_UNITS)
    seconds = F.aggregate(
        F.zip_with(counts, units, lambda n, u: F.coalesce(n.try_cast("bigint"), F.lit(1).cast("bigint"))
                   * F.element_at(table, F.lower(u))),
        F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    floor = F.date_trunc("minute", as_of)
    return F.when(seconds > 0, F.timestamp_seconds(F.unix_timestamp(floor) - seconds))


def relative(text: Column, as_of: Column) -> Column:
    """"7 days ago (edited)": one unit, average month and year lengths."""
    rx = r"(?i)(\d+)\s+(second|minute|hour|day|week|month|year)s?\s+ago"
    n = F.regexp_extract(text, rx, 1).try_cast("bigint")
    unit = F.element_at(_unit_map(CALENDAR_UNITS), F.lower(F.regexp_extract(text, rx, 2)))
    return F.when(text.rlike(rx), F.timestamp_seconds(F.unix_timestamp(as_of) - n * unit))


def local_to_utc(raw: Column, pattern: str, zone: str = "Asia/Kolkata") -> Column:
    """Wall clock of a zone -> UTC instant."""
    return F.to_utc_timestamp(F.try_to_timestamp(raw, F.lit(pattern)), zone)


def stamp_to_utc(raw: Column, zone: str = "Asia/Kolkata") -> Column:
    """"Updated On : 21 Jul 2026 | 11:13 AM IST"; without a clock it is midnight UTC."""
    rx = r"(?i)(\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4})(?:\s*\|\s*(\d{1,2}:\d{2}\s*[AP]\.?M))?"
    day = F.regexp_replace(F.regexp_extract(raw, rx, 1), r"\s+", " ")
    day = F.regexp_replace(day, r"^(\d{1,2} [A-Za-z]{3})[a-z]* ", "$1 ")
    clock = F.upper(F.regexp_replace(F.regexp_extract(raw, rx, 2), r"[\s.]", ""))
    timed = F.try_to_timestamp(F.concat_ws(" ", day, clock), F.lit("d MMM yyyy h:mma"))
    return F.when(clock != "", F.to_utc_timestamp(timed, zone)).otherwise(
        F.try_to_timestamp(F.when(day != "", day), F.lit("d MMM yyyy")))


def date_from_story_id(story_id: Column, as_of: Column) -> Column:
    """A 12-digit id shaped 1YYMMDDnnnnn -> its date; implausible digits -> NULL."""
    day = F.try_to_date(F.concat(F.lit("20"), F.substring(story_id, 2, 6)), "yyyyMMdd")
    ok = story_id.rlike(r"^1\d{11}$") & (F.year(day) <= F.year(as_of) + 1)
    return F.when(ok, day.cast("timestamp"))
