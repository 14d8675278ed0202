"""Publish dates and timestamps; the session's time zone is to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, norm_space

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
UNKNOWN_DATE = "公開日時不明"
_SHAPES = (
    ("^[0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4}$", "d MMM yyyy H:mm:ss Z"), ("^[0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2} [A-Z]{2,4}$", "d MMM yyyy H:mm:ss z"),
    ("^[0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9]{1,2}:[0-9]{2} [+-][0-9]{4}$", "d MMM yyyy H:mm Z"), ("^[0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$", "d MMM yyyy H:mm:ss"),
)
_ISO_SHAPE = "^[0-9]{4}(?:-[0-9]{2})?$|^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\\.[0-9]{1,9})?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$"


#: Months by their first three letters, and the hours that named zones are from UTC.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ZONES = {"z": 0, "ut": 0, "utc": 0, "gmt": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}
_CLOCK = "([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.]([0-9]{1,9}))?)?\\s*(?:([ap]m)(?![a-z]))?"
_ZONE = f"(?:(?<![a-z])({'|'.join(sorted(ZONES, key=len, reverse=True))})(?![a-z]))?\\s*(?:([+-])([0-9]{{1,2}}):?([0-9]{{2}})?)?"
_MONTH = f"(?<![a-z])({'|'.join(MONTHS)})[a-z]*"


def _number(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")).cast("long"), F.lit(0).cast("long"))


def _loose_date(plain: Column) -> Column:
    """A date in any common order, as ``new Date`` of browsers reads it.

    Words before the first number, and what stands in parentheses, say nothing; other words after it spoil the date. Of the
    numbers beside the time, those missing are 1. With a named month they are day and year, or year and day if the first is no
    day; without one, month, day and year, or year, month and day. Years below 50 are of this century, below 100 of the last. A day
    that its month lacks runs on into the next.
    """

    def read(text: Column) -> Column:
        clock = f"{_CLOCK}\\s*{_ZONE}"
        part = lambda i: F.regexp_extract(text, clock, i)
        hour, half = _number(part(1)), part(5)
        hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0)).otherwise(99)
        away = F.coalesce(*[F.when(part(6) == z, F.lit(h * 60)) for z, h in ZONES.items() if h], F.lit(0))
        away = away + F.when(part(7) == "-", -1).otherwise(1) * (_number(part(8)) * 60 + _number(part(9)))
        millis = ((hour * 60 + _number(part(2)) - away) * 60 + _number(part(3))) * 1000 + _number(F.substring(F.rpad(part(4), 3, "0"), 1, 3))
        rest = F.regexp_replace(F.regexp_replace(text, clock, " "), f"(?<![a-z])(?:{'|'.join(ZONES)})(?![a-z])", " ")
        named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(rest, _MONTH, 1))
        numbers = F.transform(F.regexp_extract_all(rest, F.lit("([0-9]+)"), F.lit(1)), lambda n: F.when(F.length(n) <= 6, n.cast("long")))
        spoilt = F.regexp_like(F.regexp_replace(rest, _MONTH, " "), F.lit("[0-9].*[a-z]")) | (hour > 23) | (_number(part(2)) > 59) | (_number(part(3)) > 59)
        shape = F.struct(named.alias("named"), F.concat(numbers, F.array_repeat(F.lit(1).cast("long"), 3)).alias("n"), F.size(numbers).alias("count"), millis.alias("millis"), spoilt.alias("spoilt"))
        return bound(shape, lambda x: F.when(~x["spoilt"] & x["count"].between(1, 3), _date_of(x)))

    return bound(F.lower(F.regexp_replace(plain, "\\([^)]*\\)", " ")), read)


def _date_of(x: Column) -> Column:
    a, b, c = (F.get(x["n"], i) for i in range(3))
    first_is_day, named = a.between(1, 31), x["named"] > 0
    year = F.when(named & first_is_day, b).when(~named & first_is_day, c).otherwise(a)
    month = F.when(named, x["named"]).when(first_is_day, a).otherwise(b)
    day = F.when(named & first_is_day, a).when(named | first_is_day, b).otherwise(c)
    year = F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)

    def made(d: Column) -> Column:
        days = F.unix_date(F.make_date(d["y"].cast("int"), d["m"].cast("int"), F.lit(1))) + d["d"] - 1
        return F.when(d["y"].between(1, 9999) & d["m"].between(1, 12) & d["d"].between(1, 31), F.timestamp_millis(days * 86_400_000 + x["millis"]))

    return bound(F.struct(year.alias("y"), month.alias("m"), day.alias("d")), made)


def parse_date(text: Column) -> Column:
    """Timestamp of an ISO 8601 or RFC 822 date, or of one in another common order; null where blank or none. Dates without a zone are UTC."""
    whole = norm_space(text)
    plain = F.regexp_replace(whole, "^[A-Za-z]{3,9},\\s*", "")
    tries = [F.when(F.regexp_like(plain, F.lit(shape)), F.try_to_timestamp(plain, F.lit(form))) for shape, form in _SHAPES]
    return F.coalesce(F.when(F.regexp_like(plain, F.lit(_ISO_SHAPE)), F.try_to_timestamp(plain)), *tries, F.when(F.regexp_like(whole, F.lit("[0-9]")), _loose_date(whole)))


def iso(ts: Column) -> Column:
    return F.date_format(ts, ISO)


def date_label(ts: Column, zone: str = "UTC") -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, zone), "yyyy/MM/dd H:mm"), F.lit(UNKNOWN_DATE))
