"""Column functions for market reports: digits, prices, dates, units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn import dictionaries as D

DIGITS = "০১২৩৪৫৬৭৮৯"
#: Numbers by themselves: no digit or point beside them.
_RANGE = "(?<![0-9.])([0-9]+(?:\\.[0-9]+)?)[ \\t]*-[ \\t]*([0-9]+(?:\\.[0-9]+)?)(?![0-9.])"
_NUMBERS = "[0-9]+(?:\\.[0-9]+)*\\.?"
_DATE = "(?<![0-9])([0-9]{1,2})[ \\t]*[./-][ \\t]*([0-9]{1,2})[ \\t]*[./-][ \\t]*(20[0-9]{2})(?![0-9])"


def ascii_digits(c: Column) -> Column:
    return F.translate(c, DIGITS, "0123456789")


def normalize(c: Column) -> Column:
    """ASCII digits, one kind of dash, danda as a point, no blanks around a closing bracket."""
    return F.trim(F.regexp_replace(F.translate(ascii_digits(c), "‐‑‒–—−।", "------."), "[ \\t]*\\)[ \\t]*", ")"))


def parse_price(c: Column, thousands: bool = True) -> Column:
    """STRUCT<lo, hi>: a range, else one number, else the first two; null if none lies in (0, 1e6].

    ``thousands`` reads 1,200 as one number.
    """
    v = normalize(c)
    if thousands:
        v = F.regexp_replace(v, "([0-9]),([0-9]{3})", "$1$2")
    lo, hi = (F.regexp_extract(v, _RANGE, i).try_cast("double") for i in (1, 2))
    fits = lambda x: (x > 0) & (x <= 1e6)
    own = F.filter(F.transform(F.regexp_extract_all(v, F.lit(_NUMBERS), F.lit(0)), lambda x: x.try_cast("double")), fits)
    pair = lambda a, b: F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    return (
        F.when(fits(lo) & fits(hi), pair(lo, hi))
        .when(F.size(own) == 1, pair(F.get(own, 0), F.get(own, 0)))
        .when(F.size(own) >= 2, pair(F.get(own, 0), F.get(own, 1)))
    )


def parse_date(c: Column) -> Column:
    """The first valid day-month-year with any of ./- between, in 2000 to 2099; null if there is none."""

    def read(x):
        d, m, y = (F.regexp_extract(x, _DATE, i) for i in (1, 2, 3))
        return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    found = F.transform(F.regexp_extract_all(ascii_digits(c), F.lit(_DATE), F.lit(0)), read)
    return F.get(F.filter(found, lambda x: x.isNotNull()), 0)


def format_price(c: Column) -> Column:
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(F.format_string("%.2f", c))


def format_range(lo: Column, hi: Column, single: bool = False, sign: str = "৳") -> Column:
    """Both ends; with ``single``, one price where they are equal."""
    both = F.concat(F.lit(sign), format_price(lo), F.lit(f" - {sign}"), format_price(hi))
    return F.when(lo == hi, F.concat(F.lit(sign), format_price(lo))).otherwise(both) if single else both


def normalize_unit(c: Column, units=D.UNITS) -> Column:
    """The unit whose words the cell holds, or whose pattern it matches, the first in order; other cells as they are."""
    v = F.regexp_replace(F.lower(normalize(c)), "[ \\t]+", " ")
    out = F.when(v == "", F.lit(""))
    for unit, words in units:
        out = out.when(v.rlike(words) if isinstance(words, str) else any_in(v, words), F.lit(unit))
    return out.otherwise(normalize(c))


def spellings(words: tuple[str, ...]) -> list[str]:
    """Words, and those with letters that are written in two ways (with the dot below as a sign of its own)."""
    pairs = {"\u09dc": "\u09a1\u09bc", "\u09dd": "\u09a2\u09bc", "\u09df": "\u09af\u09bc"}
    out = []
    for w in words:
        one, two = w, w
        for a, b in pairs.items():
            one, two = one.replace(b, a), two.replace(a, b)
        out += [one] if one == two else [one, two]
    return out


def any_in(c: Column, words) -> Column:
    """Whether a text holds one of a short list of words, in either spelling."""
    found = F.lit(False)
    for w in spellings(tuple(words)):
        found = found | F.contains(c, F.lit(w))
    return found


def date_in(c: Column, day: Column) -> Column:
    """Whether a text has this day, with or without leading zeros, and any of ./- between."""
    part = lambda x: F.concat(F.lit("0?"), x.cast("string"))
    gap = F.lit("[ \\t]*[./-][ \\t]*")
    pattern = F.concat(F.lit("(?<![0-9])"), part(F.dayofmonth(day)), gap, part(F.month(day)), gap, F.year(day).cast("string"), F.lit("(?![0-9])"))
    return F.regexp_like(ascii_digits(c), pattern)


def is_price_like(c: Column) -> Column:
    """A cell with two numbers, joined by a dash or a blank, and no per cent."""
    v = normalize(c)
    return ~F.contains(v, F.lit("%")) & v.rlike("[0-9][0-9,.]*(?:[ \\t]*-[ \\t]*|[ \\t]+)[0-9]")


def cache_key(*parts: Column, version: str = "v2") -> Column:
    return F.concat_ws("__", F.lit(version), *parts)
