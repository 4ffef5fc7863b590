"""Column functions over texts. All run in the JVM; patterns keep to what Java and RE2 read alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn import dictionaries as D

TOKEN = f"[{D.BANGLA}a-zA-Z0-9]+"
SPACE = "[ \\t\\n\\x0B\\f\\r\\u00A0]"
SPACES = "[ \\t\\u00A0]+"
#: A line that is a number, and the characters that shares of a script leave out.
BARE_NUMBER = "^[ \\t০-৯0-9|.\\-–]{1,10}$"
#: Characters that a script's share is taken of.
LINE_CHARS = "[^ \\t\\n\\x0B\\f\\r\\p{Nd}.,;:()\\-|/]"
QUERY_CHARS = "[^ \\t\\n\\x0B\\f\\r\\p{Nd}.,;:()\\-!?]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def script_ratio(c: Column, script: str = D.BANGLA, of: str = LINE_CHARS) -> Column:
    """Characters of a script over all that are no space, digit or mark; 0 where there are none."""
    n = F.regexp_count(c, F.lit(of))
    return F.when(n > 0, F.regexp_count(c, F.lit(f"[{script}]")) / n).otherwise(F.lit(0.0))


def script_of(c: Column, script: str = D.BANGLA, name: str = "bangla", least: float = 0.7) -> Column:
    """bangla (or ``name``), latin, mixed, or unknown for a text without letters."""
    n = F.regexp_count(c, F.lit(QUERY_CHARS))
    own, latin = F.regexp_count(c, F.lit(f"[{script}]")), F.regexp_count(c, F.lit("[A-Za-z]"))
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, F.lit("unknown"))
        .when(own / n >= least, F.lit(name))
        .when(latin / n >= least, F.lit("latin"))
        .otherwise(F.lit("mixed"))
    )


def squeeze(c: Column) -> Column:
    """Runs of blanks as one space, at most one empty line, no space at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(c, SPACES, " "), "\\n{3,}", "\n\n"))


def expand_synonyms(c: Column, synonyms: dict[str, list[str]] = D.SYNONYMS) -> Column:
    """The text with the synonyms of each trigger it holds appended; never rewritten."""
    more = [F.when(F.contains(c, F.lit(k)), F.lit(" ".join(v))) for k, v in synonyms.items()]
    return F.concat_ws(" ", c, *more)


def sanitize(c: Column, most: int = 1000, keep_joiners: bool = True) -> Column:
    """Without characters that don't print (line feeds and tabs stay), stripped, cut at ``most`` characters.

    Joiners (U+200C, U+200D) carry meaning in Bangla and stay by default.
    """
    joiners = "\\u200C\\u200D" if keep_joiners else ""
    gone = f"[[\\p{{C}}\\p{{Zl}}\\p{{Zp}}\\p{{Zs}}]&&[^\\n\\t {joiners}]]"
    return F.substring(strip(F.regexp_replace(F.coalesce(c, F.lit("")), gone, "")), 1, most)


def injection(c: Column, patterns=D.INJECTIONS) -> Column:
    """The first pattern that the text matches, without regard to case; null if none."""
    return F.coalesce(*[F.when(c.rlike("(?i)" + p), F.lit(p)) for p in patterns])


#: A token that is a number, price, range or date, after marks at its ends are cut off.
_NUM = "[0-9০-৯]+(?:[.,][0-9০-৯]+)?"
_CUR = "(?:৳|[Tt][Kk]\\.?|[Bb][Dd][Tt])?"
_PART = "[0-9০-৯]{1,4}"
NUMERIC = f"^(?:{_PART}[./\\\\–—‑-]{_PART}[./\\\\–—‑-]{_PART}|{_CUR}{_NUM}|{_CUR}{_NUM}[–—‑-]{_CUR}{_NUM})$"
#: Marks around a token.
MARKS = ".,;:!?()[]{}<>\"'“”‘’*"
_MARK_CLASS = "[.,;:!?()\\[\\]{}<>\"'“”‘’*]+"
#: Fixed value: letters and vowel signs of the script.
LETTER = "[\\u0985-\\u09B9\\u09BE-\\u09CC\\u09CE\\u09D7\\u09DC-\\u09DF]"


def is_garbage(t: Column, least_chars: int = 6, least_digits: int = 3) -> Column:
    """Whether a token looks like debris: long, digits and brackets, no letter of the script, no number or date."""
    core = F.regexp_replace(t, f"^{_MARK_CLASS}|{_MARK_CLASS}$", "")
    # the cheapest conditions, which most tokens fail, come first
    return (
        (F.length(t) >= least_chars)
        & t.rlike("[()\\[\\]/:|]")
        & (F.regexp_count(t, F.lit("\\p{Nd}")) >= least_digits)
        & ~t.rlike(LETTER)
        & ~core.rlike(NUMERIC)
    )


def words(c: Column) -> Column:
    return F.filter(F.split(c, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def has_garbage(c: Column) -> Column:
    return F.exists(words(c), lambda w: is_garbage(w))


def strip_garbage(c: Column) -> Column:
    """Without garbage tokens, line breaks kept; unchanged if nothing or everything would go."""
    line = lambda x: F.array_join(F.filter(words(x), lambda w: ~is_garbage(w)), " ")
    cleaned = F.array_join(F.transform(F.split(c, "\n"), line), "\n")
    return F.when(has_garbage(c) & (F.regexp_replace(cleaned, "[ \\n]", "") != ""), cleaned).otherwise(c)


#: What strip_sources removes, in this order; the first cuts the rest of the text off.
SOURCE_BLOCK = "(?is)\\n[ \\t\\n]*(?:---[ \\t]*SOURCES[ \\t]*---|Sources?[ \\t]*/?[ \\t]*তথ্যসূত্র|তথ্যসূত্র|উৎস(?:সমূহ)?[ \\t]*:?)[ \\t]*\\n?.*$"
SOURCE_INLINE = (
    "(?i)[ \\t\\n]*\\((?:[^()\\n]{0,140}(?:\\.pdf|পৃষ্ঠা|page)[^()\\n]{0,80})\\)",
    "(?i)[ \\t\\n]*\\[[^\\]\\n]{0,180}(?:\\.pdf|পৃষ্ঠা|page)[^\\]\\n]{0,80}\\]",
    "(?i)[ \\t\\n]*(?:উৎস|source|sources)[ \\t]*:[ \\t]*[^\\n]+",
)


def strip_sources(c: Column) -> Column:
    """Without source lists and inline citations."""
    c = F.regexp_replace(c, SOURCE_BLOCK, "")
    for p in SOURCE_INLINE:
        c = F.regexp_replace(c, p, "")
    return strip(F.regexp_replace(F.regexp_replace(c, "[ \\t]{2,}", " "), "\\n{3,}", "\n\n"))


def looks_incomplete(c: Column, least_words: int = 18) -> Column:
    """A long text that doesn't end in a closing mark."""
    return (F.size(words(c)) >= least_words) & ~strip(c).rlike("[.!?।॥:;)\\]}»”\"'’]$")


def long_lines_repeat(c: Column, times: int = 3, least_words: int = 8) -> Column:
    """Whether a line of enough words stands so many times in a text."""
    lines = F.transform(F.split(F.lower(c), "\n"), lambda x: F.array_join(words(x), " "))
    # sorted, a line that stands so often equals the one times - 1 places further on
    long = F.array_sort(F.filter(lines, lambda x: F.size(F.split(x, " ")) >= least_words))
    later = F.slice(long, F.lit(times), F.greatest(F.size(long), F.lit(0)))
    return F.exists(F.zip_with(long, later, lambda x, y: x.eqNullSafe(y)), lambda e: e)


def soften(c: Column, overclaims=D.OVERCLAIMS) -> Column:
    for pattern, to in overclaims:
        c = F.regexp_replace(c, pattern, to)
    return c


def enforce_uncertainty(answer: Column, tier: Column, notice: str, hedges=D.HEDGES, overclaims=D.OVERCLAIMS) -> Column:
    """For amber and red: overclaims softened; ``notice`` in front unless the text hedged and claimed nothing too much."""
    soft = soften(answer, overclaims)
    hedged = F.lit(False)
    for h in hedges:
        hedged = hedged | F.contains(answer, F.lit(h))
    return (
        F.when(F.coalesce(~tier.isin("amber", "red"), F.lit(True)), answer)
        .when(hedged & (soft == answer), answer)
        .otherwise(F.concat(F.lit(notice), soft))
    )


def without_fences(c: Column) -> Column:
    """A reply without the Markdown fences around it."""
    return strip(F.regexp_replace(c, "^[ \\t\\n]*```[a-zA-Z]*|```[ \\t\\n]*$", ""))


def nfkc(c: Column) -> Column:
    """Compatibility form without zero-width characters. Spark has no such function, so texts go through Arrow."""
    import unicodedata

    import pandas as pd

    def normal(s):
        drop = dict.fromkeys(map(ord, "\u200b\u200c\u200d\u2060\ufeff"))
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).translate(drop))

    normal.__annotations__ = {"s": pd.Series, "return": pd.Series}  # real types: this module's annotations are strings
    return F.pandas_udf(normal, "string")(c)


def table_text(c: Column) -> Column:
    """An array of rows of cells as lines, cells joined by bars, empty ones left out."""
    return F.array_join(F.transform(c, lambda r: F.array_join(F.filter(r, lambda x: x != ""), " | ")), "\n")
