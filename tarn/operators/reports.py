"""Market reports: as-of pick, inferred columns, inherited cells, first matching row, cache validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import market as M
from tarn.operators.many_words import occurring


def latest(rows: DataFrame, key: str, date: str, as_of: Column, tie: str, max_age_days: int = 0) -> DataFrame:
    """The last row of each key by ``as_of``; with ``max_age_days`` none older. ``tie`` orders rows of one date."""
    known = rows.where(F.col(date) <= as_of)
    if max_age_days:
        known = known.where(F.col(date) >= as_of - F.expr(f"INTERVAL {max_age_days} DAYS"))
    best = known.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(date, tie)).alias("__r"))
    return best.select("__r.*")


def inherited(rows: DataFrame, column: str, by: list[str], order: list, to: str) -> DataFrame:
    """``column`` with gaps filled by the last value before them in the group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(to, F.last(column, ignorenulls=True).over(w))


def price_column(cells: DataFrame, by: list[str], column: str, cell: str, least: int = 2) -> DataFrame:
    """The column of each table with the most price-like cells, the first of equals; none below ``least``."""
    n = cells.groupBy(*by, column).agg(F.count_if(M.is_price_like(F.col(cell))).alias("prices"))
    best = n.groupBy(*by).agg(F.max_by(F.struct(column, "prices"), F.struct("prices", -F.col(column))).alias("r"))
    return best.select(*by, "r.*").where(F.col("prices") >= least)


def current_header(c: Column, date_pattern: str, markers: tuple[str, ...], against: tuple[str, ...]) -> Column:
    """A header with the report's date and a marker of current prices, and none of comparison."""
    v = F.lower(M.normalize(c))
    has = lambda words: F.coalesce(*[F.when(F.contains(v, F.lit(w)), F.lit(True)) for w in words], F.lit(False))
    return v.rlike(date_pattern) & has(markers) & ~has(against)


def first_match(wanted: DataFrame, rows: DataFrame, variants: str, text: str, order: list[str]) -> DataFrame:
    """For each wanted name, the first row in order whose text holds one of its variants (an array column).

    All variants are looked for in one pass over a text, and only hits are shuffled.
    """
    each = wanted.withColumn("__v", F.explode(variants))
    hits = occurring(rows, F.col(text), each, "__v").drop("__v", "at")
    w = Window.partitionBy("name").orderBy(*order)
    return hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def unpivoted(table: DataFrame, key: str, columns: list[str], name: str, value: str) -> DataFrame:
    """One row for each filled cell of a crosstab."""
    return table.unpivot(key, columns, name, value).where(F.col(value).isNotNull())


def cache_valid(saved_at: Column, report_date: Column, as_of: Column, hours: float) -> Column:
    """Between 0 and ``hours`` old, and no report from the future; anything missing is a miss."""
    age = (as_of.cast("timestamp").cast("double") - saved_at.cast("timestamp").cast("double")) / 3600
    return F.coalesce((age >= 0) & (age <= hours) & (report_date <= as_of), F.lit(False))


def omitted(rows: DataFrame, by: list[str], looks_omitted: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.count_if(looks_omitted).alias("omitted"), F.count("*").alias("seen"))


def ticker(pages: DataFrame, text: str, variants: DataFrame, span: int = 300) -> DataFrame:
    """(crop, lo, hi, ...) by the first variant of each crop, in order, that a parsable price follows in a page.

    All ``variants`` (crop, variant, place) are looked for in one pass over a page.
    """
    hits = occurring(pages, M.normalize(F.col(text)), variants, "variant")
    priced = hits.withColumn("price", M.parse_price(F.substring(M.normalize(F.col(text)), F.col("at") + 1, F.lit(span)))).where("price is not null")
    keys = [c for c in pages.columns if c != text]
    best = priced.groupBy(*keys, "crop").agg(F.min_by("price", "place").alias("p"))
    return best.select(*keys, "crop", "p.lo", "p.hi")


def repaired(c: Column, corrections: dict[str, str]) -> Column:
    """Names with misread parts replaced, the longest first, blanks squeezed and one unclosed bracket closed."""
    for wrong in sorted(corrections, key=lambda x: (-len(x), x)):
        c = F.replace(c, F.lit(wrong), F.lit(corrections[wrong]))
    c = F.trim(F.regexp_replace(c, "[ \\t]+", " "))
    opened = F.regexp_count(c, F.lit("\\(")) - F.regexp_count(c, F.lit("\\)"))
    return F.when(opened == 1, F.concat(c, F.lit(")"))).otherwise(c)
