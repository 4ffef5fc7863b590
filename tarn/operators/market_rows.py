"""Rows of market tables: price columns, products with their category and unit, what is too unclear to show, and prices by division.

A report's tables come as rows (keys of the report, table_no, row_no, cells, report_date). Everything is column expressions
and windows; only the price column of a table depends on the table before it, which a fold over a report's tables settles.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn import dictionaries as D
from tarn.functions import market as M
from tarn.sources.files import stored

from . import reports as P
from .many_words import occurring


@dataclass(frozen=True)
class Words:
    """Word lists that rows are read by; a caller's own may stand for each."""

    unit_marks: tuple = D.UNIT_MARKS
    units: tuple = D.UNITS
    noise: tuple = D.HEADER_NOISE
    ditto: tuple = D.DITTO
    qualifiers: tuple = D.QUALIFIERS
    pulses: tuple = D.PULSES
    pulse_names: tuple = D.PULSE_NAMES
    own_units: dict = field(default_factory=lambda: D.OWN_UNITS)
    oils: tuple = D.OILS
    eggs: tuple = D.EGGS
    flesh: tuple = D.FLESH
    by_piece: tuple = D.BY_PIECE
    confident: tuple = D.CONFIDENT
    roots: tuple = D.ROOTS
    allowed: dict = field(default_factory=lambda: D.ALLOWED)
    only_with: dict = field(default_factory=lambda: D.ONLY_WITH)
    current: tuple = D.CURRENT
    compared: tuple = D.COMPARED
    compared_surely: tuple = D.COMPARED_SURELY
    unit_cells: tuple = D.UNIT_CELLS
    repairs: tuple = D.NAME_REPAIRS
    corrections: dict = field(default_factory=dict)  # misread phrases, for the caller to supply
    letters: str = "\\u0980-\\u09FF"
    marks: str = "\\u0981-\\u0983\\u09BC\\u09BE-\\u09CD\\u09CE\\u09D7"
    litre: str = "প্রতি লিটার"
    kilogram: str = "প্রতি কেজি"
    piece: str = "প্রতিটি"
    known_units: tuple = ("প্রতি হালি", "প্রতি কেজি", "প্রতি গ্রাম", "প্রতিটি")


def _settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with columns that are worked out once.

    A filter on a plain column is pushed below the projection that makes it, with the whole expression in place of each of
    its uses; nothing is pushed below a generator that it reads from.
    """
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__x")
    others = [c for c in rows.columns if c not in columns]
    return rows.select(*others, one).select(*others, *[F.col("__x")[n].alias(n) for n in columns])


def clean_rows(rows: DataFrame) -> DataFrame:
    """Cells normalized, missing ones empty; rows without any filled cell go."""
    cells = F.transform("cells", lambda x: M.normalize(F.coalesce(x, F.lit(""))))
    return _settled(rows, cells=cells).where(F.exists("cells", lambda x: x != ""))


def name_of(c: Column, w: Words = Words()) -> Column:
    """A product's name: misread phrases replaced, the longest first, then repairs by pattern, one open bracket closed."""
    c = M.normalize(c)
    for wrong in sorted(w.corrections, key=lambda x: (-len(x), x)):
        c = F.replace(c, F.lit(wrong), F.lit(w.corrections[wrong]))
    for pattern, to in w.repairs:
        c = F.regexp_replace(c, pattern, to)
    opened = F.regexp_count(c, F.lit("\\(")) > F.regexp_count(c, F.lit("\\)"))
    return F.regexp_replace(F.when(opened, F.concat(c, F.lit(")"))).otherwise(c), "^[ –—-]+|[ –—-]+$", "")


def is_unit(c: Column, w: Words = Words()) -> Column:
    """Whether a cell is a unit: it holds a unit's mark, or matches the pattern of one."""
    v = F.lower(M.normalize(c))
    whole = M.ascii_digits(v).rlike("^(?:" + "|".join(w.unit_cells) + ")$") if w.unit_cells else F.lit(False)
    for _, pattern in w.units:
        whole = whole | v.rlike(pattern) if isinstance(pattern, str) else whole
    return (v != "") & (M.any_in(v, w.unit_marks) | whole)


def row_unit(cells: Column, price_at: Column, w: Words = Words()) -> Column:
    """The first unit left of the price, among five cells at most; empty if there is none."""
    left = F.slice(cells, F.lit(1), F.least(price_at, F.lit(5)))
    return F.coalesce(M.normalize_unit(F.get(F.filter(left, lambda x: is_unit(x, w)), F.lit(0)), w.units), F.lit(""))


def _starts(c: Column, words) -> Column:
    found = F.lit(False)
    for x in M.spellings(tuple(words)):
        found = found | (c == x) | c.startswith(x + " ")
    return found


def unit_of(product: Column, unit: Column, w: Words = Words()) -> Column:
    """The unit of a product: what its family is sold by, else the cell's; litres only for oil, kilograms by default."""
    out = F.lit(None).cast("string")
    own = F.coalesce(*[F.when(_starts(product, (k,)), F.lit(v)) for k, v in w.own_units.items()], out)
    low = F.lower(product)
    return (
        F.when(own.isNotNull(), own)
        .when(M.any_in(low, w.eggs), F.lit(w.piece))
        .when(M.any_in(low, w.flesh), F.lit(w.kilogram))
        .when(M.any_in(low, w.oils), F.lit(w.litre))
        .when(M.any_in(low, w.by_piece), F.lit(w.piece))
        .when(unit.isin(*w.known_units), unit)
        .otherwise(F.when(product != "", F.lit(w.kilogram)).otherwise(unit))
    )


def _is_noise(c: Column, w: Words) -> Column:
    return F.regexp_replace(c, " ", "").isin(*[x.replace(" ", "") for x in w.noise])


def with_product(rows: DataFrame, cells: str, price_at: str, w: Words = Words()) -> DataFrame:
    """Rows with product and category: shifted columns, marks of repetition, header rows and qualifiers are settled.

    A repetition mark stands for what an earlier cell of the same row says. Rows without a product have an empty one.
    """
    digits = lambda c: c.rlike("^[0-9]+$")
    usable = lambda c: c.isNotNull() & ~c.isin(*w.ditto) & ~digits(c)
    third = F.coalesce(F.get(cells, F.lit(2)), F.lit(""))
    named = _settled(rows, **{f"__n{i}": name_of(F.get(cells, F.lit(i)), w) for i in range(3)}, __late=(third != "") & ~is_unit(third, w))
    late, n0, n1, n2 = (F.col(c) for c in ("__late", "__n0", "__n1", "__n2"))
    earlier = F.coalesce(F.when(late & usable(n1), n1), F.when(usable(n0), n0), F.lit(""))
    raw = F.coalesce(F.when(late, n2).otherwise(n1), F.lit(""))
    named = _settled(named, __p=F.when(raw.isin(*w.ditto), earlier).otherwise(raw))
    p = F.col("__p")
    none = (F.col(price_at) <= 0) | (p == "") | digits(p) | is_unit(p, w) | (F.regexp_count(p, F.lit(f"[{w.letters}]")) < 2) | _is_noise(p, w)
    kind = F.when(late & usable(n1) & ~_is_noise(n1, w) & ~is_unit(n1, w), n1).otherwise(F.lit(""))
    named = _settled(_settled(named, __none=none, __kind=kind), __p=F.when(F.col("__none"), F.lit("")).otherwise(p), __k=F.when(F.col("__none"), F.lit("")).otherwise(F.col("__kind")))
    p, k = F.col("__p"), F.col("__k")
    same = (p == k) | p.startswith(F.concat(k, F.lit(" "))) | p.startswith(F.concat(k, F.lit("(")))
    begins = F.lit(False)
    for x in w.pulse_names:
        begins = begins | p.startswith(x)
    pulse = k.isin(*w.pulses) & begins
    word = F.lit(w.pulses[0]) if w.pulses else F.lit("")
    as_pulse = (
        F.when(F.contains(p, word), p)
        .when(F.contains(p, F.lit(" (")), F.regexp_replace(p, "^(.*?) \\(", f"$1 {w.pulses[0] if w.pulses else ''} ("))
        .otherwise(F.concat(p, F.lit(" "), word))
    )
    part = M.any_in(F.lower(p), w.qualifiers)
    merged = F.when((k == "") | same, p).when(pulse, as_pulse).when(part, F.concat(k, F.lit(" ("), p, F.lit(")"))).otherwise(p)
    out = _settled(_settled(named, __m=merged), product=name_of(F.col("__m"), w), category=F.when((k == "") | same | pulse | part, F.lit("")).otherwise(k))
    return out.drop("__n0", "__n1", "__n2", "__late", "__p", "__k", "__none", "__kind", "__m")


def is_ambiguous(c: Column, w: Words = Words()) -> Column:
    """A product's name that can't be told for sure: broken letters, no known word, debris, or an unknown root or qualifier."""
    letters, marks = F.regexp_count(c, F.lit(f"[[{w.letters}]&&[^{w.marks}]]")), F.regexp_count(c, F.lit(f"[{w.marks}]"))
    bad = (c == "") | c.rlike(f"^[{w.marks}0-9০-৯]") | c.rlike(f"[)/:] *[{w.marks}]") | c.rlike(f"\\( *[{w.marks}]")
    bad = bad | (letters < 2) | (marks > 2 * letters + 3) | ~M.any_in(F.lower(c), w.confident) | c.rlike("\\) *[0-9০-৯][0-9০-৯ –—-]*$")
    for root, needed in w.only_with.items():
        bad = bad | (c.startswith(root) & ~F.contains(c, F.lit(needed)))
    root = F.regexp_replace(F.substring_index(c, "(", 1), "^[ –—-]+|[ –—-]+$", "")
    inner = F.trim(F.regexp_extract(c, "\\((.*)\\)", 1))
    strange = ~_starts(root, w.roots)
    for name, fits in w.allowed.items():
        strange = strange | ((root == name) & ~inner.isin(*fits))
    return F.coalesce(bad | (F.contains(c, F.lit("(")) & strange), F.lit(True))


def is_omitted(cells: Column, price_at: Column, product: Column, w: Words = Words()) -> Column:
    """A priced row whose left cells say something, but not which product; headers, units and numbers don't count."""
    left = F.transform(F.slice(cells, F.lit(1), F.least(price_at, F.lit(4))), lambda x: name_of(x, w))
    told = F.filter(left, lambda x: (x != "") & ~x.rlike("^[0-9]+$") & ~is_unit(x, w))
    joined = F.regexp_replace(F.array_join(told, " "), " ", "")
    return (product == "") & ~_is_noise(joined, w) & (F.length(joined) >= 2)


def price_columns(rows: DataFrame, by: list[str], w: Words = Words(), header_rows: int = 8) -> DataFrame:
    """(by, table_no, price_at): the current prices' column of each table.

    By the header (the report's date with a word of current prices, else the date alone, never a comparison); else the
    column of the table before, if it still holds enough prices; else the column with the most price-like cells.
    """
    key = [*by, "table_no"]
    head = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy("row_no"))).where(F.col("__r") <= header_rows)
    cells = head.select(*key, "__r", "report_date", F.posexplode("cells").alias("col", "cell"))
    text = F.lower(M.normalize(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", "cell"))), lambda x: x["cell"]), " ")))
    titles = cells.groupBy(*key, "col").agg(text.alias("t"), F.first("report_date").alias("d"))
    dated = M.date_in(F.col("t"), F.col("d"))
    named = dated & ~M.any_in(F.col("t"), w.compared) & M.any_in(F.col("t"), w.current)
    likely = dated & ~M.any_in(F.col("t"), w.compared_surely)
    found = titles.groupBy(*key).agg(F.coalesce(F.min(F.when(named, F.col("col"))), F.min(F.when(likely, F.col("col")))).alias("head"))
    scores = rows.select(*key, F.posexplode("cells").alias("col", "cell")).groupBy(*key, "col").agg(F.count_if(M.is_price_like(F.col("cell"))).cast("int").alias("n"))
    sizes = rows.groupBy(*key).agg(F.count("*").cast("int").alias("size"))
    scores = scores.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "n"))), lambda x: x["n"]).alias("scores"))
    tables = found.join(scores, key).join(sizes, key)
    every = tables.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("table_no", "head", "scores", "size"))).alias("tables"))

    def column_of(before, x):
        enough = F.greatest(F.lit(1), F.least(F.lit(3), F.floor(x["size"] / 4).cast("int")))
        best = F.array_max(x["scores"])
        inferred = F.when(best >= F.greatest(F.lit(2), F.least(F.lit(4), F.floor(x["size"] / 3).cast("int"))), (F.array_position(x["scores"], best) - 1).cast("int"))
        again = F.when(before.isNotNull() & (F.coalesce(F.get(x["scores"], before), F.lit(-1)) >= enough), before)
        return F.coalesce(x["head"], again, inferred)

    # the state is the columns so far and the last one found: a report has few tables
    start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<struct<table_no:int,price_at:int>>").alias("out"))

    def step(state, x):
        at = column_of(state["last"], x)
        row = F.struct(x["table_no"].cast("int").alias("table_no"), at.alias("price_at"))
        return F.struct(F.coalesce(at, state["last"]).alias("last"), F.concat(state["out"], F.array(row)).alias("out"))

    folded = every.select(*by, F.explode(F.aggregate("tables", start, step)["out"]).alias("x"))
    return folded.select(*by, F.col("x.table_no").alias("table_no"), F.col("x.price_at").alias("price_at")).where("price_at is not null")


def priced_rows(rows: DataFrame, by: list[str], w: Words = Words()) -> DataFrame:
    """Rows with a readable price: lo, hi, product (unclear or not), category, and the unit of their own cell (unit_cell)."""
    rows = stored(clean_rows(rows))  # read four times
    met = rows.join(price_columns(rows, by, w), [*by, "table_no"])
    # dealt by rows: there are few tables, and rows pack so well that Spark would read them all in one task
    met = met.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "table_no", "row_no")
    met = _settled(met, price=M.parse_price(F.get("cells", F.col("price_at")))).where("price is not null")
    met = with_product(met, "cells", "price_at", w)
    met = _settled(met, lo=F.col("price.lo"), hi=F.col("price.hi"), unit_cell=row_unit(F.col("cells"), F.col("price_at"), w), unclear=is_ambiguous(F.col("product"), w))
    return met.drop("price")


def market_items(rows: DataFrame, by: list[str], w: Words = Words()) -> DataFrame:
    """(by, place, product, category, lo, hi, price_range, unit): each product of a report once, where it stands first.

    A row without a unit of its own has that of the last shown row above it in its table, before the product's family decides.
    """
    return _items(priced_rows(rows, by, w), by, w)


def _items(priced: DataFrame, by: list[str], w: Words) -> DataFrame:
    shown = priced.where(~F.col("unclear"))
    own = F.when(F.col("unit_cell") != "", F.col("unit_cell"))
    above = Window.partitionBy(*by, "table_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    shown = shown.withColumn("unit", unit_of(F.col("product"), F.coalesce(F.last(own, ignorenulls=True).over(above), F.lit("")), w))
    once = shown.groupBy(*by, F.lower("product").alias("__p")).agg(F.min_by(F.struct("table_no", "row_no", "product", "category", "lo", "hi", "unit"), F.struct("table_no", "row_no")).alias("x"))
    order = Window.partitionBy(*by).orderBy("x.table_no", "x.row_no")
    return once.withColumn("place", F.row_number().over(order)).select(
        *by, "place", "x.product", "x.category", "x.lo", "x.hi", M.format_range(F.col("x.lo"), F.col("x.hi"), True).alias("price_range"), "x.unit"
    )


def omitted_counts(rows: DataFrame, by: list[str], w: Words = Words()) -> DataFrame:
    """(by, omitted): priced rows of each report that aren't shown, as their product is unclear."""
    return _omitted(priced_rows(rows, by, w), by, w)


def _omitted(p: DataFrame, by: list[str], w: Words) -> DataFrame:
    left_out = is_omitted(F.col("cells"), F.col("price_at"), F.col("product"), w) | ((F.col("product") != "") & F.col("unclear"))
    return p.groupBy(*by).agg(F.count_if(left_out).alias("omitted"))


def latest_reports(rows: DataFrame, division: str, as_of: Column, max_age_days: int = 0) -> DataFrame:
    """The rows of each division's last report by ``as_of``."""
    days = rows.select(division, "report_date").distinct().where(F.col("report_date") <= as_of)
    if max_age_days:
        days = days.where(F.col("report_date") >= F.date_sub(as_of, max_age_days))
    return rows.join(days.groupBy(division).agg(F.max("report_date").alias("report_date")), [division, "report_date"])


def market_prices(rows: DataFrame, division: str, as_of: Column, w: Words = Words(), max_age_days: int = 0) -> DataFrame:
    """All products of each division's last report, with the number of rows that it leaves out."""
    last = latest_reports(rows, division, as_of, max_age_days)
    by = [division, "report_date"]
    priced = stored(priced_rows(last, by, w))  # read twice
    return _items(priced, by, w).join(_omitted(priced, by, w), by)


def crop_prices(rows: DataFrame, division: str, crops: DataFrame, as_of: Column, w: Words = Words(), max_age_days: int = 0) -> DataFrame:
    """(division, crop, lo, hi, price_range, middle, unit, report_date): the first row of each division's last report whose
    first four cells hold a variant of the crop (``crops``: crop, variants)."""
    by = [division, "report_date"]
    found = priced_rows(latest_reports(rows, division, as_of, max_age_days), by, w)
    left = F.lower(F.array_join(F.slice("cells", 1, 4), " "))
    wanted = crops.select("crop", F.explode("variants").alias("v")).select("crop", F.lower(M.normalize(F.col("v"))).alias("v"))
    hits = occurring(found.withColumn("__left", left), F.col("__left"), wanted, "v")
    first = hits.groupBy(*by, "crop").agg(F.min_by(F.struct("product", "lo", "hi", "unit_cell"), F.struct("table_no", "row_no")).alias("x"))
    unit = unit_of(F.col("x.product"), F.col("x.unit_cell"), w)
    middle = F.bround((F.col("x.lo") + F.col("x.hi")) / 2, 2)
    return first.select(division, "crop", "x.lo", "x.hi", M.format_range(F.col("x.lo"), F.col("x.hi")).alias("price_range"), middle.alias("middle"), unit.alias("unit"), "report_date")


def through_cache(asked: DataFrame, cache: DataFrame, key: str, compute, as_of: Column, hours: float, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Answers to ``asked`` (key, ...), and those to be stored.

    ``cache`` has key, saved_at, report_date and result; ``compute`` turns the keys that miss into (key, available,
    report_date, result). Only available results are stored. ``force`` reads nothing from the cache and stores nothing.
    """
    valid = cache.where(P.cache_valid(F.col("saved_at"), F.col("report_date"), as_of, hours))
    hits = asked.select(key).join(valid, key).select(key, F.lit(True).alias("available"), "report_date", "result", F.lit("cache").alias("came_from"))
    misses = asked.select(key) if force else asked.select(key).join(valid, key, "left_anti")
    made = compute(misses).select(key, "available", "report_date", "result", F.lit("report").alias("came_from"))
    store = made.where("available").select(key, as_of.alias("saved_at"), "report_date", "result")
    return (made, store.limit(0)) if force else (hits.unionByName(made), store)


def preview(items: DataFrame, by: list[str], most: int = 12) -> DataFrame:
    """(by, lines, more): the first products as lines, and how many more there are."""
    line = F.concat("product", F.lit(": "), "price_range", F.lit(" ("), "unit", F.lit(")"))
    rows = items.select(*by, "place", line.alias("line")).groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.struct("place", "line")))).alias("x"), F.count("*").alias("n"))
    return rows.select(*by, F.array_join(F.col("x.line"), "\n").alias("lines"), F.greatest(F.col("n") - most, F.lit(0)).alias("more"))
