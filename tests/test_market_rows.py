"""Rows of market tables with the words that ship as defaults."""

import datetime

import pytest
from pyspark.sql import functions as F

from tarn.functions import market as M
from tarn.operators import market_rows as R

DAY = datetime.date(2026, 8, 19)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("product,unit,want", [
    ("লাউ", "", "প্রতিটি"), ("ডিম (ফার্ম)", "প্রতি হালি", "প্রতিটি"), ("রুই মাছ", "প্রতি লিটার", "প্রতি কেজি"), ("সয়াবিন তেল (খোলা)", "", "প্রতি লিটার"), ("কলা", "", "প্রতিটি"),
    ("আলু", "প্রতি লিটার", "প্রতি কেজি"), ("আলু", "প্রতি গ্রাম", "প্রতি গ্রাম"), ("আলু", "", "প্রতি কেজি"), ("", "x", "x"), ("লাউশাক", "প্রতি হালি", "প্রতিটি"),
])
def test_unit_of(spark, product, unit, want):
    df = spark.createDataFrame([(product, unit)], "p string, u string")
    assert df.select(R.unit_of(F.col("p"), F.col("u"))).first()[0] == want


@pytest.mark.parametrize("cell,unit,like", [("১টি", "প্রতিটি", True), ("প্রতি টি", "প্রতিটি", True), ("১ কেজি", "প্রতি কেজি", True), ("আলু", "আলু", False), ("", "", False), ("নিটার", "প্রতি লিটার", True)])
def test_units(spark, cell, unit, like):
    assert one(spark, M.normalize_unit, cell) == unit and one(spark, R.is_unit, cell) is like


@pytest.mark.parametrize("row,want", [
    (["1", "ডাল", "মসুর (মোটা)", "কেজি", "120 - 130"], ("মসুর ডাল (মোটা)", "")), (["1", "আটা", "প্যাকেট", "কেজি", "50 - 55"], ("আটা (প্যাকেট)", "")),
    (["1", "পেঁয়াজ", ",,", "কেজি", "50 - 55"], ("পেঁয়াজ", "")), (["1", "আলু", "কেজি", "", "50 - 55"], ("আলু", "")), (["1", "সবজি", "বেগুন", "কেজি", "50 - 55"], ("বেগুন", "সবজি")),
    (["1", "পণ্যের নাম", "পণ্যের নাম", "", "1 - 2"], ("", "")), (["1", "12", "34", "", "1 - 2"], ("", "")), (["x"], ("", "")),
])
def test_products(spark, row, want):
    got = R.with_product(spark.createDataFrame([(row, 4)], "cells array<string>, at int"), "cells", "at").first()
    assert (got["product"], got["category"]) == want


@pytest.mark.parametrize("name,bad", [
    ("আলু", False), ("", True), ("রসুন (চায়না)", True), ("রসুন (দেশী)", False), ("িআলু", True), ("1আলু", True), ("abc", True), ("রুই মাছ (চাষের) 1 1 - 4 2", True), ("কিল (সয়াবিন)", True),
    ("আটা (খোলা)", False), ("আটা (লাল)", True), ("আলু (িোয়)", True), (None, True),
])
def test_ambiguous(spark, name, bad):
    assert one(spark, R.is_ambiguous, name) is bad


def test_date_in_text(spark):
    for text, want in (("১৯-৮-২০২৬", True), ("19/08/2026 x", True), ("119/08/2026", False), ("19.09.2026", False)):
        assert spark.createDataFrame([(text, DAY)], "t string, d date").select(M.date_in(F.col("t"), F.col("d"))).first()[0] is want


def table(n, rows, head=None):
    return [("d", DAY, n, i, r) for i, r in enumerate(([head] if head else []) + rows)]


def test_price_columns_pass_on(spark):
    """By header; passed on while it holds prices; inferred anew where it doesn't; none where nothing looks like a price."""
    a = table(0, [["আলু", "কেজি", "20 - 25", "5%"]] * 4, ["নাম", "একক", "আজকের বাজার 19/08/2026", "19/08/2026 সাথে %"])
    b = table(1, [["আদা", "কেজি", "90 - 95", "5%"]] * 4)
    c = table(2, [["চাল", "40 - 45", "x", "5%"]] * 6)
    e = table(3, [["x", "y", "z", "5%"]] * 6)
    rows = spark.createDataFrame(a + b + c + e, "division string, report_date date, table_no int, row_no int, cells array<string>")
    got = {r["table_no"]: r["price_at"] for r in R.price_columns(rows, ["division", "report_date"]).collect()}
    assert got == {0: 2, 1: 2, 2: 1}


def test_market_of_a_day(spark):
    head = ["ক্রম", "ধরন", "নাম", "একক", "আজকের বাজার দর 19/08/2026", "বৃদ্ধি %"]
    rows = table(0, [["1", "সবজি", "আলু", "১ কেজি", "২০ - ২৫", "1%"], ["2", "সবজি", "বেগুন", "", "30 - 30", ""], ["3", "সবজি", "েোেররোি", "", "1 - 2", ""], ["4", "সবজি", "আলু", "", "7 - 9", ""], [None, None, None, None, None, None]], head)
    df = spark.createDataFrame(rows + [("d", datetime.date(2026, 8, 25), 0, 0, head)], "division string, report_date date, table_no int, row_no int, cells array<string>")
    got = R.market_prices(df, "division", F.lit("2026-08-20").cast("date")).orderBy("place").collect()
    assert [(r["product"], r["category"], r["price_range"], r["unit"]) for r in got] == [("আলু", "সবজি", "৳20 - ৳25", "প্রতি কেজি"), ("বেগুন", "সবজি", "৳30", "প্রতি কেজি")]
    crops = spark.createDataFrame([("potato", ["আলু", "potato"]), ("rice", ["চাল"])], "crop string, variants array<string>")
    price = R.crop_prices(df, "division", crops, F.lit("2026-08-20").cast("date")).collect()
    assert [(r["crop"], r["price_range"], r["middle"], r["unit"]) for r in price] == [("potato", "৳20 - ৳25", 22.5, "প্রতি কেজি")]


def test_cache(spark):
    now = F.lit("2026-08-19 12:00:00").cast("timestamp")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    cache = spark.createDataFrame([("a", datetime.datetime(2026, 8, 19, 11), DAY, "old"), ("b", datetime.datetime(2026, 8, 1), DAY, "stale")], "k string, saved_at timestamp, report_date date, result string")
    compute = lambda m: m.select("k", (F.col("k") != "c").alias("available"), F.lit(DAY).alias("report_date"), F.lit("new").alias("result"))
    answers, store = R.through_cache(asked, cache, "k", compute, now, 48)
    assert {(r["k"], r["result"], r["came_from"]) for r in answers.collect()} == {("a", "old", "cache"), ("b", "new", "report"), ("c", "new", "report")}
    assert [r["k"] for r in store.collect()] == ["b"], "only available results are stored"
    answers, store = R.through_cache(asked, cache, "k", compute, now, 48, force=True)
    assert {r["came_from"] for r in answers.collect()} == {"report"} and store.count() == 0


def test_whole_cells_that_are_units(spark):
    cells = ["১ লি", "লি.", "2 লিটার", "রিটারি", "৫ টি", "টি", "প্রতি টি", "প্রতিটি টি", "লিচু", "টিন", "12", ""]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = [r["u"] for r in df.select("i", R.is_unit(F.col("c")).alias("u")).orderBy("i").collect()]
    assert got == [True] * 8 + [False] * 4


def test_second_choice_of_price_columns_counts_fewer_words(spark):
    """A dated header with one of the doubtful words is no current price, but is taken where no header is."""
    from datetime import date

    rows = [("d", 0, 0, date(2026, 8, 19), ["পণ্য", "19/08/2026 গি ম", "19/08/2026 %"]), ("d", 0, 1, date(2026, 8, 19), ["x", "10 - 20", "5"]), ("d", 0, 2, date(2026, 8, 19), ["y", "30 - 40", "5"])]
    rows += [("e", 0, 0, date(2026, 8, 19), ["পণ্য", "19/08/2026 গি ম", "19/08/2026 বাজার"]), ("e", 0, 1, date(2026, 8, 19), ["x", "10 - 20", "1 - 2"]), ("e", 0, 2, date(2026, 8, 19), ["y", "30 - 40", "3 - 4"])]
    df = spark.createDataFrame(rows, "division string, table_no int, row_no int, report_date date, cells array<string>")
    got = {(r["division"], r["row_no"]): r["lo"] for r in R.priced_rows(df, ["division", "report_date"]).collect() if r["lo"] is not None}
    assert got["d", 1] == 10 and got["e", 1] == 1


def test_names_without_a_division_take_the_default(spark):
    from tarn.operators import routing

    aliases = spark.createDataFrame([("dhaka", "ঢাকা"), ("ঢাকা", "ঢাকা")], "alias string, canonical string")
    df = spark.createDataFrame([(1, "Dhaka"), (2, None), (3, " "), (4, "Khulna")], "i int, d string")
    named = lambda **o: {r["i"]: r["canonical"] for r in routing.canonical(df, "d", aliases, **o).collect()}
    assert named(default="ঢাকা") == {1: "ঢাকা", 2: "ঢাকা", 3: "ঢাকা", 4: "Khulna"} and named()[2] is None


def test_priced_rows_of_one_table_are_dealt_to_all_tasks(spark):
    from datetime import date

    from tarn.operators.market_rows import priced_rows

    cells = [["no", "kind", "name", "kg", "2/1/2024", "change %"], *[[str(i), "kind", f"name {i}", "kg", f"{i} - {i + 1}", "5 %"] for i in range(1, 60)]]
    rows = spark.createDataFrame([("a", date(2024, 1, 2), 0, i, c) for i, c in enumerate(cells)], "division string, report_date date, table_no int, row_no long, cells array<string>")
    got = priced_rows(rows, ["division", "report_date"])
    per_task = [n for n in got.rdd.glom().map(len).collect() if n]
    assert sum(per_task) == got.count() >= 59 and len(per_task) == 4
