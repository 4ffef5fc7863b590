"""Tables of HTML with all that pages get wrong; many words in one pass."""

import random

import pytest
from pyspark.sql import functions as F

from tarn.operators import many_words as W
from tarn.operators import reports, routing
from tarn.sources import html_tables as H

NESTED = """<script>var x = "<table>";</script><table><tr><th>a<th colspan=2>b &amp; c
<tr><td rowspan="2">1<td>2 <table><tr><td>inner</td></tr></table> more<td>3<tr><td>4<td><a href=" x.pdf ">5</a><a href="JavaScript:no">n</a><a href=x.pdf>again</a><a href=#k>k</a></table><p>out"""


def cells(spark, html, base="http://h/d/"):
    df = spark.createDataFrame([(1, html)], "id int, html string")
    rows = H.tables(df, "html", F.lit(base)).orderBy("table_no", "row_no").collect()
    return [(r["table_no"], [c["text"] for c in r["cells"]]) for r in rows], [c["urls"] for r in rows for c in r["cells"] if c["urls"]]


def test_nested_tables_spans_and_missing_ends(spark):
    rows, urls = cells(spark, NESTED)
    assert rows == [(0, ["a", "b & c", "b & c"]), (0, ["1", "2 more", "3"]), (0, ["1", "4", "5nagaink"]), (1, ["inner"])]
    assert urls == [["http://h/d/x.pdf"]]


@pytest.mark.parametrize("html", [None, "", "<td>no table</td>", "<table></table>", "plain <", "</table></td>"])
def test_no_tables(spark, html):
    assert cells(spark, html) == ([], [])


def test_spans_reach_no_further_than_allowed():
    cell = lambda t, c=1, r=1: ([t], [], c, r)
    text = lambda rows: [[c[0][0] for c in row] for row in H.grid(rows)]
    assert text([[cell("a", 1, 3), cell("b")], [], [cell("c"), cell("d")], [cell("e")]]) == [["a", "b"], ["a"], ["a", "c", "d"], ["e"]]
    assert H._span("9999999", 1000) == 1000 and H._span("x", 9) == 1 and H._span("0", 9) == 1 and H._span(None, 9) == 1


DIVISIONS = {"North": "north", "Uttor": "north", "South": "south"}
PAGE = """<table><tr><td>Home<td>Date</table><table><tr><th>Date<th>uttor<th>SOUTH</tr>
<tr><td>১৯-০৮-২০২৬<td><a href="a.pdf">x</a><a href="/b.pdf">y</a><td></tr><tr><td>none<td><a href="c.pdf">c</a><tr><td>20/08/2026<td><a href=d.pdf>d</a><td><a href=e.pdf>e</a>
<tr><td>21/08/2026<td><td><a href=f.pdf>later</a><tr><td>01/01/2020<td><td><a href=g.pdf>old</a></table>"""


def indexed(spark, pages, **options):
    df = spark.createDataFrame(pages, "id int, html string")
    got = H.report_index(df, "html", DIVISIONS, F.lit("2026-08-20").cast("date"), "date", F.lit("http://h/d/"), **options)
    return sorted([(r["id"], r["report_date"] and r["report_date"].isoformat(), r["division"], r["urls"], r["error"]) for r in got.collect()], key=str)


def test_report_index(spark):
    want = [
        (1, "2020-01-01", "south", ["http://h/d/g.pdf"], None),
        (1, "2026-08-19", "north", ["http://h/d/a.pdf", "http://h/b.pdf"], None),
        (1, "2026-08-20", "north", ["http://h/d/d.pdf"], None),
        (1, "2026-08-20", "south", ["http://h/d/e.pdf"], None),
    ]
    assert indexed(spark, [(1, PAGE)]) == want
    assert indexed(spark, [(1, PAGE)], max_age_days=30) == want[1:]


def test_report_index_says_what_is_missing(spark):
    pages = [(1, PAGE.replace("SOUTH", "east")), (2, "<p>nothing"), (3, None), (4, "<table><tr><td>Date<td>other</table>")]
    assert [(r[0], r[2], r[4]) for r in indexed(spark, pages)] == [
        (1, "south", "no column of this division"), (2, None, "no table of reports"), (3, None, "no table of reports"), (4, None, "no table of reports"),
    ]


def test_thousands_of_words_equal_the_chain(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 5)))
    aliases = {}
    for i in range(3000):
        aliases.setdefault(word().strip().lower() or "x", f"n{i}")
    texts = ["".join(rng.choice("abcdéABCD ") for _ in range(rng.randint(0, 30))) for _ in range(200)] + [None, "", "zzz"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    table = spark.createDataFrame(list(aliases.items()) + [(None, "none"), ("", "empty")], "alias string, canonical string")
    got = {r["id"]: r["canonical"] for r in W.longest(rows, F.col("body"), table).collect()}
    order = sorted(aliases, key=lambda a: (-len(a), a))
    assert got == {i: next((aliases[a] for a in order if a in (t or "").lower()), None) for i, t in enumerate(texts)}
    few = dict(list(aliases.items())[:40])
    chain = {r["id"]: r["c"] for r in rows.select("id", routing.longest_alias(F.col("body"), few).alias("c")).collect()}
    assert chain == {r["id"]: r["canonical"] for r in W.longest(rows, F.col("body"), table.where(F.col("alias").isin(*few))).collect()}


def test_occurring_gives_each_word_once_with_its_place(spark):
    rows = spark.createDataFrame([(1, "Red red rose"), (2, "hatred"), (3, None)], "id int, body string")
    words = spark.createDataFrame([("RED", "c"), ("red", "d"), ("rose", "e"), ("none", "f"), (None, "g")], "word string, tag string")
    got = sorted((r["id"], r["tag"], r["at"]) for r in W.occurring(rows, F.col("body"), words, "word").collect())
    assert got == [(1, "c", 0), (1, "d", 0), (1, "e", 8), (2, "c", 3), (2, "d", 3)]
    assert W.occurring(rows, F.col("body"), words.where("false"), "word").count() == 0


def test_a_batch_of_many_hits_stays_small_in_python():
    import tracemalloc

    import ahocorasick
    import pyarrow as pa

    words = [f"word{i:03d}" for i in range(300)]
    automaton = ahocorasick.Automaton()
    for i, w in enumerate(words):
        automaton.add_word(w, (i, len(w)))
    automaton.make_automaton()
    texts = pa.array([" ".join(words), None] * 1000)
    tracemalloc.start()
    found = W._found(texts, words, automaton)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 2000 and len(found[1]) == 0 and found[1998].as_py() == [{"word": w, "at": 8 * i} for i, w in enumerate(words)]
    assert peak < 20_000_000  # 300,000 hits


def test_too_many_words_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(W, "MOST_WORDS", 2)
    words = spark.createDataFrame([("a",), ("b",), ("c",)], "word string")
    with pytest.raises(ValueError, match="too many"):
        W.occurring(words, F.col("word"), words, "word")


def test_ticker_takes_the_first_variant_with_a_price(spark):
    pages = spark.createDataFrame([(1, "Onion: none. Potato 20 - 30, aloo 15 - 18")], "id int, body string")
    variants = spark.createDataFrame([("potato", "aloo", 2), ("potato", "potato", 1), ("onion", "onion", 1)], "crop string, variant string, place int")
    got = {r["crop"]: (r["lo"], r["hi"]) for r in reports.ticker(pages, "body", variants, span=14).collect()}
    assert got["potato"] == (20, 30)
