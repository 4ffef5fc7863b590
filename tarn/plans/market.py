"""Queries of market rows: reports are laid out from parts (division: brand, day: size), with a header in the first table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import market_rows as R
from tarn.sources import html_tables

from .common import t
from .registry import query

WORDS = R.Words(
    unit_marks=("kg", "dozen"), units=(("per dozen", ("dozen",)), ("per kg", ("kg",))), noise=("name",), qualifiers=("small", "large"), pulses=(), pulse_names=(),
    own_units={"red": "per piece"}, oils=("rod",), eggs=(), flesh=("gizmo",), by_piece=("ring",), confident=("ring", "bolt", "gear", "gizmo", "widget", "rod", "economy"),
    roots=("ECONOMY", "SMALL", "hot", "cold"), allowed={}, only_with={}, current=("today",), compared=("change", "%"), compared_surely=("change", "%"), unit_cells=(), repairs=(("[ \\t]+", " "),), letters="A-Za-z",
    marks="\\u0300-\\u036F", litre="per litre", kilogram="per kg", piece="per piece", known_units=("per dozen", "per kg", "per piece"),
)
DAY = "2024-01-02"


def reports(spark, d):
    p = t(spark, d, "part").withColumn("k", F.col("p_partkey") % 6).withColumn("report_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size") % 3))
    name = F.when(F.col("k") == 1, F.lit(",,")).when(F.col("k") == 2, F.lit("")).when(F.col("k") == 4, F.concat("p_name", F.lit(" (new)"))).when(F.col("k") == 5, F.lit("12345")).otherwise(F.col("p_name"))
    unit = F.when(F.col("k") % 2 == 0, F.lit("1 kg")).otherwise(F.lit(""))
    cells = F.array(F.col("p_partkey").cast("string"), F.col("p_type"), name, unit, F.concat_ws(" - ", F.col("p_size"), F.col("p_size") + 10), F.lit("5 %"))
    key = [F.col("p_brand").alias("brand"), "report_date"]
    rows = p.select(*key, (F.col("p_partkey") % 2).cast("int").alias("table_no"), F.col("p_partkey").alias("row_no"), cells.alias("cells"))
    head = F.array(*[F.lit(x) for x in ("no", "kind", "name", "unit")], F.date_format("report_date", "'today' d/M/yyyy"), F.lit("change %"))
    return rows.unionByName(p.select(*key).distinct().select("brand", "report_date", F.lit(0).alias("table_no"), F.lit(-1).cast("long").alias("row_no"), head.alias("cells")))


UNIT = """CASE WHEN starts_with({p} || ' ', 'red ') THEN 'per piece' WHEN contains(lower({p}), 'gizmo') THEN 'per kg' WHEN contains(lower({p}), 'rod') THEN 'per litre'
 WHEN contains(lower({p}), 'ring') THEN 'per piece' WHEN {u} <> '' THEN {u} WHEN {p} <> '' THEN 'per kg' ELSE '' END"""
ROWS = f"""r AS (SELECT p_brand AS brand, DATE '2024-01-01' + (p_size % 3) AS report_date, p_partkey % 2 AS tab, p_partkey AS pos, p_type AS kind, p_partkey % 6 AS k, p_size::DOUBLE AS lo, p_size + 10.0::DOUBLE AS hi,
 CASE p_partkey % 6 WHEN 4 THEN p_name || ' (new)' ELSE p_name END AS name, CASE WHEN p_partkey % 2 = 0 THEN 'per kg' ELSE '' END AS cell FROM part),
p AS (SELECT *, CASE WHEN k IN (1, 2) THEN kind WHEN k = 5 THEN '' WHEN regexp_matches(name, 'small|large') THEN kind || ' (' || name || ')' ELSE name END AS product,
 CASE WHEN k IN (1, 2, 5) OR regexp_matches(name, 'small|large') THEN '' ELSE kind END AS category FROM r),
a AS (SELECT *, product = '' OR NOT regexp_matches(lower(product), 'ring|bolt|gear|gizmo|widget|rod|economy')
 OR (contains(product, '(') AND NOT regexp_matches(product, '^(?:ECONOMY|SMALL|hot|cold)(?: |$)')) AS unclear FROM p),
l AS (SELECT brand, max(report_date) AS report_date FROM r WHERE report_date <= DATE '{DAY}' GROUP BY brand)"""
ITEMS = f"""WITH {ROWS}, s AS (SELECT *, coalesce(last_value(nullif(cell, '') IGNORE NULLS) OVER (PARTITION BY brand, report_date, tab ORDER BY pos ROWS UNBOUNDED PRECEDING), '') AS u FROM a JOIN l USING (brand, report_date) WHERE NOT unclear),
f AS (SELECT *, {UNIT.format(p='product', u='u')} AS unit, row_number() OVER (PARTITION BY brand, lower(product) ORDER BY tab, pos) AS n FROM s),
i AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY tab, pos)::INTEGER AS place, '৳' || lo::BIGINT || ' - ৳' || hi::BIGINT AS price_range FROM f WHERE n = 1),
o AS (SELECT brand, report_date, 1 + count_if(unclear) AS omitted FROM a JOIN l USING (brand, report_date) GROUP BY ALL)"""


def _prices(spark, d):
    return R.market_prices(reports(spark, d), "brand", F.lit(DAY).cast("date"), WORDS)


@query("market_prices", ITEMS + " SELECT brand, report_date, place, product, category, lo, hi, price_range, unit, omitted FROM i JOIN o USING (brand, report_date)")
def market_prices(spark, d):
    """Every product of each division's last report, and how many rows it leaves out."""
    return _prices(spark, d)


@query("market_preview", ITEMS + """ SELECT brand, string_agg(CASE WHEN place <= 12 THEN product || ': ' || price_range || ' (' || unit || ')' END, '\n' ORDER BY place) AS lines, greatest(count(*) - 12, 0)::BIGINT AS more FROM i GROUP BY brand""")
def market_preview(spark, d):
    return R.preview(_prices(spark, d), ["brand"])


CROPS = [("round", ["ring", "gear"]), ("odd", ["gizmo", "widget"]), ("none", ["absent"])]
FIRST = f"""WITH {ROWS}, c AS (SELECT *, lower(pos || ' ' || kind || ' ' || CASE k WHEN 1 THEN ',,' WHEN 2 THEN '' WHEN 5 THEN '12345' ELSE name END) AS words FROM a JOIN l USING (brand, report_date)),
h AS (SELECT *, 'round' AS crop FROM c WHERE regexp_matches(words, 'ring|gear') UNION ALL SELECT *, 'odd' FROM c WHERE regexp_matches(words, 'gizmo|widget')),
x AS (SELECT *, row_number() OVER (PARTITION BY brand, crop ORDER BY tab, pos) AS n FROM h)"""


@query("crop_prices", FIRST + f" SELECT brand, crop, lo, hi, '৳' || lo::BIGINT || ' - ৳' || hi::BIGINT AS price_range, round_even((lo + hi) / 2, 2) AS middle, {UNIT.format(p='product', u='cell')} AS unit, report_date FROM x WHERE n = 1")
def crop_prices(spark, d):
    """The first row of each division's last report that names a crop."""
    crops = spark.createDataFrame(CROPS, "crop string, variants array<string>")
    return R.crop_prices(reports(spark, d), "brand", crops, F.lit(DAY).cast("date"), WORDS)


@query("price_cache", FIRST + """, g AS (SELECT brand, '৳' || lo::BIGINT || ' - ৳' || hi::BIGINT AS price_range FROM x WHERE n = 1 AND crop = 'round'), k AS (SELECT DISTINCT p_brand AS brand FROM part)
SELECT 'v2__round__' || brand AS cache_key, substr(brand, 7)::INT % 3 = 0 OR price_range IS NOT NULL AS available, CASE WHEN substr(brand, 7)::INT % 3 = 0 THEN 'cached' ELSE price_range END AS result,
 CASE WHEN substr(brand, 7)::INT % 3 = 0 THEN 'cache' ELSE 'report' END AS came_from FROM k LEFT JOIN g USING (brand)""")
def price_cache(spark, d):
    """Prices through a cache: valid entries answer (of every third division), stale and missing ones are computed."""
    brands = t(spark, d, "part").select(F.col("p_brand").alias("brand")).distinct()
    key = F.concat(F.lit("v2__round__"), "brand").alias("cache_key")
    number = F.substring("brand", 7, 9).cast("int")
    now = F.lit(f"{DAY} 12:00:00").cast("timestamp")
    saved = F.when(number % 3 == 0, now - F.expr("INTERVAL 1 HOUR")).otherwise(now - F.expr("INTERVAL 9 DAY"))
    cache = brands.where(number % 3 < 2).select(key, saved.alias("saved_at"), F.lit(DAY).cast("date").alias("report_date"), F.lit("cached").alias("result"))
    crops = spark.createDataFrame(CROPS[:1], "crop string, variants array<string>")

    def compute(misses):
        found = R.crop_prices(reports(spark, d), "brand", crops, F.lit(DAY).cast("date"), WORDS).select(key, "report_date", F.col("price_range").alias("result"))
        return misses.join(found, "cache_key", "left").withColumn("available", F.col("result").isNotNull())

    answers, _ = R.through_cache(brands.select(key), cache, "cache_key", compute, now, 48)
    return answers.select("cache_key", "available", "result", "came_from")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def index_pages(spark, d):
    """(region, html): a page for each region with a table of months and priorities: links where an order is. One page lacks a
    column. There is a table before it and one within a cell, and cells and rows that are never closed."""
    o, c, n, r = (t(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    month = F.add_months(F.date_trunc("month", "o_orderdate"), 144)  # dates of reports are of this century
    got = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    got = got.select(F.col("r_name").alias("region"), month.alias("month"), F.col("o_orderpriority").alias("p")).groupBy("region", "month").agg(F.collect_set("p").alias("has"))
    link = lambda p: F.when(F.array_contains("has", p), F.concat(F.lit(f'<a href="{p[0]}/'), F.date_format("month", "yyyy-MM"), F.lit('.pdf">pdf</a><a href="#top">up</a>'))).otherwise(F.lit("-"))
    row = F.concat(F.lit("<tr><td>"), F.date_format("month", "dd/MM/yyyy"), F.lit("<table><tr><td>inner</table>"), *[x for p in PRIORITIES for x in (F.lit("<td>"), link(p))])
    body = got.groupBy("region").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"))
    head = F.concat(F.lit("<table><tr><td>menu</td></tr></table><table><thead><tr><th>Date"), *[F.when((F.col("region") == "AFRICA") & F.lit(p == "5-LOW"), F.lit("<th>other")).otherwise(F.lit(f"<th>{p}")) for p in PRIORITIES], F.lit("</thead>"))
    return body.select("region", F.concat(head, "rows", F.lit("</table>")).alias("html"))


@query("report_index", """WITH o AS (SELECT DISTINCT r_name AS region, (date_trunc('month', o_orderdate) + INTERVAL 144 MONTH)::DATE AS m, o_orderpriority AS p
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT region, m AS report_date, p AS division, 'https://reports.example/' || region || '/' || p[1] || '/' || strftime(m, '%Y-%m') || '.pdf' AS url, NULL AS error FROM o WHERE region <> 'AFRICA' AND m <= DATE '2009-06-15'
UNION ALL SELECT DISTINCT region, NULL, '5-LOW', NULL, 'no column of this division' FROM o WHERE region = 'AFRICA'""")
def report_index(spark, d):
    """The reports that a page's table links to by date and division; an error where a division has no column."""
    base = F.concat(F.lit("https://reports.example/"), "region", F.lit("/"))
    found = html_tables.report_index(index_pages(spark, d), "html", {p: p for p in PRIORITIES}, F.lit("2009-06-15").cast("date"), "date", base)
    return found.select("region", "report_date", "division", F.get("urls", F.lit(0)).alias("url"), "error")
