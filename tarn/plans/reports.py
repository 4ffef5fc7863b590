"""Queries of market reports and detections, over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn import dictionaries as D
from tarn.functions import market as M
from tarn.operators import detection as V
from tarn.operators import reports as P
from tarn.operators import routing
from tarn.operators.many_words import occurring

from .common import q, t
from .registry import query

AS_OF = "1998-06-30"


@query("latest_asof", f"SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderdate <= TIMESTAMP '{AS_OF}') WHERE n = 1")
def latest_asof(spark, d):
    """The last order of each customer by a date; nothing later counts."""
    return P.latest(t(spark, d, "orders"), "o_custkey", "o_orderdate", F.lit(AS_OF).cast("timestamp"), "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("forward_fill_unit", "SELECT event_id, user_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS unit FROM events")
def forward_fill_unit(spark, d):
    """Gaps filled from above: two of three cells are emptied first."""
    rows = t(spark, d, "events").withColumn("cell", F.when(F.col("event_id") % 3 == 0, F.col("event_type")))
    return P.inherited(rows, "cell", ["user_id"], ["ts", "event_id"], "unit").select("event_id", "user_id", "unit")


NAMES = {"ring": ["ring"], "bolt": ["bolt", "screw"], "small": ["small", "mini"], "gear": ["gear", "cog"]}
HIT = " OR ".join(f"(name = {q(k)} AND ({' OR '.join(f'contains(lower(p_name || chr(32) || p_type), {q(v)})' for v in vs)}))" for k, vs in NAMES.items())


@query("first_match_price", f"WITH w AS (SELECT unnest([{', '.join(q(k) for k in NAMES)}]) AS name) SELECT name, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) AS n FROM part JOIN w ON {HIT}) WHERE n = 1")
def first_match_price(spark, d):
    """The first part whose text holds a variant of each wanted name."""
    wanted = spark.createDataFrame(list(NAMES.items()), "name string, variants array<string>")
    rows = t(spark, d, "part").withColumn("body", F.concat("p_name", F.lit(" "), "p_type"))
    return P.first_match(wanted, rows, "variants", "body", ["p_partkey"]).select("name", "p_partkey", "p_retailprice")


#: Prices as reports write them: Bangla digits, thousands, ranges, two numbers, none.
CELL = """CASE p_partkey % 5 WHEN 0 THEN translate(printf('%.2f - %.2f', p_retailprice, p_retailprice + p_size), '0123456789', '০১২৩৪৫৬৭৮৯') WHEN 1 THEN printf('%.2f', p_retailprice)
 WHEN 2 THEN (p_size + 10) || ' ' || p_size WHEN 3 THEN '1,' || (100 + p_size) || ' - 1,' || (300 + p_size) ELSE 'n/a' END"""


def _cells(spark, d):
    p, s = F.col("p_retailprice"), F.col("p_size")
    both = F.translate(F.format_string("%.2f - %.2f", p, p + s), "0123456789", M.DIGITS)
    k = F.col("p_partkey") % 5
    cell = (
        F.when(k == 0, both).when(k == 1, F.format_string("%.2f", p)).when(k == 2, F.concat_ws(" ", s + 10, s))
        .when(k == 3, F.concat(F.lit("1,"), 100 + s, F.lit(" - 1,"), 300 + s)).otherwise(F.lit("n/a"))
    )
    return t(spark, d, "part").withColumn("cell", cell)


LOHI = """x AS (SELECT p_partkey, p_size, CASE p_partkey % 5 WHEN 0 THEN round(p_retailprice, 2) WHEN 1 THEN round(p_retailprice, 2) WHEN 2 THEN p_size::DOUBLE WHEN 3 THEN 1100.0::DOUBLE + p_size END AS lo,
 CASE p_partkey % 5 WHEN 0 THEN round(p_retailprice + p_size, 2) WHEN 1 THEN round(p_retailprice, 2) WHEN 2 THEN p_size + 10.0::DOUBLE WHEN 3 THEN 1300.0::DOUBLE + p_size END AS hi FROM part)"""


@query("price_parse", f"WITH {LOHI} SELECT p_partkey, round(lo, 2) AS lo, round(hi, 2) AS hi, round_even((lo + hi) / 2, 2) AS middle FROM x")
def price_parse(spark, d):
    """Prices read back from cells; the SQL has the numbers that the cells were written from."""
    r = _cells(spark, d).select("p_partkey", M.parse_price(F.col("cell")).alias("r"))
    return r.select("p_partkey", F.round("r.lo", 2).alias("lo"), F.round("r.hi", 2).alias("hi"), F.bround((F.col("r.lo") + F.col("r.hi")) / 2, 2).alias("middle"))


FMT = "CASE WHEN {0} = floor({0}) THEN ({0}::BIGINT)::VARCHAR ELSE printf('%.2f', {0}) END"


@query("format_range", f"WITH {LOHI} SELECT p_partkey, '৳' || {FMT.format('lo')} || ' - ৳' || {FMT.format('hi')} AS range, CASE WHEN lo = hi THEN '৳' || {FMT.format('lo')} ELSE '৳' || {FMT.format('lo')} || ' - ৳' || {FMT.format('hi')} END AS market FROM x WHERE lo IS NOT NULL")
def format_range(spark, d):
    r = _cells(spark, d).select("p_partkey", M.parse_price(F.col("cell")).alias("r")).where("r is not null")
    return r.select("p_partkey", M.format_range(F.col("r.lo"), F.col("r.hi")).alias("range"), M.format_range(F.col("r.lo"), F.col("r.hi"), True).alias("market"))


@query("date_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 OR year(o_orderdate) < 2000 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders")
def date_parse(spark, d):
    """Dates read from headers with Bangla digits and other marks; a wrong date before the right one, none, or one before 2000."""
    o = t(spark, d, "orders")
    k = F.col("o_orderkey") % 4
    one = F.translate(F.date_format("o_orderdate", "dd-MM-yyyy"), "0123456789", M.DIGITS)
    text = F.when(k == 0, one).when(k == 1, F.concat(F.lit("31/02/2026 "), F.date_format("o_orderdate", "d / M / yyyy"))).when(k == 2, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.lit("19-08-1999"))
    return o.select("o_orderkey", M.parse_date(text).alias("day"))


UNIT_WORDS = ["১ কেজি", "লিটার", "হালি", "গ্রাম", "box"]


@query("unit_normalize", "SELECT p_partkey, (['প্রতি কেজি', 'প্রতি লিটার', 'প্রতি হালি', 'প্রতি গ্রাম', 'box'])[p_partkey % 5 + 1] AS unit FROM part")
def unit_normalize(spark, d):
    words = F.array(*[F.lit(w) for w in UNIT_WORDS])
    return t(spark, d, "part").select("p_partkey", M.normalize_unit(F.get(words, (F.col("p_partkey") % 5).cast("int"))).alias("unit"))


@query("argmax_column", """WITH c AS (SELECT l_orderkey, 0 AS col, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS p FROM lineitem UNION ALL SELECT l_orderkey, 1, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END FROM lineitem UNION ALL SELECT l_orderkey, 2, CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END FROM lineitem),
n AS (SELECT l_orderkey, col, sum(p) AS prices FROM c GROUP BY ALL) SELECT l_orderkey, col::INTEGER AS col, prices::BIGINT AS prices FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY prices DESC, col) AS r FROM n) WHERE r = 1 AND prices >= 2""")
def argmax_column(spark, d):
    """The column with the most price-like cells of each order's table (three columns of text)."""
    cell = lambda c: F.when(c, F.lit("10 - 20")).otherwise(F.lit("12 %"))
    cells = F.array(cell(F.col("l_quantity") > 25), cell(F.col("l_discount") > 0.05), cell(F.col("l_tax") > 0.04))
    rows = t(spark, d, "lineitem").select("l_orderkey", F.posexplode(cells).alias("col", "cell"))
    return P.price_column(rows, ["l_orderkey"], "col", "cell")


@query("unpivot_reports", "SELECT o_custkey, status, n FROM (SELECT o_custkey, o_orderstatus AS status, count(*)::BIGINT AS n FROM orders GROUP BY ALL)")
def unpivot_reports(spark, d):
    """A crosstab of customers and statuses, and back to rows."""
    wide = t(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return P.unpivoted(wide, "o_custkey", ["F", "O", "P"], "status", "n")


NOW = "2024-01-20 12:00:00"


@query("cache_ttl_valid", f"SELECT event_id, ts <= TIMESTAMP '{NOW}' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR AND date_trunc('day', ts) + INTERVAL ((event_id % 3)::INT) DAY <= TIMESTAMP '{NOW}' AS valid FROM events")
def cache_ttl_valid(spark, d):
    """Entries of at most 48 hours whose report isn't from the future."""
    report = F.date_trunc("day", "ts") + F.make_dt_interval((F.col("event_id") % 3).cast("int"))
    return t(spark, d, "events").select("event_id", P.cache_valid(F.col("ts"), report, F.lit(NOW).cast("timestamp"), 48).alias("valid"))


@query("cache_keys", "SELECT c_custkey, 'v2__' || lower(c_mktsegment) || '__' || c_nationkey AS cache_key FROM customer")
def cache_keys(spark, d):
    return t(spark, d, "customer").select("c_custkey", M.cache_key(F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("cache_key"))


CONF = "(event_id * 37 % 101) / 100.0::DOUBLE"
TIER = f"CASE WHEN {CONF} >= 0.85 THEN 'green' WHEN {CONF} >= 0.6 THEN 'amber' ELSE 'red' END"


def _confident(spark, d):
    return t(spark, d, "events").withColumn("confidence", (F.col("event_id") * 37 % 101) / 100.0)


@query("tier_bucket", f"SELECT event_type, {TIER} AS tier, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def tier_bucket(spark, d):
    return _confident(spark, d).groupBy("event_type", V.tier(F.col("confidence")).alias("tier")).agg(F.count("*").alias("n"))


@query("top_detection", f"SELECT user_id, event_id, {CONF} AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {CONF} DESC, event_id) AS r FROM events) WHERE r = 1")
def top_detection(spark, d):
    return V.top_detection(_confident(spark, d), "user_id", "confidence", "event_id").select("user_id", "event_id", "confidence")


@query("review_queue", f"SELECT event_id, {CONF} AS confidence, 'low confidence' AS reason FROM events WHERE {TIER} = 'red'")
def review_queue(spark, d):
    return _confident(spark, d).where(V.tier(F.col("confidence")) == "red").select("event_id", "confidence", F.lit("low confidence").alias("reason"))


CLASS_NAMES = list(D.CLASSES)[:8]


@query("class_map_default", "SELECT vec_id, CASE label " + " ".join(f"WHEN {i} THEN {q(D.CLASSES[c][0])}" for i, c in enumerate(CLASS_NAMES)) + f" ELSE {q(D.NO_CLASS[0])} END AS crop, CASE label " + " ".join(f"WHEN {i} THEN {q(D.CLASSES[c][1])}" for i, c in enumerate(CLASS_NAMES)) + f" ELSE {q(D.NO_CLASS[1])} END AS name FROM embeddings")
def class_map_default(spark, d):
    """Labels as class names with their crop; labels 8 and 9 have none."""
    names = F.array(*[F.lit(c) for c in CLASS_NAMES])
    rows = t(spark, d, "embeddings").select("vec_id", F.get(names, F.col("label")).alias("cls"))
    return V.with_class(rows, "cls").select("vec_id", "crop", F.col("label").alias("name"))


@query("label_validate", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'expected 5 fields, got 4' WHEN 2 THEN 'non-numeric field' WHEN 3 THEN CASE WHEN p_size >= 11 THEN 'class id ' || p_size || ' out of range' ELSE '' END ELSE 'coords out of [0,1]' END AS reason FROM part""")
def label_validate(spark, d):
    """Label lines written from parts, some wrong in each way."""
    s = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 5
    line = F.when(k == 0, F.lit("0 .5 .5 1 1")).when(k == 1, F.lit("0 .5 .5 1")).when(k == 2, F.lit("x .5 .5 1 1")).when(k == 3, F.concat(s, F.lit(" 0.1 0.2 0.3 0.4"))).otherwise(F.lit("3 0.5 1.2 1 1"))
    return t(spark, d, "part").select("p_partkey", V.label_line(line, 11).alias("reason"))


@query("pixel_boxes", "SELECT p_partkey, trunc((0.5 - p_size / 100.0::DOUBLE / 2) * 640)::INTEGER AS x1, trunc((0.5 + p_size / 100.0::DOUBLE / 2) * 640)::INTEGER AS x2 FROM part")
def pixel_boxes(spark, d):
    w = F.col("p_size") / 100.0
    b = V.pixel_box(F.lit(0.5), F.lit(0.5), w, w, 640, 480)
    return t(spark, d, "part").select("p_partkey", b.alias("b")).select("p_partkey", "b.x1", "b.x2")


@query("products_distinct", "SELECT c_mktsegment, c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS n FROM customer) WHERE n = 1")
def products_distinct(spark, d):
    """The first row of each key, in order."""
    return routing.first_of_each(t(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], ["c_custkey"]).select("c_mktsegment", "c_nationkey", "c_custkey")


@query("omitted_rows", "SELECT p_brand, count_if(length(p_name) > 20)::BIGINT AS omitted, count(*)::BIGINT AS seen FROM part GROUP BY p_brand")
def omitted_rows(spark, d):
    return P.omitted(t(spark, d, "part"), ["p_brand"], F.length("p_name") > 20)


@query("ticker_prices", """WITH v AS (SELECT unnest(['ring', 'gizmo', 'widget']) AS variant, unnest(['round', 'odd', 'round']) AS crop, unnest([1, 1, 2]) AS place),
h AS (SELECT p_partkey, crop, min(place) AS place FROM part JOIN v ON contains(lower(p_name || ' ' || p_type), variant) GROUP BY ALL)
SELECT p_partkey, crop, round(p_retailprice, 2) AS lo, round(p_retailprice, 2) AS hi FROM h JOIN part USING (p_partkey)""")
def ticker_prices(spark, d):
    """Prices that follow a wanted word in a text, by the first of its variants."""
    variants = spark.createDataFrame([("round", "ring", 1), ("odd", "gizmo", 1), ("round", "widget", 2)], "crop string, variant string, place int")
    text = F.concat(F.regexp_replace(F.concat("p_name", F.lit(" "), "p_type"), "[0-9]", ""), F.lit(" : "), F.format_string("%.2f", "p_retailprice"))
    got = P.ticker(t(spark, d, "part").select("p_partkey", text.alias("body")), "body", variants)
    return got.select("p_partkey", "crop", F.round("lo", 2).alias("lo"), F.round("hi", 2).alias("hi"))


@query("names_repaired", "SELECT p_partkey, CASE WHEN len(regexp_extract_all(x, '\\(')) - len(regexp_extract_all(x, '\\)')) = 1 THEN x || ')' ELSE x END AS name FROM (SELECT p_partkey, trim(regexp_replace(replace(replace(p_name || ' (' || p_brand, 'Brand#', 'brand '), 'ring', 'loop'), '[ \\t]+', ' ', 'g')) AS x FROM part)")
def names_repaired(spark, d):
    c = P.repaired(F.concat("p_name", F.lit(" ("), "p_brand"), {"ring": "loop", "Brand#": "brand "})
    return t(spark, d, "part").select("p_partkey", c.alias("name"))


@query("full_frame_labels", "SELECT doc_id, CASE lang WHEN 'en' THEN 0 ELSE 1 END || ' 0.5 0.5 1.0 1.0' AS line FROM documents WHERE lang IN ('en', 'de')")
def full_frame_labels(spark, d):
    """Whole-image labels by folder; folders without a class drop out."""
    mapping = spark.createDataFrame([("en", 0), ("de", 1)], "from_label string, class_id int")
    return V.full_frame(t(spark, d, "documents").select("doc_id", "lang"), "lang", mapping).select("doc_id", "line")


DICTIONARY = "SELECT DISTINCT lower(unnest(string_split(text, ' '))) AS word FROM benchmark"


@query("many_words", f"""WITH w AS ({DICTIONARY}), h AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY length(word) DESC, word) AS n, count(*) OVER (PARTITION BY doc_id) AS words, instr(lower(text), word) - 1 AS place_ FROM documents JOIN w ON word <> '' AND contains(lower(text), word))
SELECT doc_id, word AS longest, words::BIGINT AS words, place_::INTEGER AS place FROM h WHERE n = 1""")
def many_words(spark, d):
    """How many of all items' words stand in each text, the longest of them, and where."""
    words = t(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("word")).distinct()
    docs = t(spark, d, "documents").select("doc_id", "text")
    hits = occurring(docs, F.col("text"), words, "word").select("doc_id", "word", "at")
    best = F.min(F.struct((-F.length("word")).alias("n"), "word", "at")).alias("b")
    return hits.groupBy("doc_id").agg(best, F.count("*").alias("words")).select("doc_id", F.col("b.word").alias("longest"), "words", F.col("b.at").alias("place"))
