"""Queries of ingest: lines, chunks, planning, upsert, pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.operators import detection as V
from tarn.operators import ingest as I
from tarn.operators.page_tables import page_tables as page_tables_of
from tarn.sources import capabilities, files, images

from .common import D, WS, class_of, q, strip_sql, t
from .registry import query

LINES = f"list_transform(string_split(text, '\n'), lambda x: {strip_sql('x')})"
MARKS = f"""m AS (SELECT source, line, count(*) AS pages FROM (SELECT source, unnest(list_distinct(list_filter({LINES}, lambda x: x <> ''))) AS line FROM documents) WHERE length(line) < 80 GROUP BY ALL HAVING count(*) >= 3)"""


@query("repeated_lines", f"WITH {MARKS} SELECT source, line, pages::BIGINT AS pages FROM m")
def repeated_lines(spark, d):
    """Lines that stand in three documents of a source at least."""
    return I.repeated_lines(t(spark, d, "documents"), ["source"], "text")


BARE = q(class_of(X.BARE_NUMBER))


@query("bare_number_lines", f"SELECT doc_id, len(list_filter({LINES}, lambda x: regexp_matches(x, {BARE})))::INTEGER AS n FROM documents")
def bare_number_lines(spark, d):
    lines = F.transform(F.split("text", "\n"), X.strip)
    return t(spark, d, "documents").select("doc_id", F.size(F.filter(lines, lambda x: x.rlike(X.BARE_NUMBER))).alias("n"))


OF_LINE = f"coalesce(len(regexp_extract_all(x, '[{D.LATIN}]'))::DOUBLE / nullif(len(regexp_extract_all(x, {q(class_of(X.LINE_CHARS))})), 0), 0)"
STAYS = f"x = '' OR (NOT regexp_matches(x, {BARE}) AND NOT (length(x) >= 15 AND {OF_LINE} < 0.3) AND NOT list_contains(coalesce(marks, []), x))"
SQUEEZED = strip_sql("regexp_replace(regexp_replace(array_to_string(k, '\n'), '[ \\t\u00a0]+', ' ', 'g'), '\\n{3,}', '\n\n', 'g')")


#: Texts without the lines that go: k (doc_id, source, k).
KEPT = f"{MARKS}, a AS (SELECT source, list(line) AS marks FROM m GROUP BY source), k AS (SELECT doc_id, source, list_filter({LINES}, lambda x: {STAYS}) AS k FROM documents LEFT JOIN a USING (source))"


@query("clean_lines", f"WITH {KEPT} SELECT doc_id, sha256({SQUEEZED}) AS sha, length({SQUEEZED})::INTEGER AS chars FROM k")
def clean_lines(spark, d):
    """Texts without boilerplate, bare numbers and lines of another script."""
    pages = I.clean_pages(t(spark, d, "documents"), ["source"], "doc_id", "text", D.LATIN)
    return pages.select("doc_id", F.sha2("clean", 256).alias("sha"), F.length("clean").alias("chars"))


WHITE = class_of(I.WHITE)
STRIP = f"regexp_replace({{}}, '^[{WHITE}]+|[{WHITE}]+$', '', 'g')"
#: Chunks of a table (doc_id, text) step by step: c (doc_id, chunk_no, start, end, chunk).
CHUNKS_OF = f"""f AS (SELECT doc_id, {STRIP.format("coalesce(text, '')")} AS t, 0 AS at_, 0 AS least, NULL::INT AS a, NULL::INT AS e, NULL::VARCHAR AS c, false AS taken, false AS done FROM $table
UNION ALL SELECT doc_id, t, nxt + length(regexp_extract(substr(t, nxt + 1, 60), '(?s)^[^{WHITE}]*[{WHITE}]')), floor_, at_, stop, piece, got, last
FROM (SELECT *, greatest(stop - 150, at_ + 1, floor_) AS nxt FROM (SELECT *, CASE WHEN got THEN at_ + 590 ELSE least END AS floor_
FROM (SELECT *, length(piece) >= 40 AND at_ >= least AS got FROM (SELECT *, {STRIP.format("left(win, cut)")} AS piece, at_ + cut AS stop
FROM (SELECT *, CASE WHEN last THEN length(win) ELSE 680 + coalesce(nullif(length(regexp_extract(right(win, 120), '(?s)^.*[।?!.]')), 0), nullif(length(regexp_extract(right(win, 120), '(?s)^.*[{WHITE}]')), 0), 120) END AS cut
FROM (SELECT * EXCLUDE (a, e, c, taken, done), substr(t, at_ + 1, 800) AS win, at_ + 800 >= length(t) AS last FROM f WHERE NOT done AND t <> ''))))))),
c AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS chunk_no, a::BIGINT AS start, e::BIGINT AS end_, c AS chunk FROM f WHERE taken)"""
CHUNKS = "RECURSIVE " + CHUNKS_OF.replace("$table", "documents")


@query("chunk_spans", f"WITH {CHUNKS} SELECT doc_id, chunk_no, doc_id || '::c' || chunk_no AS chunk_id, start, end_ AS \"end\", chunk FROM c")
def chunk_spans(spark, d):
    """All chunks of all documents with their places."""
    return I.chunks(t(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk_no", "chunk_id", "start", "end", "chunk")


@query("chunk_count", f"WITH {CHUNKS}, n AS (SELECT doc_id, count(*) AS chunks, sum(end_ - start) AS chars FROM c GROUP BY doc_id) SELECT source, count(*)::BIGINT AS documents, coalesce(sum(chunks), 0)::BIGINT AS chunks, coalesce(sum(chars), 0)::BIGINT AS chars FROM documents LEFT JOIN n USING (doc_id) GROUP BY source")
def chunk_count(spark, d):
    """Chunks and characters in them, by source: counted where the texts stand, so one shuffle of sums."""
    each = t(spark, d, "documents").select("source", I.chunk_array(F.col("text")).alias("c"))
    chars = F.aggregate("c", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return each.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.size("c")).alias("chunks"), F.sum(chars).alias("chars"))


@query("chunk_embeddings")
def chunk_embeddings(spark, d):
    """Chunks with vectors from the offline embedding: what is upserted into a collection."""
    c = I.chunks(t(spark, d, "documents"), "doc_id", "text")
    return capabilities.apply(c, "chunk", capabilities.hashed_embedding(), "vector").select("chunk_id", "vector", "vector_available")


KNOWN = "k AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'stale' ELSE left(sha256(text), 16) END AS h FROM documents WHERE doc_id % 7 <> 3)"


@query("incremental_plan", f"WITH {KNOWN}, n AS (SELECT d.doc_id, left(sha256(text), 16) AS content_hash, h, k.doc_id IS NULL AS fresh FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id) SELECT doc_id, content_hash, CASE WHEN fresh THEN 'new' ELSE 'changed' END AS status FROM n WHERE fresh OR h <> content_hash")
def incremental_plan(spark, d):
    """Documents that are new or changed against a manifest (here one that lacks some and has stale hashes of others)."""
    now = t(spark, d, "documents").select("doc_id", I.content_hash(F.col("text")).alias("content_hash"))
    known = now.where("doc_id % 7 <> 3").withColumn("content_hash", F.when(F.col("doc_id") % 5 == 0, F.lit("stale")).otherwise(F.col("content_hash")))
    return I.plan(now, known, "doc_id")


@query("upsert_latest", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark, d):
    return I.upsert(t(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


RANGES = "r AS (SELECT o_orderkey AS k, 1 AS lo, 1 + (o_orderkey % 3)::INT AS hi, 'head' AS chapter FROM orders UNION ALL SELECT o_orderkey, 3, 7, 'tail' FROM orders WHERE o_orderkey % 2 = 0)"


@query("page_range_join", f"WITH {RANGES} SELECT l_orderkey, l_linenumber, chapter, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN r ON l_orderkey = k AND l_linenumber BETWEEN lo AND hi GROUP BY ALL")
def page_range_join(spark, d):
    """Lines within the ranges of their order; overlapping ranges take a line twice."""
    o = t(spark, d, "orders")
    head = o.select("o_orderkey", F.lit(1).alias("start"), (F.lit(1) + F.col("o_orderkey") % 3).cast("int").alias("end"), F.lit("head").alias("chapter"))
    tail = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit(3).alias("start"), F.lit(7).alias("end"), F.lit("tail").alias("chapter"))
    lines = t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    met = I.page_ranges(lines, head.unionByName(tail), "o_orderkey", "l_linenumber").withColumnRenamed("o_orderkey", "l_orderkey")
    return met.groupBy("l_orderkey", "l_linenumber", "chapter").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("html_links", """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, count(DISTINCT href)::BIGINT AS links, min(href) AS first FROM l WHERE href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(lower(href), 'javascript:') GROUP BY page_id""")
def html_links(spark, d):
    """Distinct links of each page without anchors and scripts."""
    links = t(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("href"))
    links = links.where((F.col("href") != "") & ~F.col("href").startswith("#") & ~F.lower("href").startswith("javascript:"))
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.min("href").alias("first"))


HTML = f"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '{WS}+', ' ', 'g'))"


@query("html_text", f"SELECT page_id, sha256({HTML}) AS sha, length({HTML})::INTEGER AS chars FROM pages")
def html_text(spark, d):
    """Pages without markup."""
    c = F.regexp_replace("html", "(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->", " ")
    c = F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), "[ \\t\\n\\x0B\\f\\r]+", " "))
    return t(spark, d, "pages").select("page_id", F.sha2(c, 256).alias("sha"), F.length(c).alias("chars"))


def image_files(spark, d):
    """Files of parts: PNG and JPEG headers of some size, cut short where the number is divisible by 7, plain text by 11."""
    p = t(spark, d, "part")
    two = lambda n: F.lpad(F.hex(n), 4, "0")
    w, h, k = (F.col("p_size") * 16).cast("int"), (F.col("p_size") + 100).cast("int"), F.col("p_partkey")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D494844520000"), two(w), F.lit("0000"), two(h), F.lit("080200000012345678"), F.lit("0000000049454E44AE426082"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFDB000401C0FFC000110800"), F.substring(two(h), 3, 2), two(w), F.lit("03012200021101031101FFDA0002C0C1FFD9"))
    code = F.when(k % 2 == 0, png).otherwise(jpeg)
    cut = F.when(k % 11 == 0, F.hex(F.encode("p_name", "UTF-8"))).when(k % 7 == 0, F.left(code, F.length(code) - 4)).otherwise(code)
    return p.select("p_brand", F.unhex(cut).alias("content"))


@query("folder_inspection", """WITH f AS (SELECT p_brand AS folder, p_partkey % 11 = 0 OR p_partkey % 7 = 0 AS bad, (p_size * 16) || 'x' || (p_size + 100) AS size FROM part), n AS (SELECT folder, size, count(*) AS n FROM f WHERE NOT bad GROUP BY ALL)
SELECT folder, count(*)::BIGINT AS files, count_if(bad)::BIGINT AS corrupt, (SELECT string_agg(size || '=' || n, ',' ORDER BY size) FROM n WHERE n.folder = f.folder) AS sizes FROM f GROUP BY folder""")
def folder_inspection(spark, d):
    """Files, corrupt files and the sizes of sound ones in each folder (here brands), from the files' bytes."""
    got = images.inspected(image_files(spark, d), F.col("p_brand"))
    pairs = F.transform(F.map_entries("sizes"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return got.withColumn("sizes", F.array_join(pairs, ","))


@query("page_tables", """WITH p AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS page FROM lineitem), k AS (SELECT doc, page, CASE WHEN page % 3 = 0 THEN 1 ELSE 0 END AS strategy, CASE WHEN page IN (2, 4) THEN 2 ELSE page END AS same FROM p WHERE page <> 5),
f AS (SELECT *, row_number() OVER (PARTITION BY doc, same ORDER BY page) AS n FROM k)
SELECT doc, page, (row_number() OVER (PARTITION BY doc ORDER BY page) - 1)::INTEGER AS table_no, 2 AS n_rows, same || ':' || strategy AS mark FROM f WHERE n = 1""")
def page_tables(spark, d):
    """Tables of pages (lines of orders) by the first strategy that finds any; two pages hold the same one, one has none."""
    pages = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")).distinct()
    same = F.when(F.col("page").isin(2, 4), 2).otherwise(F.col("page"))
    row = lambda *cells: F.array(*[c if not isinstance(c, str) else F.lit(c) for c in cells])
    mark = lambda s: F.concat(same.cast("string"), F.lit(f":{s}"))
    table = lambda s: F.array(row("a", " b ", "c", "d", "e"), row("", "", "", "", ""), row(mark(s), "1", "2", "3", "4"))
    small = F.array(row("one", "row"))
    first = F.when(F.col("page") % 3 == 0, F.array(small)).when(F.col("page") == 5, F.array(small)).otherwise(F.array(small, table(0)))
    second = F.when(F.col("page") == 5, F.lit(None)).otherwise(F.array(table(1)))
    found = pages.select("doc", "page", F.explode(F.array(F.struct(F.lit(0).alias("strategy"), first.alias("tables")), F.struct(F.lit(1).alias("strategy"), second.alias("tables")))).alias("x")).select("doc", "page", "x.*")
    got = page_tables_of(found, "doc")
    return got.select("doc", "page", "table_no", F.size("cells").alias("n_rows"), F.get(F.get("cells", F.lit(1)), F.lit(0)).alias("mark"))


@query("dataset_counts", """WITH l AS (SELECT l_orderkey AS image, (l_linenumber - 1)::INT AS c FROM lineitem), g AS (SELECT image, min(c) AS class_id, count(*) AS lines FROM l WHERE c < 5 GROUP BY image),
s AS (SELECT image, lines, row_number() OVER (PARTITION BY class_id ORDER BY sha256('42:' || image), image) AS i, count(*) OVER (PARTITION BY class_id) AS n FROM g),
p AS (SELECT image, lines, CASE WHEN i <= round_even(n * 0.8::DOUBLE, 0) THEN 'train' WHEN i <= round_even(n * 0.8::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM s),
w AS (SELECT coalesce(split, 'none') AS split, count(*) AS wrong FROM l LEFT JOIN p USING (image) WHERE c >= 5 GROUP BY 1)
SELECT split, coalesce(k.images, 0)::BIGINT AS images, coalesce(k.lines, 0)::BIGINT AS lines, coalesce(wrong, 0)::BIGINT AS wrong FROM (SELECT split, count(*) AS images, sum(lines) AS lines FROM p GROUP BY split) k FULL JOIN w USING (split)""")
def dataset_counts(spark, d):
    """A dataset of label lines written by split: images and lines of each, and lines of classes that there aren't."""
    line = F.concat((F.col("l_linenumber") - 1).cast("string"), F.lit(" 0.5 0.5 0.25 "), F.round("l_discount", 2).cast("string"))
    return files.write_dataset(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), line.alias("line")), [f"class {i}" for i in range(5)], f"{files.shared_folder(spark)}/dataset-{uuid.uuid4().hex}", 16)


SPLIT = """s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) AS i, count(*) OVER (PARTITION BY lang) AS n FROM labels JOIN documents USING (doc_id)),
p AS (SELECT doc_id, lang, CASE WHEN i <= round_even(n * 0.8::DOUBLE, 0) THEN 'train' WHEN i <= round_even(n * 0.8::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM s)"""


def _split(spark, d):
    return V.split(t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang"), "doc_id"), "lang", "doc_id")


@query("stratified_split", f"WITH {SPLIT} SELECT doc_id, lang, split FROM p")
def stratified_split(spark, d):
    return _split(spark, d).select("doc_id", "lang", "split")


@query("split_counts", f"WITH {SPLIT} SELECT lang, count_if(split = 'train')::BIGINT AS train, count_if(split = 'val')::BIGINT AS val, count_if(split = 'test')::BIGINT AS test FROM p GROUP BY lang")
def split_counts(spark, d):
    return _split(spark, d).groupBy("lang").pivot("split", ["train", "val", "test"]).count().fillna(0)


@query("merge_collisions", "WITH a AS (SELECT doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id FROM labels WHERE quality = 1 UNION ALL SELECT doc_id FROM labels WHERE toxic = 1) SELECT doc_id, count(*)::BIGINT AS copies FROM a GROUP BY doc_id HAVING count(*) > 1")
def merge_collisions(spark, d):
    """Keys that several datasets hold."""
    labels = t(spark, d, "labels")
    return V.collisions([t(spark, d, "documents").where("lang = 'en'"), labels.where("quality = 1"), labels.where("toxic = 1")], "doc_id")


@query("missing_labels", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_labels(spark, d):
    return V.missing(t(spark, d, "documents"), t(spark, d, "labels"), "doc_id")


@query("missing_classes", "SELECT DISTINCT label FROM embeddings WHERE label NOT IN (SELECT label FROM embeddings JOIN labels ON doc_id = vec_id WHERE toxic = 1)")
def missing_classes(spark, d):
    """Classes without a toxic row."""
    e = t(spark, d, "embeddings").select("label", "vec_id")
    found = e.join(t(spark, d, "labels").where("toxic = 1"), F.col("doc_id") == F.col("vec_id"))
    return V.missing(e, found, "label")


@query("bbox_remap", """WITH l AS (SELECT l_orderkey AS image, (l_linenumber - 1)::INT AS c, round(l_discount, 2)::VARCHAR AS x FROM lineitem) SELECT image, string_agg(CASE c WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END || ' ' || x, ';' ORDER BY CASE c WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END || ' ' || x) AS lines FROM l WHERE c IN (0, 1, 3) GROUP BY image""")
def bbox_remap(spark, d):
    """Label lines with their classes mapped; others go, and images without any left."""
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.concat((F.col("l_linenumber") - 1).cast("string"), F.lit(" "), F.round("l_discount", 2).cast("string")).alias("line"))
    mapping = spark.createDataFrame([(0, 2), (1, 0), (3, 1)], "from_id int, to_id int")
    return V.remapped(lines, mapping).groupBy("image").agg(F.array_join(F.array_sort(F.collect_list("line")), ";").alias("lines"))
