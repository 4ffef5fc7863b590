"""Queries of whole runs: normalized questions, routes with a model, ingest, retrieval without words, evaluation, images."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.operators import answers as A
from tarn.operators import detection as V
from tarn.operators import evaluation as E
from tarn.operators import ingest as I
from tarn.operators import retrieval as R
from tarn.operators import routing as N
from tarn.sources import knowledge
from tarn.sources.capabilities import Capability
from tarn.sources.files import shared_folder

from .common import TOKENS, VEC, D, class_of, q, strip_sql, t
from .guard import ROUTE, TURNS
from .ingest import CHUNKS_OF, KEPT, SQUEEZED
from .registry import query

SCRIPT = f"""n AS (SELECT {TURNS}, {strip_sql("coalesce(text, '')")} AS t FROM conversations), c AS (SELECT *, len(regexp_extract_all(t, {q(class_of(X.QUERY_CHARS))})) AS n, len(regexp_extract_all(t, '[{D.BANGLA}]')) AS b, len(regexp_extract_all(t, '[A-Za-z]')) AS l FROM n),
s AS (SELECT *, CASE WHEN n = 0 THEN 'unknown' WHEN b::DOUBLE / n >= 0.7 THEN 'bangla' WHEN l::DOUBLE / n >= 0.7 THEN 'latin' ELSE 'mixed' END AS script FROM c)"""


@query("query_normalize", f"WITH {SCRIPT} SELECT {TURNS}, script, CASE WHEN script IN ('bangla', 'unknown') THEN 'passthrough' ELSE 'fallback' END AS method, sha256(t) AS sha FROM s")
def query_normalize(spark, d):
    """Turns made ready for search, without a model: other scripts stay, with a warning."""
    got = A.normalized(t(spark, d, "conversations").select("conv_id", "turn", "text"), "text")
    return got.select("conv_id", "turn", "script", "method", F.sha2("normalized", 256).alias("sha"))


def _weather_man():
    """A stand-in model: says weather for texts of even length, nothing that parses for others."""
    return lambda texts: ['```json\n{"needs_rag": false, "needs_weather": true, "needs_price": false}\n```' if len(x) % 2 == 0 else "no idea" for x in texts]


@query("model_route", f"""WITH {ROUTE}, m AS (SELECT f.*, length(text) % 2 = 0 AND NOT is_off_topic AS told, regexp_matches(text, {q('(?i)' + D.PRICE)}) AS asks, text FROM f JOIN conversations USING ({TURNS})),
x AS (SELECT m.*, r.crops AS named FROM m JOIN r USING ({TURNS}))
SELECT {TURNS}, NOT told AND needs_rag AS needs_rag, told OR needs_weather AS needs_weather, CASE WHEN told THEN asks AND len(named) > 0 ELSE needs_price END AS needs_price, CASE WHEN told THEN 'model' ELSE 'keywords' END AS source FROM x""")
def model_route(spark, d):
    """Routes of a model where its reply is whole, else of keywords; crops that a question names override the reply."""
    got = N.routed(t(spark, d, "conversations").select("conv_id", "turn", "text"), "text", Capability("router", _weather_man))
    return got.select("conv_id", "turn", "route.needs_rag", "route.needs_weather", "route.needs_price", "source")


@query("table_records", """WITH r AS (SELECT l_orderkey, string_agg(l_linenumber || CASE WHEN l_returnflag = 'N' THEN '' ELSE ' | ' || l_returnflag END || ' | ' || l_linestatus, '\n' ORDER BY l_linenumber, l_returnflag, l_linestatus) AS text FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, text, true AS is_table FROM r WHERE length(text) >= 20""")
def table_records(spark, d):
    """Orders as tables of cells, written out as texts; empty cells are left out, short tables go."""
    flag = F.when(F.col("l_returnflag") == "N", F.lit("")).otherwise(F.col("l_returnflag"))
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus", flag.alias("flag")))).alias("x"))
    cells = F.transform("x", lambda r: F.array(r["l_linenumber"].cast("string"), r["flag"], r["l_linestatus"]))
    return I.table_records(rows.select("l_orderkey", cells.alias("rows")), "rows")


def _pages(spark, d):
    """(pages, sources): sources stand for documents, and their texts for pages."""
    docs = t(spark, d, "documents").withColumn("filename", F.col("source")).withColumn("page", F.col("doc_id"))
    pages = docs.join(docs.groupBy("filename").agg(F.substring(F.sha2(F.max("text"), 256), 1, 16).alias("content_hash")), "filename").select("filename", "page", "text", "content_hash")
    sources = docs.select("filename").distinct().where(~F.col("filename").endswith("2")).select(
        "filename", F.upper("filename").alias("title"), F.lit("org").alias("source_org"), F.lit(None).cast("string").alias("source_url"), F.array(F.lit("rice")).alias("crop"))
    return pages, sources


def _ingested(spark, d):
    pages, sources = _pages(spark, d)
    known = pages.select("filename", "content_hash").distinct().where(F.col("filename").endswith("1"))
    return I.run(pages, None, sources, known, D.LATIN)


#: Records of all documents but those that are known: r (filename, page, chunk_id, text, ...).
RECORDS = f"""RECURSIVE {KEPT}, y AS (SELECT doc_id, source, {SQUEEZED} AS text FROM k), {CHUNKS_OF.replace("$table", "y")},
r AS (SELECT source AS filename, doc_id AS page, source || '::c' || (row_number() OVER (PARTITION BY source ORDER BY doc_id, chunk_no) - 1) AS chunk_id, chunk AS text, CASE WHEN ends_with(source, '2') THEN source ELSE upper(source) END AS title,
  CASE WHEN ends_with(source, '2') THEN 'unspecified' ELSE 'org' END AS source_org, 'not recorded' AS source_url, CASE WHEN ends_with(source, '2') THEN '' ELSE 'rice' END AS crop FROM c JOIN documents USING (doc_id))"""


@query("ingest_run", f"WITH {RECORDS} SELECT * FROM r WHERE NOT ends_with(filename, '1')")
def ingest_run(spark, d):
    """Records of all new or changed documents (here a source is a document, and each of its texts a page)."""
    return _ingested(spark, d)[0].select("filename", "page", "chunk_id", "text", "title", "source_org", "source_url", "crop")


@query("ingest_manifest", "SELECT source AS filename, left(sha256(max(text)), 16) AS content_hash FROM documents WHERE NOT ends_with(source, '1') GROUP BY source")
def ingest_manifest(spark, d):
    """The hashes of what the run has done."""
    return _ingested(spark, d)[1].select("filename", "content_hash")


@query("ingest_counts", f"""WITH {RECORDS} SELECT count(DISTINCT source)::BIGINT AS documents, (SELECT count(*) FROM r)::BIGINT AS records, 0::BIGINT AS tables, 0::BIGINT AS without_vector, (SELECT sum(length(text)) FROM r)::BIGINT AS chars, 0::BIGINT AS changed,
(SELECT count(*) FROM r)::BIGINT AS kept FROM documents""")
def ingest_counts(spark, d):
    """What a run into a knowledge base counted while it wrote, and that a second run of the same pages changes nothing."""
    base = knowledge.KnowledgeBase(spark, f"{shared_folder(spark)}/knowledge-{uuid.uuid4().hex}")
    pages, sources = _pages(spark, d)
    first = base.run(pages, sources, 0, script=D.LATIN)
    again = base.run(pages, sources, 1, script=D.LATIN)
    counts = first | {"changed": again["documents"]}
    return base.records.current().agg(F.count("*").alias("kept")).select("*", *[F.lit(v).cast("long").alias(k) for k, v in counts.items()])


@query("vector_only", f"WITH {VEC} SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM vr JOIN benchmark ON item_id = query_id WHERE rank <= 5 AND {strip_sql('text')} <> ''")
def vector_only(spark, d):
    """Retrieval with words switched off."""
    vectors = t(spark, d, "embeddings")
    queries = t(spark, d, "benchmark").join(vectors, F.col("vec_id") == F.col("item_id")).select(F.col("item_id").alias("query_id"), "text", "embedding")
    docs = t(spark, d, "documents")
    rows = vectors.join(docs.select("doc_id"), F.col("vec_id") == F.col("doc_id")).select("vec_id", "embedding")
    return R.retrieve(queries, docs, rows, hybrid=False).select("query_id", "doc_id", "score", "rank")


LOW = f"list_distinct({TOKENS.format('lower({})')})"


@query("eval_run", f"""WITH e AS (SELECT item_id, b.text AS truth, item_id % 3 AS k, d.text AS chunk FROM benchmark b LEFT JOIN documents d ON doc_id = item_id)
SELECT item_id AS id, CASE WHEN k = 2 OR chunk IS NULL THEN NULL ELSE k = 0 END AS route_correct, CASE WHEN k = 2 OR chunk IS NULL THEN NULL ELSE true END AS hit,
 CASE WHEN k = 2 OR chunk IS NULL THEN NULL ELSE round(len(list_intersect({LOW.format('truth')}, {LOW.format('chunk')}))::DOUBLE / nullif(len({LOW.format('truth')}), 0), 6) END AS faithfulness,
 CASE WHEN chunk IS NULL THEN 'no result' WHEN k = 2 THEN 'timed out' END AS error FROM e""")
def eval_run(spark, d):
    """Items as questions, documents of their ids as what was retrieved: some fail, some take another route."""
    queries = t(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("query"), F.lit("rag+price").alias("expected_route"), F.col("text").alias("ground_truth"))
    docs = t(spark, d, "documents").join(t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("answer")), "doc_id")
    k, good = F.col("doc_id") % 3, F.col("doc_id") % 3 != 2
    results = docs.select(
        F.col("doc_id").alias("id"), F.when(k == 0, F.lit("price+rag")).when(k == 1, F.lit("rag")).alias("route"), F.when(good, F.col("answer")).alias("answer"),
        F.when(good, F.array("text")).alias("chunks"), F.when(k == 2, F.lit("timed out")).alias("error"),
    )
    return E.run(E.selected(queries), results).select("id", "route_correct", "hit", F.round("faithfulness", 6).alias("faithfulness"), "error")


TERMS = {"rice": ("src1", "then"), "potato": ("src2", "ering")}


@query("image_contexts", """WITH b AS (SELECT user_id AS image, CASE event_type WHEN 'click' THEN 'rice_blast' WHEN 'view' THEN 'potato_healthy' ELSE 'other' END AS cls FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC,
  CASE event_type WHEN 'click' THEN 'rice_blast' WHEN 'view' THEN 'potato_healthy' ELSE 'other' END) AS n FROM events) WHERE n = 1),
h AS (SELECT CASE a.vec_id WHEN 0 THEN 'rice_blast' ELSE 'potato_healthy' END AS cls, e.vec_id AS i, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], e.embedding::DOUBLE[])
  / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) DESC, e.vec_id) AS rank FROM embeddings a, embeddings e JOIN documents ON doc_id = e.vec_id WHERE a.vec_id IN (0, 1)),
m AS (SELECT image, doc_id, rank, source, text, cls FROM b JOIN h USING (cls) JOIN documents ON doc_id = i WHERE rank <= 8),
f AS (SELECT *, CASE WHEN cls = 'rice_blast' THEN contains(source, 'src1') OR contains(source, 'then') ELSE contains(source, 'src2') OR contains(source, 'ering') END AS s,
 CASE WHEN cls = 'rice_blast' THEN contains(lower(text), 'src1') OR contains(lower(text), 'then') OR contains(lower(text), 'rice') ELSE contains(lower(text), 'src2') OR contains(lower(text), 'ering') OR contains(lower(text), 'potato') END AS x FROM m),
g AS (SELECT *, bool_or(s) OVER (PARTITION BY image) AS ns, bool_or(x) OVER (PARTITION BY image) AS nx FROM f)
SELECT image, doc_id, source, CASE WHEN ns THEN 'source' ELSE 'text' END AS scope, place FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY rank)::INTEGER AS place FROM g WHERE CASE WHEN ns THEN s WHEN nx THEN x ELSE false END) WHERE place <= 5""")
def image_contexts(spark, d):
    """Documents for each image's surest class, of the same crop only (users stand for images, event types for classes)."""
    cls = F.when(F.col("event_type") == "click", F.lit("rice_blast")).when(F.col("event_type") == "view", F.lit("potato_healthy")).otherwise(F.lit("other"))
    detections = t(spark, d, "events").select(F.col("user_id").alias("image"), cls.alias("class_name"), F.col("value").alias("confidence"))
    docs = t(spark, d, "documents").select("doc_id", "source", "text")
    # the vectors of two rows stand for those of the classes' questions
    vectors = t(spark, d, "embeddings")
    asked = vectors.where("vec_id in (0, 1)").select(F.when(F.col("vec_id") == 0, F.lit("rice_blast")).otherwise(F.lit("potato_healthy")).alias("query_id"), "embedding")
    hits = R.vector_top(asked, vectors.join(docs.select("doc_id"), F.col("vec_id") == F.col("doc_id")).select("vec_id", "embedding"), 8)
    hits = hits.select(F.col("query_id").alias("class_name"), F.col("id").alias("doc_id"), "rank")
    texts = {k: (*v, k) for k, v in TERMS.items()}
    return A.image_contexts(detections, hits, docs, TERMS, texts)


@query("primary_class", "SELECT l_orderkey AS image, min_by(l_linenumber - 1, (l_linenumber - 1) || ' ' || round(l_discount, 2))::INTEGER AS class_id FROM lineitem GROUP BY l_orderkey")
def primary_class(spark, d):
    """The class of each image's first label line."""
    line = F.concat((F.col("l_linenumber") - 1).cast("string"), F.lit(" "), F.round("l_discount", 2).cast("string"))
    return V.primary_class(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), line.alias("line")))


@query("unmatched_folders", "SELECT lang, count(*)::BIGINT AS images FROM documents WHERE lang NOT IN ('en', 'de') GROUP BY lang")
def unmatched_folders(spark, d):
    mapping = spark.createDataFrame([("en", 0), ("de", 1)], "from_label string, class_id int")
    return V.unmatched(t(spark, d, "documents").select("lang"), "lang", mapping)
