"""Shared by the registered queries: tables, and pieces of DuckDB SQL."""

from __future__ import annotations

from tarn import dictionaries as D
from tarn.functions import text as X


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(s: str) -> str:
    """A string as an SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def class_of(s: str) -> str:
    """A pattern for RE2: Java's \\uXXXX and \\x0B as characters."""
    import re

    return re.sub(r"\\u([0-9A-F]{4})", lambda m: chr(int(m[1], 16)), s).replace("\\x0B", "\x0b")


TOKENS = f"regexp_extract_all({{}}, {q(class_of(X.TOKEN))})"
WS = "[ \\t\\n\x0b\\f\\r]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


#: BM25 of benchmark's texts over documents, as common table expressions ending in bm25(query_id, doc_id, score, rank).
BM25 = f"""
tok AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, coalesce(len({TOKENS.format('text')}), 0) AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, count(*) AS df, round(ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5), 9) AS raw FROM tf, st GROUP BY term),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT round(avg(raw), 9) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, round(sum(qtf * (idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
       FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
al AS (SELECT b.item_id AS query_id, d.doc_id, coalesce(sc.score, 0.0) AS score FROM benchmark b CROSS JOIN documents d
       LEFT JOIN sc ON sc.query_id = b.item_id AND sc.doc_id = d.doc_id),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM al) WHERE rank <= 30)
"""
#: The vector of benchmark item i is that of row i of embeddings; documents have the vector of their id.
VEC = """
vq AS (SELECT item_id AS query_id, embedding AS v FROM benchmark JOIN embeddings ON vec_id = item_id),
vs AS (SELECT query_id, vec_id AS doc_id, round(list_dot_product(v::DOUBLE[], embedding::DOUBLE[])
        / sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[]) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS score
       FROM vq, embeddings JOIN documents ON doc_id = vec_id),
vr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vs) WHERE rank <= 30)
"""
FUSED = """
fu AS (SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.doc_id, b.doc_id) AS doc_id, v.rank AS vector_rank, b.rank AS bm25_rank, v.score AS similarity,
        round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS score
       FROM vr v FULL JOIN bm25 b ON v.query_id = b.query_id AND v.doc_id = b.doc_id),
fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bm25_rank NULLS LAST, vector_rank NULLS LAST, doc_id) AS rank FROM fu) WHERE rank <= {k})
"""
#: Words that stand in the tables' English texts, for queries on dictionaries (the defaults are in another script).
WORDS = {"threat": ["menace"], "benefit": ["gain", "advantage"], "the": ["def"], "of the": ["genitive"]}
__all__ = ["BM25", "D", "FUSED", "TOKENS", "VEC", "WORDS", "WS", "class_of", "q", "strip_sql", "t"]
