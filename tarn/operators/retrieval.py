"""Hybrid retrieval: BM25 over postings, exact vector search in blocks, Reciprocal Rank Fusion, late materialisation."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.config import Settings
from tarn.functions import text as X
from tarn.operators.lexical import bm25, bm25_of_many, index, term_counts, term_weights, top
from tarn.sources.files import stored


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, term, tf): one row for each term of a document; counted before the shuffle."""
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.explode(X.tokens(F.col(text_col))).alias("term"))
        .groupBy("doc_id", "term")
        .agg(F.count("*").alias("tf"))
    )


def lengths(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.size(X.tokens(F.col(text_col))), F.lit(0)).cast("long").alias("dl"))


def corpus(lens: DataFrame) -> DataFrame:
    """One row: documents and their mean length."""
    return lens.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


#: Rows of a chunk, and queries that are scored against it at once: a task holds a few matrices of this size.
_ROWS, _TILE = 4096, 128
#: Bytes of a chunk's vectors: chunks of wide ones have fewer rows, as a hundred of them may wait for a file to be written.
_BYTES = 2 << 20


def _packed(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(blob: bytes) -> dict:
    return dict(np.load(io.BytesIO(blob)))


def _number_of_blocks(queries: DataFrame, block: int) -> int:
    return max(1, -(-queries.count() // block))


def _reaching(found: list, held: np.ndarray) -> list:
    """Pieces (query, id, score) as one, without what the k best scores of each query have left behind."""
    q, ids, value = (join([f[i] for f in found]) for i, join in enumerate((np.concatenate, pa.concat_arrays, np.concatenate)))
    on = value >= held[q, 0]
    return [(q[on], ids.filter(pa.array(on)), value[on])]


def vector_top(queries: DataFrame, rows: DataFrame, k: int, metric: str = "cosine", least: float | None = None, block: int = 4096, query_id="query_id", id_col="vec_id", vector="embedding") -> DataFrame:
    """(query_id, id, score, rank): the k nearest rows of each query by cosine or by 1 - squared distance; only scores of at least ``least``.

    Rows are packed into chunks and queries into blocks, both written once; every chunk meets every block where they are read,
    without a shuffle. A task keeps the k best scores of each of its queries and hands on only what reaches them in the end, and
    ``least``.
    A score that isn't a number, such as the cosine of a vector of length 0, comes first, as it does in SQL.
    """
    q = queries.select(F.col(query_id).alias("id"), F.col(vector).alias("v")).where("v is not null")
    base = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where("v is not null")
    n = _number_of_blocks(q, block)
    q_type, id_type = (x.schema["id"].dataType.simpleString() for x in (q, base))
    floor = -np.inf if least is None else float(least)

    def matrix(v) -> np.ndarray:
        flat = v.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(v), -1)

    def one_row(t: pa.Table, ids: str, vectors: str) -> pa.Table:
        t = t.combine_chunks()
        i, v = (t.column(c).combine_chunks() for c in ("id", "v"))
        return pa.table({ids: pa.ListArray.from_arrays(pa.array([0, len(i)], pa.int32()), i), vectors: pa.array([_packed(x=matrix(v))], pa.binary())})

    def chunked(it):
        held, some, most = [], 0, _ROWS
        for b in it:
            if b.num_rows:
                most = max(1, min(_ROWS, _BYTES * b.num_rows // max(1, b.column("v").nbytes)))
            at = 0
            while at < b.num_rows:
                held.append(b.slice(at, max(1, most - some)))
                at += held[-1].num_rows
                some += held[-1].num_rows
                if some >= most:
                    yield from one_row(pa.Table.from_batches(held), "ids", "vectors").to_batches()
                    held, some = [], 0
        if held:
            yield from one_row(pa.Table.from_batches(held), "ids", "vectors").to_batches()

    def block_of(t: pa.Table) -> pa.Table:
        return one_row(t, "queries", "asked").append_column("block", t.column("block").slice(0, 1))

    def scored(it):
        best = {}  # by block: its queries, the k best scores of each so far in rising order, and pieces that may be among them
        handed = lambda of, q, ids, value: pa.RecordBatch.from_arrays([of.take(pa.array(q)), ids, pa.array(np.where(value == np.inf, np.nan, value))], names=["query_id", "id", "score"])
        for b in it:
            for block, ids, vectors, of, asked in zip(*(b.column(c) for c in ("block", "ids", "vectors", "queries", "asked"))):
                x, y = _unpacked(vectors.as_py())["x"].astype(np.float64), _unpacked(asked.as_py())["x"].astype(np.float64)
                order = np.array(pc.sort_indices(ids.values))
                x, ids = x[order], ids.values.take(pa.array(order))
                if metric == "cosine":
                    with np.errstate(invalid="ignore"):
                        x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
                xx, yy = (x**2).sum(1), (y**2).sum(1)
                numbers = np.isfinite(xx).all() and np.isfinite(yy).all()
                # query ids are copied, so that they don't hold the batch
                of, held, found = best.setdefault(block.as_py(), (of.values.take(pa.array(np.arange(len(y)))), np.full((len(y), k), floor), []))
                for lo in range(0, len(y), _TILE):
                    part = slice(lo, lo + _TILE)
                    score = y[part] @ x.T
                    if metric != "cosine":  # 1 - (yy - 2 yx + xx)
                        score *= -2
                        score += yy[part, None]
                        score += xx
                        np.subtract(1, score, out=score)
                    if not numbers:
                        score[np.isnan(score)] = np.inf
                    reach = held[part, 0]
                    for again in (True, False):
                        # scores are rounded where they may reach the best ones only
                        near = reach - np.where(np.isfinite(reach), 1e-6 + 1e-15 * np.abs(reach), 0)
                        may = score >= near[:, None]
                        if not again or score.shape[1] <= k or np.count_nonzero(may) <= 4 * k * len(score):
                            break
                        reach = np.maximum(reach, np.round(np.partition(score, -k, axis=1)[:, -k], 6))
                    q, col = np.nonzero(may)
                    value = np.round(score[q, col], 6)
                    on = value >= reach[q]
                    q, col, value = q[on], col[on], value[on]
                    by = np.lexsort((col, -value, q))
                    q, col, value = q[by], col[by], value[by]
                    # rows are in the order of ids, so that the first of equal ones stay
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    q, col, value, place = (v[place < k] for v in (q, col, value, place))
                    if len(q):
                        found.append((lo + q, ids.take(pa.array(col)), value))
                        able, at = np.unique(q, return_inverse=True)
                        new = np.full((len(able), k), -np.inf)
                        new[at, place] = value
                        held[lo + able] = np.sort(np.hstack([held[lo + able], new]), axis=1)[:, -k:]
                room = k * len(y)
                if sum(len(f[0]) for f in found) > 2 * room:
                    found[:] = _reaching(found, held)
                    if len(found[0][0]) > 1.5 * room:  # many equal scores
                        yield handed(of, *found.pop())
        for of, held, found in best.values():
            if found:
                yield handed(of, *_reaching(found, held)[0])

    # dealt anew, so that chunks are full and as many as there are tasks, however rows lie; and written, as below Python gets a few rows
    # at a time, which would be those that chunks are made of
    chunks = stored(base.repartition("id", "v").mapInArrow(chunked, f"ids array<{id_type}>, vectors binary"))
    blocks = q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).groupBy("block").applyInArrow(block_of, f"queries array<{q_type}>, asked binary, block int")
    met = chunks.crossJoin(stored(blocks)).select("block", "ids", "vectors", "queries", "asked")
    # written here, so that pairs of chunks and blocks go to Python a few at a time
    found = stored(met.mapInArrow(scored, f"query_id {q_type}, id {id_type}, score double"), arrow_rows=2)
    return top(found, ["query_id"], [F.desc("score"), F.asc("id")], k)


def fuse(vector: DataFrame, words: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """(query_id, doc_id, score, vector_rank, bm25_rank, similarity, rank) by the sum of 1 / (rrf_k + rank)."""
    v = vector.select("query_id", F.col("id").alias("doc_id"), F.col("rank").alias("vector_rank"), F.col("score").alias("similarity"))
    w = words.select("query_id", "doc_id", F.col("rank").alias("bm25_rank"))
    part = lambda c: F.coalesce(1.0 / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    both = v.join(w, ["query_id", "doc_id"], "full_outer").withColumn("score", F.round(part("vector_rank") + part("bm25_rank"), 9))
    order = [F.desc("score"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("vector_rank"), F.asc("doc_id")]
    return top(both, ["query_id"], order, k)


def with_payload(ranked: DataFrame, docs: DataFrame, columns: list[str]) -> DataFrame:
    """Texts and metadata of ranked ids, joined after the cut; ids without a row drop out, so fewer than k may stay."""
    return ranked.join(docs.select("doc_id", *columns), "doc_id").withColumn("display", F.round(F.coalesce("similarity", "score"), 4))


def retrieve(queries: DataFrame, docs: DataFrame, rows: DataFrame, s: Settings = Settings(), hybrid: bool = True, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, vector_rank, bm25_rank, similarity, rank) of queries (query_id, text, embedding).

    By words and vectors, or by vectors alone where words are switched off or there are no documents to index. Blank
    queries have no rows.
    """
    k = s.top_k if k is None else k
    asked = queries.where(X.strip(F.coalesce("text", F.lit(""))) != "")
    pool = vector_top(asked, rows, s.pool if hybrid else k)
    if not hybrid or docs.isEmpty():
        none = F.lit(None).cast("int").alias("bm25_rank")
        return pool.where(F.col("rank") <= k).select("query_id", F.col("id").alias("doc_id"), "score", F.col("rank").alias("vector_rank"), none, F.col("score").alias("similarity"), "rank")
    return fuse(pool, bm25(asked, docs, s, query_id="query_id"), k, s.rrf_k)
