"""BM25 over postings in blocks with maxima: only blocks that can hold one of a query's best documents are read.

The index has a chunk for each ``rows`` documents, and within a chunk a block for each term: its postings, the highest
frequency and the least length of their documents. From those two follows a bound of what the term can add to any score of
the chunk, whatever the corpus' mean length turns out to be. A search

1. joins the queries' terms with the blocks' maxima alone, and sums them to a bound for each (query, chunk);
2. scores each query's chunk of the highest bound: if it holds ``pool`` documents, the last of them has a score that the
   query's last result reaches at least;
3. scores the chunks whose bound reaches that score, and no others.

Postings meet the queries by (chunk, block of queries): a block of postings is read once for all queries of a block of
queries that need it, and not at all if none does.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.config import Settings
from tarn.functions import text as X
from tarn.sources.files import stored

TOKEN = re.compile(X.TOKEN)


#: Terms that a task counts before it hands them on, and texts that are Python objects at once.
_TERMS, _TEXTS = 50_000, 64


def singly(column):
    """The values of an Arrow column one after the other, a few at once as Python objects."""
    for at in range(0, len(column), _TEXTS):
        yield from column.slice(at, _TEXTS).to_pylist()


class Hashes(dict):
    """64-bit hashes of terms; those of a task's last terms are remembered."""

    def __missing__(self, word):
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode()) - (1 << 63)
        return h


def _counts_of(texts, hashes: Hashes):
    """(terms, frequencies, distinct terms and length of each text) of an Arrow column, of which a few texts at once are
    Python objects."""
    term, tf, sizes, dl = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [], []
    for t in singly(texts):
        c = Counter(TOKEN.findall(t or ""))
        term.append(np.fromiter((hashes[w] for w in c), np.int64, len(c)))
        tf.append(np.fromiter(c.values(), np.int32, len(c)))
        sizes.append(len(c))
        dl.append(c.total())
    return np.concatenate(term), np.concatenate(tf), np.array(sizes, np.int64), np.array(dl, np.int32)


def top(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group, with rank; Spark prunes to k before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for ``size[0]`` numbers, and so on."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _counted(batches):
    """Counts of terms (term, df, cf) in texts: those of ``_TERMS`` terms and of one text more are held, then handed on."""

    def made(df, cf):
        return pa.RecordBatch.from_arrays([pa.array(df.keys(), pa.string()), pa.array(df.values(), pa.int64()), pa.array([cf[w] for w in df], pa.int64())], names=["term", "df", "cf"])

    df, cf = Counter(), Counter()
    for b in batches:
        for t in singly(b.column("text")):
            counts = Counter(TOKEN.findall(t or ""))
            cf.update(counts)
            df.update(counts.keys())
            if len(df) >= _TERMS:
                yield made(df, cf)
                df, cf = Counter(), Counter()
    yield made(df, cf)


def term_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, df, cf): documents that have a term, and its places. Counted where texts stand, before the one shuffle."""
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_counted, "term string, df long, cf long")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


@dataclass(frozen=True)
class Index:
    """``blocks`` (term, chunk, df, top_tf, least_dl, postings) and ``docs`` (chunk, place, doc_id, dl), both written."""

    blocks: DataFrame
    docs: DataFrame
    rows: int


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 512, by_term: bool = False) -> Index:
    """The index of a table of documents, written once for any number of searches.

    Postings are packed as (place, frequency, length) of 32 bits each; terms are told apart by 64-bit hashes. ``by_term`` lays
    blocks out by ranges of (term, chunk), so that searches for few terms skip most of the files; a frequent term spreads over
    several ranges. It costs a shuffle of the index.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    names = ["term", "chunk", "df", "top_tf", "least_dl", "postings", "ids", "dls"]

    def batches(it):
        from pyspark import TaskContext

        chunk, hashes = TaskContext.get().partitionId() << 32, Hashes()
        for b in it:
            for at in range(0, b.num_rows, rows):
                s = b.slice(at, rows)
                order = pc.sort_indices(s.column("doc_id"))
                ids = s.column("doc_id").take(order)
                term, tf, sizes, dl = _counts_of(s.column("text").take(order), hashes)
                doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
                by = np.argsort(term, kind="stable")
                term, packed = term[by], np.stack([doc[by], tf[by], dl[doc[by]]], axis=1)
                first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.empty(0, np.int64)
                offsets = np.append(first, len(term)).astype(np.int32) * 12
                blocks = [
                    pa.array(term[first]), pa.array(np.full(len(first), chunk)), pa.array(np.diff(np.append(first, len(term))), pa.int32()),
                    pa.array(np.maximum.reduceat(packed[:, 1], first) if len(first) else first, pa.int32()), pa.array(np.minimum.reduceat(packed[:, 2], first) if len(first) else first, pa.int32()),
                    pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(packed))]),
                    pa.nulls(len(first), pa.list_(ids.type)), pa.nulls(len(first), pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(blocks, names=names)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x)
                head = [pa.nulls(1, pa.int64()), pa.array([chunk]), *[pa.nulls(1, pa.int32())] * 3, pa.nulls(1, pa.binary()), one(ids), one(pa.array(dl))]
                yield pa.RecordBatch.from_arrays(head, names=names)
                chunk += 1

    made = stored(chosen.mapInArrow(batches, f"term long, chunk long, df int, top_tf int, least_dl int, postings binary, ids array<{kind}>, dls array<int>"))
    blocks = made.where("term is not null").drop("ids", "dls")
    if by_term:
        blocks = stored(blocks.repartitionByRange("term", "chunk").sortWithinPartitions("term", "chunk"))
    each = made.where("term is null").select("chunk", F.posexplode(F.arrays_zip(F.col("ids").alias("id"), F.col("dls").alias("dl"))).alias("place", "x"))
    return Index(blocks, each.select("chunk", "place", F.col("x.id").alias("doc_id"), F.col("x.dl").cast("long").alias("dl")), rows)


def term_weights(indexed: Index, epsilon: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(term, df, idf) by the hashes of terms, and one row with n and avgdl; a term in more than half of the documents
    gets epsilon times the mean idf."""
    stats = stored(indexed.docs.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")))
    return _weighted(stored(indexed.blocks.groupBy("term").agg(F.sum("df").alias("df"))), stats, epsilon), stats


def _weighted(sums: DataFrame, stats: DataFrame, epsilon: float) -> DataFrame:
    # stats and mean are one row each, by construction
    raw = sums.join(F.broadcast(stats.select("n"))).select("term", "df", F.round(F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5), 9).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.lit(epsilon) * F.round("mean", 9)).otherwise(F.col("raw")).alias("idf"))


def asked_terms(queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
    """(query_id, term, qtf): the terms of each query."""
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_text).alias("text"))

    def batches(it):
        hashes = Hashes()
        for b in it:
            counts = [Counter(TOKEN.findall(t or "")) for t in b.column("text").to_pylist()]
            of = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            yield pa.RecordBatch.from_arrays(
                [b.column("query_id").take(pa.array(of)), pa.array([hashes[w] for c in counts for w in c], pa.int64()), pa.array([v for c in counts for v in c.values()], pa.int64())],
                names=["query_id", "term", "qtf"],
            )

    return q.mapInArrow(batches, f"query_id {q.schema['query_id'].dataType.simpleString()}, term long, qtf long")


def chunk_bounds(asked: DataFrame, indexed: Index, avgdl: float, s: Settings = Settings()) -> DataFrame:
    """(query_id, chunk, bound): what no document of the chunk can exceed. Reads the blocks' maxima, not their postings."""
    norm = s.k1 * (1 - s.b + s.b * F.col("least_dl") / (avgdl or 1.0))
    most = F.greatest("w", F.lit(0.0)) * F.col("top_tf") * (s.k1 + 1) / (F.col("top_tf") + norm)
    met = asked.join(indexed.blocks.select("term", "chunk", "top_tf", "least_dl"), "term")
    return met.groupBy("query_id", "chunk").agg(F.sum(most).alias("bound"))


def scored(pairs: DataFrame, asked: DataFrame, indexed: Index, avgdl: float, most: int, s: Settings = Settings(), parts: int = 1) -> DataFrame:
    """(query_id, chunk, place, score): for each (query_id, chunk) of ``pairs`` the best documents that have one of its terms."""
    kind = asked.schema["query_id"].dataType.simpleString()
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")
    wanted = pairs.select("query_id", "chunk").join(asked, "query_id").select("chunk", part.alias("part"), "query_id", "term", "w")
    needed = wanted.select(F.col("chunk").alias("in_chunk"), F.col("part").alias("in_part"), F.col("term").alias("in_term")).distinct()
    met = (F.col("term") == F.col("in_term")) & (F.col("chunk") == F.col("in_chunk"))
    blocks = indexed.blocks.select("term", "chunk", "postings").join(needed, met).select("in_chunk", "in_part", "term", "postings")
    k1, b_ = s.k1, s.b

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        packed = [np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 3) for x in right.column("postings")]
        if not packed or not left.num_rows:
            return pa.table({"query_id": left.column("query_id").slice(0, 0), "chunk": pa.array([], pa.int64()), "place": pa.array([], pa.int32()), "score": pa.array([], pa.float64())})
        size = np.array([len(p) for p in packed])
        start = np.cumsum(size) - size
        doc, tf, dl = np.concatenate(packed).T
        gain = tf * (k1 + 1) / (tf + k1 * (1 - b_ + b_ * dl / (avgdl or 1.0)))
        term = right.column("term").to_numpy()
        by = np.argsort(term)
        at = np.minimum(np.searchsorted(term, left.column("term").to_numpy(), sorter=by), len(term) - 1)
        at = by[at]
        hit = term[at] == left.column("term").to_numpy()
        coded = left.column("query_id").combine_chunks().dictionary_encode()
        query, w, at = coded.indices.to_numpy()[hit], left.column("w").to_numpy()[hit], at[hit]
        order = np.argsort(query, kind="stable")
        query, w, at = query[order], w[order], at[order]
        cut = np.searchsorted(query, np.arange(len(coded.dictionary) + 1))
        of, places, scores = [], [], []
        for i, (a, e) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            take = ranges(start[at[a:e]], size[at[a:e]])
            sums = np.round(np.bincount(doc[take], np.repeat(w[a:e], size[at[a:e]]) * gain[take]), 6) + 0.0
            found = np.unique(doc[take])
            # places are in the order of ids, so that the first of equal ones stay
            best = found[np.argsort(-sums[found], kind="stable")[:most]]
            of.append(np.full(len(best), i))
            places.append(best)
            scores.append(sums[best])
        of, places, scores = (np.concatenate(x) for x in (of, places, scores))
        chunk = left.column("chunk")[0].as_py()
        return pa.table({"query_id": coded.dictionary.take(pa.array(of)), "chunk": pa.array(np.full(len(of), chunk)), "place": pa.array(places, pa.int32()), "score": scores})

    met = wanted.groupBy("chunk", "part").cogroup(blocks.groupBy("in_chunk", "in_part"))
    return met.applyInArrow(score, f"query_id {kind}, chunk long, place int, score double")


def survivors(bounds: DataFrame, first: DataFrame, least: DataFrame) -> DataFrame:
    """(query_id, chunk): those whose bound reaches the query's least score, without those of ``first``."""
    met = bounds.join(first.select("query_id", "chunk"), ["query_id", "chunk"], "left_anti").join(least, "query_id", "left")
    # scores are rounded to six digits, bounds aren't
    return met.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6)).select("query_id", "chunk")


def bm25(queries: DataFrame, docs: DataFrame, s: Settings = Settings(), query_id="item_id", query_text="text", id_col="doc_id", text_col="text", indexed: Index | None = None, block: int = 1024) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``pool`` best documents of each query, documents without its terms included.

    ``indexed`` is what ``index`` made of the documents, for several searches; ``block`` bounds the queries that meet in a group.
    """
    indexed = index(docs, id_col, text_col) if indexed is None else indexed
    weights, stats = term_weights(indexed, s.epsilon)
    asked = asked_terms(queries, query_id, query_text).join(weights, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))
    asked = stored(asked)
    avgdl = stats.first()["avgdl"]
    lowest, n = asked.agg(F.min("w"), F.count_distinct("query_id")).first()
    # weights are below 0 only where the mean term is in over half of the documents; then no score may be left out
    plain = lowest is None or lowest >= 0
    most, parts = (s.pool if plain else indexed.rows), max(1, -(-n // block))
    bounds = stored(chunk_bounds(asked, indexed, avgdl, s))
    first = stored(top(bounds, ["query_id"], [F.desc("bound"), F.asc("chunk")], 1).select("query_id", "chunk"))
    begun = stored(scored(first, asked, indexed, avgdl, most, s, parts))
    last = top(begun, ["query_id"], [F.desc("score")], s.pool).where((F.col("rank") == s.pool) & (F.col("score") > 0))
    least = last.select("query_id", F.col("score").alias("least"))
    rest = scored(survivors(bounds, first, least) if plain else bounds.join(first, ["query_id", "chunk"], "left_anti"), asked, indexed, avgdl, most, s, parts)
    found = begun.unionByName(rest).join(indexed.docs.select("chunk", "place", "doc_id"), ["chunk", "place"]).select("query_id", "doc_id", "score")
    found = top(found, ["query_id"], [F.desc("score"), F.asc("doc_id")], s.pool).drop("rank") if plain else found
    found = stored(found)
    # where fewer than pool documents have a score above 0, the least ids of the others follow
    lacking = queries.select(F.col(query_id).alias("query_id")).distinct().join(found.where("score > 0").groupBy("query_id").agg(F.count("*").alias("__n")), "query_id", "left")
    lacking = lacking.where(F.coalesce("__n", F.lit(0)) < s.pool).select("query_id")
    ids = indexed.docs.select("doc_id").orderBy("doc_id")
    ids = (ids.limit(2 * s.pool) if plain else ids).agg(F.collect_list("doc_id").alias("ids"))
    # one row, of at most two pools of ids unless weights are below 0
    others = lacking.join(F.broadcast(ids)).select("query_id", F.explode("ids").alias("doc_id")).join(found.where("score > 0") if plain else found, ["query_id", "doc_id"], "left_anti")
    every = found.where("score > 0").unionByName(others.withColumn("score", F.lit(0.0))) if plain else found.unionByName(others.withColumn("score", F.lit(0.0)))
    return top(every, ["query_id"], [F.desc("score"), F.asc("doc_id")], s.pool)


def _packed_docs(docs: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(n, total, ids, dls, terms, ends, places, tfs): a row for each ``rows`` documents, with all their postings by term."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def batches(it):
        hashes = Hashes()
        for b in it:
            for at in range(0, b.num_rows, rows):
                s = b.slice(at, rows)
                order = pc.sort_indices(s.column("doc_id"))
                ids = s.column("doc_id").take(order)
                term, tf, sizes, dl = _counts_of(s.column("text").take(order), hashes)
                doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
                by = np.argsort(term, kind="stable")
                term = term[by]
                last = np.flatnonzero(np.append(term[1:] != term[:-1], True)) if len(term) else np.empty(0, np.int64)
                blobs = (term[last], (last + 1).astype(np.int32), doc[by], tf[by])
                one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                cols = [pa.array([len(ids)], pa.int64()), pa.array([int(dl.sum())], pa.int64()), one, *(pa.array([x.tobytes()], pa.binary()) for x in (dl, *blobs))]
                yield pa.RecordBatch.from_arrays(cols, names=["n", "total", "ids", "dls", "terms", "ends", "places", "tfs"])

    return stored(chosen.mapInArrow(batches, f"n long, total long, ids array<{kind}>, dls binary, terms binary, ends binary, places binary, tfs binary"))


def _frequencies(packed: DataFrame) -> DataFrame:
    def batches(it):
        for b in it:
            for terms, ends in zip(b.column("terms"), b.column("ends")):
                df = np.diff(np.frombuffer(ends.as_buffer(), np.int32), prepend=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms.as_buffer(), np.int64)), pa.array(df, pa.int64())], names=["term", "df"])

    return packed.select("terms", "ends").mapInArrow(batches, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def bm25_of_many(queries: DataFrame, docs: DataFrame, k: int, s: Settings = Settings(), query_id="item_id", query_text="text", id_col="doc_id", text_col="text", rows: int = 2048, block: int = 1024) -> DataFrame:
    """(query_id, doc_id, score, rank) as ``bm25`` returns them, for so many queries that rows of (query, chunk) are too many.

    Documents are packed into chunks and queries into blocks; every chunk meets every block where they are read, without a
    shuffle, so that what is written grows with documents and queries and not with their product. A task keeps the ``k`` best
    scores of each of its queries and hands on only documents that reach them.
    """
    packed = _packed_docs(docs, id_col, text_col, rows)
    stats = stored(packed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total") / F.sum("n"), F.lit(0.0)).alias("avgdl")))
    weights = _weighted(stored(_frequencies(packed)), stats, s.epsilon)
    avgdl = stats.first()["avgdl"] or 1.0
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_text).alias("text"))
    kind, id_kind = asked.schema["query_id"].dataType.simpleString(), packed.schema["ids"].dataType.elementType.simpleString()
    parts = max(1, -(-asked.count() // block))
    weighted = asked_terms(asked, "query_id", "text").join(weights, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))
    every = weighted.unionByName(asked.select("query_id").distinct(), allowMissingColumns=True)  # those without known terms too

    def block_of(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        coded = t.column("query_id").combine_chunks().dictionary_encode()
        some = t.column("term").is_valid().to_numpy()
        of, term, w = coded.indices.to_numpy()[some], t.column("term").drop_null().to_numpy(), t.column("w").drop_null().to_numpy()
        by = np.argsort(of, kind="stable")
        ends = np.cumsum(np.bincount(of, minlength=len(coded.dictionary)))
        distinct, at = np.unique(term[by], return_inverse=True)
        one = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        blobs = (ends.astype(np.int64), distinct.astype(np.int64), at.astype(np.int32), w[by].astype(np.float64))
        return pa.table({"part": t.column("part").slice(0, 1), "queries": one, **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("q_ends", "q_terms", "q_at", "q_w"), blobs)}})

    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")
    blocks = stored(every.withColumn("part", part).groupBy("part").applyInArrow(block_of, f"part int, queries array<{kind}>, q_ends binary, q_terms binary, q_at binary, q_w binary"))
    k1, b_ = s.k1, s.b

    def score(it):
        best = {}  # by block: the k best of each query so far, and the scores to reach
        raw = lambda x, of: np.frombuffer(x.as_buffer(), of)
        for b in it:
            for part, queries, q_ends, q_terms, q_at, q_w, ids, dls, terms, ends, places, tfs in zip(*(b.column(c) for c in names)):
                ids, n = ids.values, len(ids)
                ends, doc, tf, terms = raw(ends, np.int32).astype(np.int64), raw(places, np.int32), raw(tfs, np.int32), raw(terms, np.int64)
                gain = tf * (k1 + 1) / (tf + k1 * (1 - b_ + b_ * raw(dls, np.int32)[doc] / avgdl))
                start = np.append(0, ends[:-1])
                q_terms, q_at, q_w = raw(q_terms, np.int64), raw(q_at, np.int32), raw(q_w, np.float64)
                # a block's term in this chunk: its first posting and their number, 0 where the chunk lacks it
                first = size = np.zeros(len(q_terms), np.int64)
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, q_terms), len(terms) - 1)
                    first, size = start[at], np.where(terms[at] == q_terms, ends[at] - start[at], 0)
                held, least = best.setdefault(part.as_py(), ([[] for _ in range(len(queries))], [-np.inf] * len(queries)))
                of, chosen, scores, lo = [], [], [], 0
                for i, hi in enumerate(raw(q_ends, np.int64).tolist()):
                    mine = q_at[lo:hi]
                    take = ranges(first[mine], size[mine])
                    sums = np.round(np.bincount(doc[take], np.repeat(q_w[lo:hi], size[mine]) * gain[take], n), 6) + 0.0
                    lo = hi
                    reach = np.flatnonzero(sums >= least[i])
                    if len(reach):
                        # places are in the order of ids, so that the first of equal ones stay
                        reach = reach[np.argsort(-sums[reach], kind="stable")[:k]]
                        mine = list(zip((-sums[reach]).tolist(), ids.take(pa.array(reach)).to_pylist()))
                        kept = sorted(held[i] + mine)[:k]
                        # of equal scores those with larger ids than the k-th stay out
                        reach = reach[[len(kept) < k or x <= kept[-1] for x in mine]]
                        held[i], least[i] = kept, -kept[-1][0] if len(kept) == k else -np.inf
                        of.append(np.full(len(reach), i))
                        chosen.append(reach)
                        scores.append(sums[reach])
                if of:
                    yield pa.RecordBatch.from_arrays([queries.values.take(pa.array(np.concatenate(of))), ids.take(pa.array(np.concatenate(chosen))), pa.array(np.concatenate(scores))], names=["query_id", "doc_id", "score"])

    names = ["part", "queries", "q_ends", "q_terms", "q_at", "q_w", "ids", "dls", "terms", "ends", "places", "tfs"]
    met = packed.drop("n", "total").crossJoin(blocks).select(*names)
    found = stored(met.mapInArrow(score, f"query_id {kind}, doc_id {id_kind}, score double"), arrow_rows=2)
    return top(found, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
