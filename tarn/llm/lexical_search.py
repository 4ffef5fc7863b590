"""Ranked lexical search over geometrically blocked posting lists, with exact bounds.

Documents lie in shards of up to ``shard`` documents. A shard's index is made where its documents stand:

* A posting's impact is what it adds to a score for each unit of the term's weight. A shard's terms are in order, from
  the rarest there to the most common.
* The documents of each posting list are clustered by the likeness of their vectors (random projections, two rounds): blocks of up to
  ``block`` documents that lie near one another.
* Each block has a summary: the coordinatewise maximum of its documents' impacts, rounded up to eight bits, for the list's
  own term and the more common ones. A query reads its terms' lists from the rarest on, and documents with a rarer term
  of the query are met in that term's list; so a summary needs no rarer coordinates.

A query's product with a summary bounds the scores of the block's documents that no earlier list holds. Blocks are taken by
their bounds, the highest first; a block is skipped only if its bound is below the score of the query's tenth document so
far. Results are those of scoring every document.

Spark deals the shards, and queries in blocks meet each shard: a stated set of queries against all rows. A first search of
at most ``pilot`` shards gives each query a score that its tenth document reaches at least; with it the search of all
shards skips most blocks, and hands on only documents that reach it.

The index holds the terms that the given queries ask for, found by a bitmap of bounded size and a join; other terms add
nothing to a score. Terms are told apart by 64-bit hashes.

Edge cases: a null or empty text has no terms, and no document without terms of a query is returned for it; items without
known terms have no rows; each row of the items is an item of its own, also if its id repeats or is null; repeated
documents are ranked each, ties by ascending id, a null id first; empty tables give no rows; texts of any length count
whole. Only the named columns are read, so further columns never clash.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table
from .words import Cells, mixed, text_bytes, words

#: An impact is below a million, so steps of this size number it in eight bits.
STEP = 4096
_DIMENSIONS = 32
#: So many documents go to Python at once.
_ROWS = 512


@dataclass(frozen=True)
class Layout:
    """Documents in a shard and in a block, queries in a block of queries, shards of the first search."""

    shard: int = 1024
    block: int = 64
    queries: int = 256
    pilot: int = 8


def asked_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, item_id, term, times): the terms of each row of items; ``query`` numbers the rows."""
    chosen = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))

    def batches(it):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for b in it:
            for w in words(text_bytes(b.column("text"))):
                of, term, times = _counted(w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of + row), b.column("item_id").take(pa.array(of + w.first)), pa.array(term.view(np.int64)), pa.array(times)], names=["query", "item_id", "term", "times"]
                )
                row += len(w)

    return chosen.mapInArrow(batches, f"query long, item_id {chosen.schema['item_id'].dataType.simpleString()}, term long, times long")


def _counted(w, known=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) of the words, by text and term."""
    of, term = w.text_of(), w.hash
    if known is not None:
        ok = known.has(term)
        of, term = of[ok], term[ok]
    order = np.lexsort((term, of))
    of, term = of[order], term[order]
    first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (term[1:] != term[:-1])))) if len(of) else np.empty(0, np.int64)
    return of[first], term[first], np.diff(np.append(first, len(of)))


def statistics(docs: DataFrame, text_col: str, cells) -> DataFrame:
    """(kind, term, n): documents of each asked term (kind 0), documents with terms (1) and all terms (2)."""

    def batches(it):
        for b in it:
            for w in words(text_bytes(b.column("text"))):
                term, n = np.unique(_counted(w, cells.value)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] * len(term) + [1, 2]), pa.array([*term.view(np.int64).tolist(), 0, 0]), pa.array([*n.tolist(), int((w.counts() > 0).sum()), len(w.hash)])],
                    names=["kind", "term", "n"],
                )

    return docs.select(F.col(text_col).alias("text")).mapInArrow(batches, "kind long, term long, n long").groupBy("kind", "term").agg(F.sum("n").alias("n"))


def _packed(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(blob: bytes) -> dict:
    return dict(np.load(io.BytesIO(blob)))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for ``size[0]`` numbers, and so on."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def blocked(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n: int, block: int) -> dict:
    """The index of one shard of ``n`` documents from its postings.

    term: hashes from the rarest to the most common; rows: where each document's postings begin; lists: where each term's
    blocks begin; blocks: where each block's documents begin in ``members``; heads: where each block's summary begins in
    ``sum_term`` and ``sum_top``.
    """
    terms, number, df = np.unique(term, return_inverse=True, return_counts=True)
    by_df = np.lexsort((terms, df))
    rank = np.empty(len(terms), np.int64)
    rank[by_df] = np.arange(len(terms))
    terms, number = terms[by_df], rank[number]
    order = np.lexsort((number, doc))
    doc, number, impact = doc[order], number[order], impact[order]
    rows = np.searchsorted(doc, np.arange(n + 1))
    # a document's vector by random signs of its terms, the rarer the heavier, as in scores
    signs = (mixed(terms)[:, None] >> np.arange(_DIMENSIONS, dtype=np.uint64)[None, :] & np.uint64(1)).astype(np.float32) * 2 - 1
    signs *= np.log((n + 1) / df[by_df])[:, None].astype(np.float32)
    sketch = np.zeros((n, _DIMENSIONS), np.float32)
    for d in range(_DIMENSIONS):
        sketch[:, d] = np.bincount(doc, signs[number, d] * impact, n)
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
    by_term = np.lexsort((doc, number))
    starts = np.searchsorted(number[by_term], np.arange(len(terms) + 1))
    members, cuts, lists = by_term.copy(), [], np.zeros(len(terms) + 1, np.int64)
    for t, (a, e) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        if e - a <= block:
            cuts.append(a)
        else:
            mine = by_term[a:e]
            middle = np.linspace(0, e - a - 1, -(-(e - a) // block)).astype(np.int64)
            x = sketch[doc[mine]]
            cluster = np.argmax(x @ x[middle].T, axis=1)
            # once more around the clusters' means
            means = np.stack([np.bincount(cluster, x[:, d], len(middle)) for d in range(_DIMENSIONS)], axis=1)
            cluster = np.argmax(x @ (means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)).T, axis=1)
            members[a:e] = mine[np.lexsort((-impact[mine], cluster))]
            edges = np.cumsum(np.bincount(cluster, minlength=len(middle)))
            for lo, hi in zip([0, *edges[:-1].tolist()], edges.tolist()):
                cuts += range(a + lo, a + hi, block)
        lists[t + 1] = len(cuts)
    blocks = np.append(np.array(cuts, np.int64), len(by_term))
    # summaries: for each member, its document's postings from the list's term on
    stop = rows[doc[members] + 1]
    of_block = np.repeat(np.arange(len(cuts)), np.diff(blocks))
    narrow = np.uint16 if len(terms) <= 1 << 16 else np.int32
    sum_term, sum_top, count, sizes = [np.empty(0, narrow)], [np.empty(0, np.uint8)], np.zeros(len(cuts), np.int64), np.cumsum(stop - members)
    at = 0
    while at < len(members):  # some entries at a time, cut between blocks
        until = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (1 << 18)))
        if until < len(members):
            until = int(max(blocks[np.searchsorted(blocks, until, side="right") - 1], blocks[np.searchsorted(blocks, at, side="right")]))
        m = members[at:until]
        take = _ranges(m, stop[at:until] - m)
        top = -(-impact[take] // STEP)
        key = (np.repeat(of_block[at:until], stop[at:until] - m) * len(terms) + number[take]) << 8 | top
        key.sort()
        key = key[np.append(key[1:] >> 8 != key[:-1] >> 8, True)]
        count += np.bincount((key >> 8) // len(terms), minlength=len(cuts))
        sum_term.append(((key >> 8) % len(terms)).astype(narrow))
        sum_top.append((key & 255).astype(np.uint8))
        at = until
    return {
        "term": terms, "rows": rows.astype(np.int32), "doc_term": number.astype(narrow), "impact": impact.astype(np.int32), "lists": lists.astype(np.int32), "blocks": blocks.astype(np.int32),
        "members": doc[members].astype(np.int32), "heads": np.append(0, np.cumsum(count)).astype(np.int32), "sum_term": np.concatenate(sum_term), "sum_top": np.concatenate(sum_top),
    }


def index(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame, documents: int, total: int, layout: Layout = Layout()) -> DataFrame:
    """(shard, ids, blob): the blocked lists of ``terms`` (term), written once for any number of searches for them.

    ``documents`` and ``total`` are the corpus' documents with terms and all their terms.
    """
    cells = docs.sparkSession.sparkContext.broadcast(Cells.of(terms, "term"))
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def batches(it):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        ids, postings, held = [], [], 0

        def made():
            doc, term, impact = (np.concatenate(x) for x in zip(*postings))
            blob = _packed(**blocked(doc, term, impact, held, layout.block))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard]), pa.ListArray.from_arrays(pa.array([0, held], pa.int32()), pa.concat_arrays(ids)), pa.array([blob], pa.binary())], names=["shard", "ids", "blob"]
            )

        for b in it:
            for w in words(text_bytes(b.column("text"))):
                of, term, tf = _counted(w, cells.value)
                m = 25 + 75 * w.counts() * documents // max(1, total)
                ids.append(b.column("doc_id").slice(w.first, len(w)))
                postings.append((of + held, term, 1_000_000_000 * tf // (1000 * tf + 8 * m[of])))
                held += len(w)
                if held >= layout.shard:
                    yield made()
                    ids, postings, held = [], [], 0
                    shard += 1
        if held:
            yield made()

    return saved(chosen.mapInArrow(batches, f"shard long, ids array<{kind}>, blob binary"), arrow_rows=_ROWS, group_bytes=1 << 24)


class Shard:
    """A shard's index, opened for searches. ``seen`` and ``scored`` count blocks that a query's lists hold and that it scored."""

    def __init__(self, index: dict, order: np.ndarray):
        self.__dict__.update(index)
        self.order = order  # the place of each document among the ids, ascending
        self.sorter = np.argsort(self.term)
        self.own_top = self.sum_top[self.heads[:-1]].astype(np.int64)
        self.list_top = np.maximum.reduceat(self.own_top, self.lists[:-1]) if len(self.term) else np.empty(0, np.int64)
        self.list_of = np.repeat(np.arange(len(self.term)), np.diff(self.lists))
        self.weight = np.zeros(len(self.term), np.int64)
        self.met = np.zeros(len(order), bool)
        self.seen = self.scored = 0

    def numbers(self, term: np.ndarray) -> np.ndarray:
        """The places of terms in this shard, or -1."""
        if not len(self.term):
            return np.full(len(term), -1)
        at = self.sorter[np.minimum(np.searchsorted(self.term, term, sorter=self.sorter), len(self.term) - 1)]
        return np.where(self.term[at] == term, at, -1)

    def best(self, number: np.ndarray, weight: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best with a score of ``least`` or more, for the weights of the numbered terms."""
        ok = number >= 0
        order = np.argsort(number[ok])
        number, weight = number[ok][order], weight[ok][order]
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        rest = np.append(np.cumsum((weight * self.list_top[number])[::-1])[::-1], 0) * STEP
        self.seen += int((self.lists[number + 1] - self.lists[number]).sum())
        live = rest[:-1] >= least
        if not live.any():
            return docs, scores
        block = _ranges(self.lists[number[live]].astype(np.int64), (self.lists[number[live] + 1] - self.lists[number[live]]).astype(np.int64))
        self.weight[number] = weight
        # first by the list's own coordinate, and the others' maxima over their lists
        place = np.searchsorted(number, self.list_of[block])
        block = block[self.own_top[block] * weight[place] * STEP + rest[place + 1] >= least]
        if len(block):
            size = (self.heads[block + 1] - self.heads[block]).astype(np.int64)
            at = _ranges(self.heads[block].astype(np.int64), size)
            bound = np.add.reduceat(self.weight[self.sum_term[at]] * self.sum_top[at], np.cumsum(size) - size) * STEP
            order = np.argsort(-bound, kind="stable")
            block, bound = block[order], bound[order]
        at, step, used = 0, 4, []
        while at < len(block) and bound[at] >= least:
            mine = block[at : at + step][bound[at : at + step] >= least]
            self.scored += len(mine)
            new = np.unique(self.members[_ranges(self.blocks[mine].astype(np.int64), (self.blocks[mine + 1] - self.blocks[mine]).astype(np.int64))])
            new = new[~self.met[new]].astype(np.int64)
            self.met[new] = True
            used.append(new)
            if len(new):
                size = (self.rows[new + 1] - self.rows[new]).astype(np.int64)
                take = _ranges(self.rows[new].astype(np.int64), size)
                score = np.add.reduceat(self.weight[self.doc_term[take]] * self.impact[take], np.cumsum(size) - size)
                good = score >= least
                docs, scores = np.append(docs, new[good]), np.append(scores, score[good])
                if len(docs) >= k:
                    top = np.lexsort((self.order[docs], -scores))[:k]
                    docs, scores = docs[top], scores[top]
                    least = max(least, int(scores[-1]))
            at += step
            step *= 2
        self.weight[number] = 0
        for x in used:
            self.met[x] = False
        return docs, scores


def query_blocks(asked: DataFrame, least: DataFrame | None, n: int) -> DataFrame:
    """(block, queries, item_ids, blob): ``n`` blocks of queries with their terms' weights and the least score worth finding."""
    kind = asked.schema["item_id"].dataType.simpleString()
    least_of = F.coalesce("least", F.lit(1)) if least is not None else F.lit(1)
    rows = asked.join(least, "query", "left") if least is not None else asked
    rows = rows.select("query", "item_id", "term", "weight", least_of.cast("long").alias("least"), F.pmod(F.xxhash64("query"), F.lit(n)).cast("int").alias("block"))

    def block_of(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        query, first, of = np.unique(t.column("query").to_numpy(), return_index=True, return_inverse=True)
        blob = _packed(of=of, term=t.column("term").to_numpy().view(np.uint64), weight=t.column("weight").to_numpy(), least=t.column("least").to_numpy()[first])
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(query)], pa.int32()), x)
        ids = t.column("item_id").combine_chunks().take(pa.array(first))
        return pa.table({"block": t.column("block").slice(0, 1), "queries": one(pa.array(query)), "item_ids": one(ids), "asked": pa.array([blob], pa.binary())})

    return saved(rows.groupBy("block").applyInArrow(block_of, f"block int, queries array<long>, item_ids array<{kind}>, asked binary"))


def searched(shards: DataFrame, blocks: DataFrame, n: int, k: int) -> DataFrame:
    """(query, item_id, doc_id, score): up to k documents of each shard for each query, all that reach its least score among them."""
    salts = 16
    salted = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    each = shards.withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(salts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    met = each.join(salted, ["block", "salt"]).select("ids", "blob", "queries", "item_ids", "asked")
    doc_kind, item_kind = (met.schema[c].dataType.elementType.simpleString() for c in ("ids", "item_ids"))

    def batches(it):
        for b in it:
            for ids, blob, queries, item_ids, asked in zip(*(b.column(c) for c in ("ids", "blob", "queries", "item_ids", "asked"))):
                ids, a = ids.values, _unpacked(asked.as_py())
                order = np.empty(len(ids), np.int64)
                order[np.array(pc.sort_indices(ids, null_placement="at_start"))] = np.arange(len(ids))
                shard = Shard(_unpacked(blob.as_py()), order)
                by_query = np.argsort(a["of"], kind="stable")
                number, weight = shard.numbers(a["term"])[by_query], a["weight"][by_query]
                cut = np.searchsorted(a["of"][by_query], np.arange(len(queries.values) + 1))
                found = [shard.best(number[s:e], weight[s:e], int(x), k) for s, e, x in zip(cut[:-1], cut[1:], a["least"])]
                of = pa.array(np.repeat(np.arange(len(found)), [len(d) for d, _ in found]), pa.int64())
                docs, scores = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [queries.values.take(of), item_ids.values.take(of), ids.take(pa.array(docs)), pa.array(scores)], names=["query", "item_id", "doc_id", "score"]
                )

    return met.mapInArrow(batches, f"query long, item_id {item_kind}, doc_id {doc_kind}, score long")


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with rank; Spark cuts to k before the shuffle."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(items: DataFrame, docs: DataFrame, k: int = 10, item_id="item_id", item_text="text", id_col="doc_id", text_col="text", layout: Layout = Layout()) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each row of ``items``."""
    asked = saved(asked_terms(items, item_id, item_text))
    terms = saved(asked.select("term").distinct())
    cells = docs.sparkSession.sparkContext.broadcast(Cells.of(terms, "term"))
    sums = saved(statistics(docs, text_col, cells), arrow_rows=_ROWS)
    counts = {r["kind"]: r["n"] for r in sums.where("kind > 0").collect()}  # two rows
    documents, total = counts.get(1, 0), counts.get(2, 0)
    weight = F.floor(1000 * F.log((2.0 * documents + 2) / (2.0 * F.col("n") + 1)))
    weights = sums.where("kind = 0").select("term", weight.alias("w")).where("w > 0")
    weighed = saved(asked.join(weights, "term").select("query", "item_id", "term", (F.col("w") * F.col("times")).alias("weight")))
    shards = index(docs, id_col, text_col, terms, documents, total, layout)
    n = max(1, -(-asked.select("query").distinct().count() // layout.queries))
    # the shards of the first search: those of least hash, however many there are
    first = [r["shard"] for r in shards.select("shard").orderBy(F.xxhash64("shard")).limit(layout.pilot).collect()]
    pilot = top(searched(shards.where(F.col("shard").isin(first)), query_blocks(weighed, None, n), n, k), k)
    least = saved(pilot.where(F.col("rank") == k).select("query", F.col("score").alias("least")), arrow_rows=1)
    found = saved(searched(shards, query_blocks(weighed, least, n), n, k), arrow_rows=1)
    return top(found, k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_lexical_search(spark, sf_dir):
    """The ten best of all documents for each item of benchmark."""
    return search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_TERMS}, []) AS ws FROM documents),
s AS (SELECT count_if(len(ws) > 0)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(ws)::BIGINT AS n, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
c AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


QUERIES = {"op12_lexical_search": op12_lexical_search}
ORACLES = {"op12_lexical_search": SQL}
