"""BM25 by blocks against every document's score, and what its bounds spare."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarn.config import Settings
from tarn.operators import lexical as L

S = Settings(pool=5)


def brute(queries, docs, s=S):
    bags = [Counter(L.TOKEN.findall(t or "")) for _, t in docs]
    n = len(docs)
    avgdl = sum(b.total() for b in bags) / n
    df = Counter(w for b in bags for w in b)
    raw = {w: round(math.log(n - c + 0.5) - math.log(c + 0.5), 9) for w, c in df.items()}
    mean = round(sum(raw.values()) / len(raw), 9)
    idf = {w: s.epsilon * mean if x < 0 else x for w, x in raw.items()}
    out = []
    for q, t in queries:
        asked = Counter(L.TOKEN.findall(t or ""))
        scores = []
        for (i, _), b in zip(docs, bags):
            x = sum(c * idf[w] * b[w] * (s.k1 + 1) / (b[w] + s.k1 * (1 - s.b + s.b * b.total() / avgdl)) for w, c in asked.items() if w in b)
            scores.append((-round(x, 6), i))
        out += [(q, i, -x + 0.0, r + 1) for r, (x, i) in enumerate(sorted(scores)[: s.pool])]
    return sorted(out)


def rows(df):
    return sorted((r["query_id"], r["doc_id"], r["score"] + 0.0, r["rank"]) for r in df.collect())


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    some = lambda k: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=k))
    return [(i, some(rng.randint(0, 40))) for i in range(n)], [(100 + i, some(rng.randint(1, 6))) for i in range(12)]


@pytest.mark.parametrize("by_term", [False, True])
def test_equals_every_score(spark, by_term):
    docs, queries = corpus(300, 1)
    docs += [(300, None), (301, ""), (302, "w1 w1 w1"), (303, "w1 w1 w1")]
    queries += [(200, "nowhere"), (201, ""), (202, None), (203, "w1 w59 w1")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "item_id long, text string")
    got = L.bm25(q, d, S, indexed=L.index(d, rows=16, by_term=by_term), block=3)
    assert rows(got) == brute(queries, docs)


def test_weights_below_zero(spark):
    """Where most terms are in over half of the documents, scores fall below 0, and documents without terms come first."""
    docs = [(i, "a b c" if i < 9 else "d") for i in range(12)]
    queries = [(1, "a"), (2, "a d"), (3, "d")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    assert rows(L.bm25(q, d, S, indexed=L.index(d, rows=4))) == brute(queries, docs)


def test_few_documents_and_none(spark):
    docs, queries = [(1, "a b"), (2, "c")], [(1, "c a"), (2, "z")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    assert rows(L.bm25(q, d, S)) == brute(queries, docs)
    assert L.bm25(q, d.where("false"), S).count() == 0 and L.bm25(q.where("false"), d, S).count() == 0


def test_bounds_hold_and_spare_chunks(spark):
    """Chunks of one topic each: a query of a topic reads its own chunks and skips nearly all others."""
    rng = random.Random(4)
    docs = [(i, " ".join([f"t{i // 40}x{rng.randrange(9)}" for _ in range(12)] + [f"c{rng.randrange(5)}" for _ in range(8)])) for i in range(1200)]
    queries = [(q, f"t{q}x1 t{q}x2 t{q}x3 c1 c2") for q in range(20)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(queries, "item_id long, text string")
    indexed = L.index(d, rows=40)
    weights, stats = L.term_weights(indexed)
    asked = L.asked_terms(q, "item_id", "text").join(weights, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w")).cache()
    avgdl = stats.first()["avgdl"]
    bounds = L.chunk_bounds(asked, indexed, avgdl).cache()
    scores = L.scored(bounds, asked, indexed, avgdl, 40).cache()
    over = scores.join(bounds, ["query_id", "chunk"]).where("score > bound + 1e-6")
    assert scores.count() > 1000 and over.count() == 0
    first = L.top(bounds, ["query_id"], [F.desc("bound"), F.asc("chunk")], 1)
    least = L.top(scores.join(first.select("query_id", "chunk"), ["query_id", "chunk"]), ["query_id"], [F.desc("score")], 5).where("rank = 5").select("query_id", F.col("score").alias("least"))
    assert bounds.count() == 600 and L.survivors(bounds, first, least).count() < 60
    assert rows(L.bm25(q, d, S, indexed=indexed)) == brute(queries, docs)


def test_term_counts(spark):
    d = spark.createDataFrame([("a b a",), ("a",), (None,), ("",)], "text string")
    assert sorted(map(tuple, L.term_counts(d, "text").collect())) == [("a", 2, 3), ("b", 1, 1)]


def test_many_queries_by_blocks_equal_every_score(spark):
    """Chunks and blocks of a few rows; queries without known terms, equal scores, and weights below 0."""
    docs, queries = corpus(300, 2)
    docs += [(300, None), (301, ""), (302, "w1 w1 w1"), (303, "w1 w1 w1")]
    queries += [(200, "nowhere"), (201, ""), (202, None), (203, "w1 w59 w1")]
    below = [(i, "a b c" if i < 9 else "d") for i in range(12)], [(1, "a"), (2, "a d"), (3, "d")]
    for docs, queries in ((docs, queries), below, ([(1, "a b"), (2, "c")], [(1, "c a"), (2, "z")])):
        d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "item_id long, text string")
        assert rows(L.bm25_of_many(q, d, S.pool, S, rows=16, block=3)) == brute(queries, docs)
    assert L.bm25_of_many(q, d.where("false"), 5, S).count() == 0 and L.bm25_of_many(q.where("false"), d, 5, S).count() == 0


def test_many_queries_meet_chunks_without_a_shuffle(spark, monkeypatch):
    """What is written before the last ranking grows with queries and documents, not with their pairs."""
    written = []
    keep = L.stored
    monkeypatch.setattr(L, "stored", lambda df, **k: written.append(keep(df, **k)) or written[-1])
    # many documents are copies, so that scores are often equal
    docs = [(i, " ".join(f"w{(i * j) % 97}" for j in range(1, 12))) for i in range(400)]
    queries = [(i, f"w{i % 97} w{i % 89} w{i % 7}") for i in range(200)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(queries, "item_id long, text string")
    L.bm25_of_many(q, d, 3, S, rows=20, block=50).count()
    # 20 chunks: 4000 pairs of queries and chunks, 3 documents of each
    assert max(w.count() for w in written) < 200 * 20


def test_counts_of_terms_are_handed_on_before_they_are_many(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(L, "_TERMS", 10, raising=False)
    texts = [f"a{i} b{i} c{i} common" for i in range(100)] + [None, ""]
    got = list(L._counted(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])] * 2)))
    assert len(got) > 50 and max(b.num_rows for b in got) < 14
    sums = Counter()
    for b in got:
        for r in b.to_pylist():
            sums[r["term"]] += r["cf"]
    assert len(sums) == 301 and sums["common"] == 200 and sums["a7"] == 2


def test_texts_of_an_index_become_objects_a_few_at_once():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([f"{i} " + "word " * 4_000 for i in range(256)])
    tracemalloc.start()
    term, tf, sizes, dl = L._counts_of(texts, L.Hashes())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(term) == sizes.sum() == 512 and tf.sum() == dl.sum() == 256 * 4_001
    assert peak < 3_000_000  # the texts are 5 MB
