"""Benchmark decontamination: which words of documents stand in windows of benchmark items, by a prefix-filtered join.

1. An item is cut into windows of ``window`` consecutive words (one window, if it has fewer). A window is the set of its
   shingles of ``shingle`` words, each with its offset; equal windows of several items are one.
2. Shingles of windows are counted over all documents and ordered by rarity. Containment of a whole window asks for all
   of its shingles, so its necessary prefix is one: the rarest. Windows with a shingle that no document has are done.
3. Documents give a candidate for each place of a prefix shingle, with the words around it. Only those are joined with
   the windows of that prefix shingle.
4. The offset tells where the window would begin (positional bound) and end (length bound) in the document; where it fits,
   its words are compared with the document's, one for one.
5. Words of found windows are summed as intervals by document, items as distinct rows.

Shingles that no window has are turned away in the tasks by a bitmap of bounded size; what it lets through by chance, the
join turns away. Texts are read twice and never shuffled.

Edge cases: a null or empty text has no words; items without words have no windows; repeated documents each return a row,
repeated items count once by their id, and a null id is written as an empty string; ties in rarity go to the lesser hash;
empty tables give no hits or no rows; very long texts are read whole, in blocks. Only the named columns are read, so further
columns never clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table
from .words import Cells, shingles, text_bytes, words

WINDOW, SHINGLE = 10, 4


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item, text, size, hashes): each window of each item with the hashes of its shingles by offset."""
    chosen = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))

    def batches(it):
        for b in it:
            names = b.column("item").to_pylist()
            item, text, size, hashes = [], [], [], []
            for w in words(text_bytes(b.column("text"))):
                grams = {k: dict(zip(*(x.tolist() for x in _signed(*shingles(w, k))))) for k in range(1, shingle + 1)}
                for i, (a, e) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist())):
                    m = min(window, e - a)
                    k = min(shingle, m)
                    for at in range(a, e - m + 1) if m else ():
                        item.append(names[w.first + i])
                        text.append(w.between(at, at + m))
                        size.append(m)
                        hashes.append([grams[k][p] for p in range(at, at + m - k + 1)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.string()), pa.array(text, pa.string()), pa.array(size, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))], names=["item", "text", "size", "hashes"]
            )

    return chosen.mapInArrow(batches, "item string, text string, size int, hashes array<long>")


def _signed(at: np.ndarray, h: np.ndarray):
    return at, h.view(np.int64)


def shingle_counts(docs: DataFrame, text_col: str, cells, sizes: list[int]) -> DataFrame:
    """(h, n): places of shingles in all documents; counted in the tasks before the shuffle."""

    def batches(it):
        for b in it:
            for w in words(text_bytes(b.column("text"))):
                found = [h[cells.value.has(h)] for _, h in (shingles(w, k) for k in sizes)]
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(batches, "h long, n long")
    return counted.groupBy("h").agg(F.sum("n").alias("n"))


def candidates(docs: DataFrame, id_col: str, text_col: str, cells, sizes: list[int], window: int) -> DataFrame:
    """(row, doc_id, n_words, met): each document with the places of prefix shingles: h, at, and the words from up to
    ``window`` less one before (``lead``) to ``window`` from there on."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    met = pa.struct([("h", pa.int64()), ("at", pa.int64()), ("lead", pa.int32()), ("around", pa.string())])

    def batches(it):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for b in it:
            for w in words(text_bytes(b.column("text"))):
                n = len(w)
                found: list[list] = [[] for _ in range(n)]
                of = w.text_of()
                for k in sizes:
                    at, h = shingles(w, k)
                    ok = cells.value.has(h)
                    at, h = at[ok], h[ok].view(np.int64)
                    for p, x, i in zip(at.tolist(), h.tolist(), of[at].tolist()):
                        low, high = int(w.bounds[i]), int(w.bounds[i + 1])
                        a = max(low, p - window + k)
                        found[i].append({"h": x, "at": p - low, "lead": p - a, "around": w.between(a, min(high, p + window))})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), b.column("doc_id").slice(w.first, n), pa.array(w.counts()), pa.array(found, pa.list_(met))], names=["row", "doc_id", "n_words", "met"]
                )
                row += n

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(batches, f"row long, doc_id {kind}, n_words long, met array<struct<h: long, at: long, lead: int, around: string>>")


def overlaps(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: documents (row, doc_id, n_words); places (row, start, size, win) of windows; items of windows (win, item)."""
    spark = docs.sparkSession
    if not 1 <= shingle <= window:
        raise ValueError("a shingle has at least one word and at most those of a window")
    named = saved(item_windows(items, item_id, item_text, window, shingle))
    distinct = saved(named.groupBy("text").agg(F.first("size").alias("size"), F.first("hashes").alias("hashes")).withColumn("win", F.monotonically_increasing_id()))
    owners = saved(named.select("text", "item").distinct().join(distinct.select("text", "win"), "text").select("win", "item"))
    sizes = sorted(r["k"] for r in distinct.select(F.least("size", F.lit(shingle)).alias("k")).distinct().collect())  # at most ``shingle`` rows
    grams = saved(distinct.select("win", F.posexplode("hashes").alias("offset", "h")))
    cells = spark.sparkContext.broadcast(Cells.of(grams.select("h").distinct()))
    # no window, no shingle sizes: one that finds nothing
    counts = saved(shingle_counts(docs, text_col, cells, sizes or [1]))
    ranked = grams.join(counts, "h", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset")).alias("p"))
    prefixes = saved(ranked.where("p.n > 0").select("win", "p.h", "p.offset").join(distinct.select("win", "text", "size"), "win"))
    rare = spark.sparkContext.broadcast(Cells.of(prefixes.select("h").distinct()))
    every = saved(candidates(docs, id_col, text_col, rare, sizes or [1], window))
    seen = every.select("row", F.explode("met").alias("m")).select("row", "m.*")
    met = seen.join(prefixes, "h").where("lead >= offset")
    around = F.slice(F.split("around", " "), F.col("lead") - F.col("offset") + 1, F.col("size"))
    fits = (F.size(around) == F.col("size")) & (F.array_join(around, " ") == F.col("text"))
    return every.select("row", "doc_id", "n_words"), met.where(fits).select("row", (F.col("at") - F.col("offset")).alias("start"), "size", "win"), owners


def covered(spans):
    """Words in the union of spans (start, size), sorted by start."""
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["start"] + x["size"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0).cast("long"), x["start"] + x["size"] - F.greatest(acc["end"], x["start"]))).alias("n"),
    )
    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")), step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. Parameters as in ``overlaps``."""
    every, places, owners = overlaps(docs, items, **names)
    places = saved(places)
    spans = F.array_sort(F.collect_set(F.struct("start", F.col("size").cast("long").alias("size"))))
    hit = places.groupBy("row").agg(covered(spans).alias("n_hit"))
    found = places.select("row", "win").distinct().join(owners, "win").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("found"))
    found = found.select("row", F.size("found").cast("long").alias("n_items"), F.array_join("found", ",").alias("names"))
    zero = F.lit(0).cast("long")
    return every.join(hit, "row", "left").join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )


def op11_decontamination(spark, sf_dir):
    """Words of every whole text of documents within windows of ten words of benchmark."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT *, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT m FROM g),
p AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, z WHERE len(w) >= m)),
o AS (SELECT DISTINCT doc_id, m, i, item_id FROM p JOIN g USING (m, g)),
h AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM o) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(s.n, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
"""


QUERIES = {"op11_decontamination": op11_decontamination}
ORACLES = {"op11_decontamination": SQL}
