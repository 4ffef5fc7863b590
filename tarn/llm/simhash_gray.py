"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are made document by document; equal ones are folded into one with a count, so a group of copies of any
size is one row. Two 64-bit fingerprints with at most ``d`` differing bits agree on at least 4 - d of 4 blocks of 16
bits, so each fingerprint goes to a group for every such choice of blocks. Within a group the fingerprints are sorted
by Gray rank, which puts similar ones side by side; runs of neighbours become nodes that hold the bits all of them
share (a mask and a pattern), and nodes of neighbouring runs become upper nodes. A search adds up differences from the
top: the bits that differ from a node's pattern can only grow below it, so a whole node is pruned once they exceed d.

Groups that grow beyond ``group_rows`` fingerprints are dealt again by further blocks of their remaining bits (the same
argument holds there), so no group has to fit one task. A group returns a forest of its links, never all its pairs;
components are joined by alternating star contractions on tables, with the lineage cut at every round.

The pipeline's stage (``near_copies``) begins with the links of fingerprints by this index, and checks them on whole sets of
shingles. It asks for all similar sets, which no number of fingerprints finds for sure: so texts that share one of their
rarest shingles (prefix filter), which every pair of the similarity does, follow as further candidates.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, plain_names, saved, table

SEED = 42
_BIT = np.arange(64, dtype=np.uint64)
_ONE = np.uint64(1)


def shingles(text: str | None, width: int) -> list[bytes]:
    """Lower-cased (A-Z only) shingles of ``width`` words, repeats included; fewer words make one shingle, none none."""
    words = WORD_BYTES.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return []
    if len(words) <= width:
        return [b" ".join(words)]
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def hashes(grams: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(g, SEED) for g in grams), np.uint64, len(grams))


def fingerprint(h: np.ndarray) -> int:
    """Bit i is 1 if it is set in more than half of the hashes; no hashes give zero."""
    n = len(h)
    if not n:
        return 0
    set_in = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        part = np.ascontiguousarray(h[i : i + 8192], "<u8").view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((_ONE << _BIT[2 * set_in > n]).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of each document's whole text; a null text has no words."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def batches(it):
        for b in it:
            fp = np.array([fingerprint(hashes(shingles(t, width))) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return chosen.mapInArrow(batches, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each word in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Hierarchy of masked bit patterns over distinct fingerprints sorted by Gray rank."""

    def __init__(self, fps: np.ndarray, fan: int = 8):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        self.fan = fan
        # each level: bits that all below share (mask) and their values (pattern); level 0 holds the fingerprints
        self.levels = [(np.full(len(self.fps), ~np.uint64(0)), self.fps)]
        while len(self.levels[-1][0]) > fan:
            mask, pattern = self.levels[-1]
            at = np.arange(0, len(mask), fan)
            ones = np.bitwise_and.reduceat(pattern & mask, at)
            zeros = np.bitwise_and.reduceat(~pattern & mask, at)
            self.levels.append((ones | zeros, ones))

    def links(self, d: int, block: int = 512):
        """Yields (i, j) arrays of positions i < j in Gray order with at most ``d`` differing bits, a block at a time."""
        n = len(self.fps)
        for lo in range(0, n, block):
            q = np.arange(lo, min(n, lo + block))
            nodes = len(self.levels[-1][0])
            query, node = np.repeat(q, nodes), np.tile(np.arange(nodes), len(q))
            for level in range(len(self.levels) - 1, -1, -1):
                mask, pattern = self.levels[level]
                if level < len(self.levels) - 1:
                    query = np.repeat(query, self.fan)
                    node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                    inside = node < len(mask)
                    query, node = query[inside], node[inside]
                # a node whose last row stands before the query adds no pair i < j
                span = self.fan**level
                near = (node + 1) * span - 1 > query
                query, node = query[near], node[near]
                differ = np.bitwise_count((self.fps[query] ^ pattern[node]) & mask[node])
                near = differ <= d
                query, node = query[near], node[near]
            yield query, node


def _forest(n: int, pairs) -> np.ndarray:
    """Smallest member of each one's component, by hooking and pointer jumping over blocks of links."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = root[i], root[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            if not len(i):
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _masks(bits: int, d: int) -> list[int]:
    """Masks (as signed longs) of every choice of blocks of ``bits`` bits that two words within ``d`` bits may agree on."""
    blocks = 64 // bits
    out = []
    for chosen in combinations(range(blocks), blocks - d):
        m = reduce(lambda x, c: x | (((1 << bits) - 1) << (c * bits)), chosen, 0)
        out.append(m - (1 << 64) if m >= 1 << 63 else m)
    return out


def _spread(rows: DataFrame, d: int, group_rows: int) -> DataFrame:
    """Adds h, a key: each row goes to every group where a partner whose fp is within ``d`` <= 3 bits must meet it.

    ``rows`` has fp and may have set (fingerprints of different sets don't meet). A group beyond ``group_rows`` is dealt
    again by blocks of half the bits; then a group shares 64 - 8 d bits.
    """
    name = [F.col("set")] if "set" in rows.columns else []

    def keyed(frame: DataFrame, bits: int) -> DataFrame:
        keys = [F.xxhash64(F.lit(bits), F.lit(i), *name, F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(_masks(bits, d))]
        return frame.withColumn("h", F.explode(F.array(*keys)))

    first = keyed(rows, 16)
    large = saved(first.groupBy("h").count().where(F.col("count") > group_rows).select("h"))
    if large.isEmpty():
        return first
    again = keyed(first.join(large, "h", "left_semi").drop("h").distinct(), 8)
    return first.join(large, "h", "left_anti").unionByName(again)


def _groups(it, columns):
    """From Arrow batches sorted by h: arrays of the columns of each run of complete groups, with the groups' bounds."""
    rest = None
    for b in it:
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("h", *columns)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        h = cols[0]
        if not len(h):
            continue
        at = 0 if h[0] == h[-1] else len(h) - int(np.argmax(h[::-1] != h[-1]))
        if at:
            yield _bounded([c[:at] for c in cols])
        rest = [c[at:] for c in cols]
    if rest is not None and len(rest[0]):
        yield _bounded(rest)


def _bounded(cols):
    h = cols[0]
    cut = np.flatnonzero(h[1:] != h[:-1]) + 1
    starts, ends = np.append(0, cut), np.append(cut, len(h))
    many = ends - starts > 1
    return cols[1:], list(zip(starts[many], ends[many]))


def links(fp: DataFrame, d: int = 2, group_rows: int = 20_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all pairs within ``d`` bits (d <= 3)."""
    groups = _spread(fp, d, group_rows)

    def batches(it):
        for (fps,), bounds in _groups(it, ("fp",)):
            out = []
            for s, e in bounds:
                index = GrayIndex(np.unique(fps[s:e].view(np.uint64)))
                root = _forest(len(index.fps), index.links(d))
                i = np.flatnonzero(root != np.arange(len(root)))
                if len(i):
                    out.append((index.fps[root[i]], index.fps[i]))
            if out:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = groups.select("h", "fp").repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(batches, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches, itself included.

    Large-star and small-star turns: each node's larger neighbours, then its smaller ones, are hung under the smallest.
    Neighbours are never gathered: a minimum by node, summed before the shuffle, and a join. Edges only shrink.
    """
    e = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        nxt = saved(small)
        # stable when every node hangs under one node, and no node that others hang under hangs itself
        if nxt.groupBy("u").count().where("count > 1").isEmpty() and nxt.join(nxt.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty():
            return nxt.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                nxt.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        e = nxt


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, d: int = 2) -> DataFrame:
    """A row for each document: doc_id, fp (long) and component_id, the smallest id that links within ``d`` bits reach.

    Equal fingerprints link at distance 0. Null ids take part but never name a component unless it has no other.
    Repeated rows each return a row; texts without words have fingerprint zero and link like any other.
    """
    fp = saved(fingerprints(docs, id_col, text_col, width))
    ids = fp.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(links(ids.select("fp"), d))
    named = ids.join(roots, ids["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    by_root = saved(named.groupBy("root").agg(F.min("least_id").alias("component_id")))
    names = named.join(by_root, "root").select("fp", "component_id")
    return fp.join(names, "fp", "left").select("doc_id", "fp", "component_id")


#: Cells of the table that orders shingles by how common they are. Any order finds all pairs, if every text keeps to it.
CELLS = 1 << 20


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Hashes of a text's distinct shingles, sorted."""
    return np.unique(hashes(shingles(text, width)))


def _cells(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(CELLS - 1)).astype(np.int64)


def _common(texts: DataFrame, width: int) -> np.ndarray:
    """How many rows have a shingle in each cell; of a size that doesn't grow with the texts."""

    def batches(it):
        n = np.zeros(CELLS, np.int64)
        for b in it:
            for t in b.column("text").to_pylist():
                np.add.at(n, _cells(shingle_set(t, width)), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["cell", "n"])

    found = texts.select("text").mapInArrow(batches, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


def prefix(h: np.ndarray, common: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The rarest shingles of a text and their places in the order of all its shingles, less those that no other row has.

    Two texts of this similarity share at least one: outside their prefixes there are too few shingles to share.
    """
    n = common[_cells(h)]
    # h is sorted: a stable sort makes (n, h) the order of all texts
    at = np.argsort(n, kind="stable")[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]
    place = np.flatnonzero(n[at] > 1)
    return h[at[place]], place


#: Bits of a text's parity map, in words of 64.
PARITY_WORDS = 8


def parity(h: np.ndarray) -> np.ndarray:
    """Parity map of a set of shingles: bit i is 1 if an odd number of them falls to it.

    A shingle that only one of two texts has changes one bit, so two maps differ in at most as many bits as the sets differ
    in shingles: a bound that never turns away a pair of the similarity.
    """
    bits = np.bincount((h >> np.uint64(20) & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _prefixes(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(s, node, size, place) for each shingle s of each text's prefix, and (node, bits) once: its parity map, s being null.

    Texts without words meet at s = 0.
    """
    common = texts.sparkSession.sparkContext.broadcast(_common(texts, width))

    def batches(it):
        seen = set()  # copies in one task give their rows once
        for b in it:
            s, node, size, place, maps = [], [], [], [], []
            for n, t in zip(b.column("node").to_pylist(), b.column("text").to_pylist()):
                if n in seen:
                    continue
                seen.add(n)
                h = shingle_set(t, width)
                of, at = prefix(h, common.value, similarity) if len(h) else (np.zeros(1, np.uint64), np.zeros(1, np.int64))
                s.append(of.view(np.int64))
                place.append(at)
                node.append(np.full(len(of), n))
                size.append(np.full(len(of), len(h)))
                maps.append((n, parity(h)))
            if s:
                cols = [pa.array(np.concatenate(x)).cast(of) for x, of in ((s, pa.int64()), (node, pa.int64()), (size, pa.int32()), (place, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(cols[0]), pa.list_(pa.int64()))], names=names)
                none = [pa.nulls(len(maps), pa.int32())] * 2
                yield pa.RecordBatch.from_arrays([pa.nulls(len(maps), pa.int64()), pa.array([n for n, _ in maps]), *none, pa.array([x for _, x in maps], pa.list_(pa.int64()))], names=names)

    names = ["s", "node", "size", "place", "bits"]
    return texts.select("node", "text").mapInArrow(batches, "s long, node long, size int, place int, bits array<long>")


def _may(similarity: float, x: str, y: str):
    """Whether enough shingles are left from the first one that two texts share; it holds their sizes against each other too."""
    left = F.least(F.col(f"{x}size") - F.col(f"{x}place"), F.col(f"{y}size") - F.col(f"{y}place"))
    return left * (1 + similarity) >= similarity * (F.col(f"{x}size") + F.col(f"{y}size")) - 1e-6


def _alike(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole sets of shingles have this similarity."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    met = texts.join(saved(nodes), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))

    def batches(it):
        for b in it:
            sets = [shingle_set(t, width).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "grams"])

    sets = saved(met.mapInArrow(batches, "node long, grams array<long>"))
    with_x = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
    with_y = with_x.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    either = F.size("x") + F.size("y") - both
    return with_y.where((either == 0) | (both / either >= similarity)).select("a", "b")


def fingerprint_links(texts: DataFrame, width: int = 3, d: int = 2) -> DataFrame:
    """Links (a, b) between nodes of ``texts`` (node, text) whose fingerprints are equal, or within ``d`` bits by the Gray-order
    index; a < b."""
    fp = saved(fingerprints(texts, "node", "text", width).distinct())
    ids = saved(fp.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    equal = fp.join(ids, "fp").where("doc_id <> least_id").select(F.col("least_id").alias("a"), F.col("doc_id").alias("b"))
    found = links(ids.select("fp"), d)
    of = lambda c: ids.select(F.col("fp").alias(c), F.col("least_id").alias(f"{c}_id"))
    near = found.join(of("a"), "a").join(of("b"), "b").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
    return saved(equal.unionByName(near))


def near_links(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of this similarity; ``texts`` has node and text.

    Links of fingerprints come first, settled on the whole sets like all others. Texts that share a shingle of their prefixes are a group. First each group's least node is checked against the others.
    What these links don't join is then checked pair by pair: every pair of a group that lies in two components and whose
    sizes, places and parity maps allow the similarity.
    """
    both = saved(_prefixes(texts, width, similarity))
    rows = both.where("s is not null").select("s", "node", "size", "place")
    first = rows.groupBy("s").agg(F.min(F.struct("node", "size", "place")).alias("p"), F.max("node").alias("last")).where("p.node < last")
    first = saved(first.select("s", F.col("p.node").alias("pivot"), F.col("p.size").alias("p_size"), F.col("p.place").alias("p_place")))
    met = saved(rows.join(first, "s").where("node <> pivot").distinct())
    pair = [F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")]
    pivots = met.where(_may(similarity, "", "p_")).withColumn("other", F.col("pivot")).select(*pair)
    checked = saved(pivots.unionByName(fingerprint_links(texts)).distinct())
    found = saved(_alike(checked, texts, width, similarity))
    maps = both.where("s is null").dropDuplicates(["node"]).select("node", *[F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(PARITY_WORDS)])
    # a few of the pairs join most of what belongs together, so that the last turn, which leaves none out, has few to check
    for part in (64, 1):
        roots = saved(components(found))
        rest = (
            met.select("s", "node", "size", "place", "pivot")
            .join(roots, "node", "left")
            .join(roots.select(F.col("node").alias("pivot"), F.col("root").alias("p_root")), "pivot", "left")
            .select("s", "node", "size", "place", F.coalesce("root", "node").alias("root"), F.coalesce("p_root", "pivot").alias("p_root"))
        )
        rest = saved(rest)
        # groups with someone outside the first one's component, and someone else to check
        more = saved(rest.groupBy("s").agg(F.min("node").alias("u"), F.max("node").alias("v"), F.max(F.col("root") != F.col("p_root")).alias("out")).where("u < v AND out").select("s"))
        open_ = rest.join(more, "s", "left_semi")
        rest = saved(open_.join(saved(maps.join(saved(open_.select("node").distinct()), "node", "left_semi")), "node"))
        kept = ["node", "size", "place", "root", *[f"b{i}" for i in range(PARITY_WORDS)]]
        out = rest.where("root <> p_root").select("s", *[F.col(c).alias(f"o_{c}") for c in kept])
        across = (F.col("root") != F.col("o_root")) & ((F.col("root") == F.col("p_root")) | (F.col("node") < F.col("o_node")))
        among = F.pmod(F.xxhash64(F.least("node", "o_node"), F.greatest("node", "o_node")), F.lit(part)) == 0
        apart = sum(F.bit_count(F.col(f"b{i}").bitwiseXOR(F.col(f"o_b{i}"))) for i in range(PARITY_WORDS))
        near = apart * (1 + similarity) <= (1 - similarity) * (F.col("size") + F.col("o_size")) + 1e-6
        late = out.join(rest, (out["s"] == rest["s"]) & across & among & _may(similarity, "", "o_") & near).withColumn("other", F.col("o_node")).select(*pair).distinct()
        late = saved(late.join(checked, ["a", "b"], "left_anti"))
        found = saved(found.unionByName(_alike(late, texts, width, similarity)))
        checked = checked.unionByName(late)
    return found


def _hashes(text_col: str) -> list:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("__h1"), F.xxhash64(F.lit(1), text).alias("__h2")]


def clashes(docs: DataFrame, text_col: str) -> DataFrame:
    """(__h1, __h2, __other): texts that share the first 64 bits of their hash with another, by the further 64 bits, each with
    a node of its own. One in some thousand millions of texts, so a table of next to no rows."""
    same = docs.select(*_hashes(text_col)).distinct().groupBy("__h1").agg(F.sort_array(F.collect_list("__h2")).alias("all")).where(F.size("all") > 1)
    each = same.select("__h1", F.posexplode("all").alias("__at", "__h2")).where("__at > 0")
    return saved(each.select("__h1", "__h2", F.xxhash64("__h1", "__h2", F.lit("other")).alias("__other")))


def with_nodes(docs: DataFrame, text_col: str, apart: DataFrame) -> DataFrame:
    """``docs`` with node, the hash of the text: equal for equal texts, and told apart by 128 bits."""
    met = docs.select("*", *_hashes(text_col)).join(apart, ["__h1", "__h2"], "left")
    return met.withColumn("node", F.coalesce("__other", "__h1")).drop("__h1", "__h2", "__other")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """A row for each document: node (hash of its text), doc_id, root (node of its group) and keeper, its least doc_id.

    Two texts belong together if their sets of shingles of ``width`` words have this Jaccard similarity, or are linked by
    such pairs. All pairs count, and each link is settled on the whole sets.
    """
    chosen = with_nodes(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", clashes(docs, text_col))
    every = saved(chosen.select("node", "doc_id"))
    roots = components(near_links(chosen.select("node", "text"), width, similarity))
    ids = every.groupBy("node").agg(F.min("doc_id").alias("least"))
    named = ids.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    # a table, so that Spark can split the rows of a large group in the join
    keepers = saved(named.groupBy("root").agg(F.min("least").alias("keeper")))
    return every.join(named.select("node", "root"), "node").join(keepers, "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies the one with the least id (one of repeated rows)."""
    columns, docs = docs.columns, plain_names(docs)
    found = saved(near_copies(docs, id_col, text_col))
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("keeper")))
    # rows that share id and text, or groups with null ids only: then one row of the group is picked
    twice = not stays.groupBy("root").count().where("count > 1").isEmpty()
    of_text = stays.select(F.col("node").alias("__node"), F.col("root").alias("__root"), F.col("doc_id").alias("__id")).distinct()
    kept = with_nodes(docs.select(F.struct(*docs.columns).alias("__row"), F.col(text_col).alias("__text"), F.col(id_col).alias("__of")), "__text", clashes(docs, text_col))
    kept = kept.select("__row", F.col("node").alias("__node"), "__of").join(of_text, "__node")
    kept = kept.where(F.col("__of").eqNullSafe(F.col("__id")))
    if twice:
        kept = kept.dropDuplicates(["__root"])
    return kept.select("__row.*").toDF(*columns)


def op7_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and component of every whole text of documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


QUERIES = {"op7_simhash_near_dedup": op7_simhash_near_dedup}
