"""A stored collection of vectors: coarse cells in files, opened again for any number of exact searches.

Centroids are fitted by k-means on a bounded sample of the first rows. Every row lies in the cell of its nearest centroid,
packed with others of its cell, up to ``PACK`` a record, with their distances to the centroid. Cells are the keys of a
folder of versions: an upsert or a delete writes the cells it touches anew, and nobody sees half of it.

A search is exact. By the triangle inequality no member of a cell is nearer to a query than the query's distance to the
centroid less the cell's radius (nor than its least member distance less the query's). The first ``k`` members found, in the
cells nearest to the query, tell how near the k-th result is at most; then only cells whose bound is nearer are read, and in
them only members whose own distance to the centroid allows it. Cosine is searched as the distance of unit vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.ingest import upsert
from tarn.operators.lexical import top
from tarn.sources.files import stored
from tarn.sources.versions import Versions

#: Vectors in a packed record, and queries that meet it at once.
PACK, BLOCK = 1024, 256
#: Bytes of packed records that go to Python at once.
ARROW_BYTES = 8 << 20
#: Scores have six digits; what two of them can differ by is less than this.
SLACK = 2e-6


def matrix(v) -> np.ndarray:
    """An Arrow column of vectors as rows."""
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


def slices(batches, rows: int):
    """Arrow batches cut into such of at most ``rows``: what is made of them isn't held for a whole one."""
    return (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)[None, :], 0)


def fitted(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 42) -> np.ndarray:
    """Centroids of a sample by Lloyd's rounds, begun with rows that lie far from one another (k-means++); one that loses
    all its rows takes the row that lies worst."""
    rng = np.random.default_rng(seed)
    chosen, far = [int(rng.integers(len(sample)))], np.full(len(sample), np.inf)
    while len(chosen) < min(cells, len(sample)):
        far = np.minimum(far, squares(sample, sample[chosen[-1:]])[:, 0])
        far[chosen] = 0
        weight = np.cumsum(far if far.any() else np.isin(np.arange(len(sample)), chosen, invert=True))
        chosen.append(int(np.searchsorted(weight, rng.random() * weight[-1], side="right")))
    centroids = sample[chosen]
    for _ in range(rounds):
        d = squares(sample, centroids)
        of = d.argmin(1)
        counts = np.bincount(of, minlength=len(centroids))
        sums = np.stack([np.bincount(of, sample[:, i], len(centroids)) for i in range(sample.shape[1])], axis=1)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        empty = np.flatnonzero(counts == 0)
        centroids[empty] = sample[np.argsort(-d.min(1), kind="stable")[: len(empty)]]
    return centroids


@dataclass
class Collection:
    """``metric`` is ``cosine`` or ``l2sq``. Rows without a vector, and for cosine vectors of length 0, are no members."""

    spark: SparkSession
    path: str
    id_type: str = "long"
    metric: str = "cosine"

    def __post_init__(self):
        record = f"ids array<{self.id_type}>, vectors binary, away binary, n int, least double, most double"
        self.cells = Versions(self.spark, f"{self.path}/cells", "cell", "int", record)

    # building

    @classmethod
    def create(cls, rows: DataFrame, path: str, id_col: str = "vec_id", vector: str = "embedding", metric: str = "cosine", cells: int = 64, sample: int = 20_000) -> "Collection":
        """A collection of ``rows`` as version 0. Centroids are fitted on at most ``sample`` of them; ids are unique in the
        result: of rows with one id any one counts, the same each time if they are equal."""
        made = cls(rows.sparkSession, path, rows.schema[id_col].dataType.simpleString(), metric)
        x = np.array([r[0] for r in rows.where(made._usable(vector)).select(vector).limit(sample).collect()], np.float64)
        if not len(x):
            raise ValueError("a collection needs at least one vector to fit its cells on")
        centroids = fitted(unit(x) if metric == "cosine" else x, cells)
        rows.sparkSession.createDataFrame([(i, c) for i, c in enumerate(centroids.tolist())], "cell int, centroid array<double>").write.mode("errorifexists").parquet(f"{path}/centroids")
        made.upsert(rows, 0, id_col, vector)
        return made

    def centroids(self) -> np.ndarray:
        return np.array([r["centroid"] for r in self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()])

    def _usable(self, vector: str):
        some = F.col(vector).isNotNull() & (F.size(vector) > 0)
        return some & F.exists(vector, lambda v: v != 0) if self.metric == "cosine" else some

    def _assigned(self, rows: DataFrame, id_col: str, vector: str) -> DataFrame:
        """(id, v, cell, away): each row with its cell and the distance to the centroid."""
        chosen = rows.where(self._usable(vector)).select(F.col(id_col).cast(self.id_type).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null")
        centroids, cosine = self.spark.sparkContext.broadcast(self.centroids()), self.metric == "cosine"

        def batches(it):
            for b in slices(it, PACK):
                x = matrix(b.column("v"))
                d = squares(unit(x) if cosine else x, centroids.value)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(np.sqrt(d[np.arange(len(d)), cell]))], names=["id", "v", "cell", "away"])

        return chosen.mapInArrow(batches, f"id {self.id_type}, v array<double>, cell int, away double")

    def _packed(self, members: DataFrame) -> DataFrame:
        """Members by cell, dealt by ranges of (cell, away), so that a large cell spreads over tasks and its records are shells."""

        def batches(it):
            held, cell = [], None  # (ids, vectors, distances) of one cell, less than a record of them

            def record():
                ids, v, away = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
                held.clear()
                ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                cols = [pa.array([cell], pa.int32()), ids, pa.array([v.tobytes()], pa.binary()), pa.array([away.tobytes()], pa.binary()), pa.array([len(v)], pa.int32()), pa.array([away.min()]), pa.array([away.max()])]
                return pa.RecordBatch.from_arrays(cols, names=["cell", "ids", "vectors", "away", "n", "least", "most"])

            for b in it:
                cells = b.column("cell").to_numpy()
                cut = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)] if len(cells) else []
                for a, e in zip(cut, cut[1:]):
                    if held and cells[a] != cell:
                        yield record()
                    cell = int(cells[a])
                    while a < e:
                        part = b.slice(a, min(e - a, PACK - sum(len(h[0]) for h in held)))
                        held.append((part.column("id"), matrix(part.column("v")), part.column("away").to_numpy()))
                        a += part.num_rows
                        if sum(len(h[0]) for h in held) == PACK:
                            yield record()
            if held:
                yield record()

        dealt = members.repartitionByRange("cell", "away").sortWithinPartitions("cell", "away")
        return dealt.mapInArrow(batches, f"cell int, ids array<{self.id_type}>, vectors binary, away binary, n int, least double, most double")

    def _members(self, records: DataFrame) -> DataFrame:
        """(id, v, cell, away) of packed records."""

        def batches(it):
            for b in it:
                for cell, ids, v, away in zip(*(b.column(c) for c in ("cell", "ids", "vectors", "away"))):
                    n = len(ids.values)
                    x = np.frombuffer(v.as_buffer())
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (len(x) // n), pa.int32()), pa.array(x))
                    yield pa.RecordBatch.from_arrays([ids.values, vectors, pa.array([cell.as_py()] * n, pa.int32()), pa.array(np.frombuffer(away.as_buffer()))], names=["id", "v", "cell", "away"])

        return records.select("cell", "ids", "vectors", "away").mapInArrow(batches, f"id {self.id_type}, v array<double>, cell int, away double")

    def upsert(self, rows: DataFrame, version: int, id_col: str = "vec_id", vector: str = "embedding", deleted: DataFrame | None = None) -> None:
        """Rows take the place of those with their ids, and ``deleted`` (id_col) go, as version ``version``; again, if it runs again.

        An id in both stays, with its new row. Cells without a new, replaced or deleted member stay as they are.
        """
        new = stored(upsert(self._assigned(rows, id_col, vector), ["id"], [F.asc("cell"), F.asc("away")]))
        before = self.cells.known(before=version).where("not deleted").select("cell", "version")
        old = self.cells.current(before=version)
        ids = new.select("id")
        if deleted is not None:
            ids = ids.unionByName(deleted.select(F.col(id_col).cast(self.id_type).alias("id")).where("id is not null")).distinct()
        # only ids are read to find the cells that hold them
        holding = old.select("cell", F.explode("ids").alias("id")).join(ids, "id", "left_semi").select("cell").distinct()
        touched = stored(holding.unionByName(new.select("cell")).distinct())
        stay = self._members(old.join(touched, "cell", "left_semi")).join(ids, "id", "left_anti")
        packed = stored(self._packed(stay.unionByName(new)), arrow_bytes=ARROW_BYTES)
        full = packed.select("cell").distinct()
        changed = full.withColumn("content_hash", F.lit(None).cast("string"))
        self.cells.write(version, changed, packed, before.join(touched, "cell", "left_semi").select("cell").join(full, "cell", "left_anti"))

    # searching

    def count(self) -> int:
        return self.cells.current().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def _bounds(self, queries: DataFrame, k: int, reach: bool) -> DataFrame:
        """(cell, query_id, v, near): cells to read for each query (query_id, v, near).

        ``near`` is the squared distance that a result may have. Without ``reach`` come the cells nearest to the query, until they
        hold k members; with it all cells that can hold a result but those.
        """
        shape = self.cells.current().groupBy("cell").agg(F.sum("n"), F.min("least"), F.max("most")).collect()  # a row a cell
        centroids = self.centroids()
        cells = np.array([r[0] for r in shape], np.int64)
        n, least, most = (np.array([r[i] for r in shape], np.float64) for i in (1, 2, 3))
        data, cosine = self.spark.sparkContext.broadcast((cells, n, least, most, centroids[cells] if len(cells) else centroids[:0])), self.metric == "cosine"
        kind = queries.schema["query_id"].dataType.simpleString()

        def batches(it):
            cells, n, least, most, c = data.value
            for b in slices(it, BLOCK):  # a query comes out once for each cell
                if not len(cells):
                    continue
                x = matrix(b.column("v"))
                away = np.sqrt(squares(unit(x) if cosine else x, c))
                order = np.argsort(away, axis=1, kind="stable")
                held = np.cumsum(n[order], axis=1) - n[order] < k  # a prefix of the order
                first = np.zeros_like(held)
                np.put_along_axis(first, order, held, axis=1)
                bound = np.maximum(np.maximum(away - most, least - away), 0)
                near = np.nan_to_num(b.column("near").to_numpy(zero_copy_only=False).astype(np.float64), nan=np.inf)
                able = bound <= np.sqrt(near + SLACK)[:, None] + 1e-9
                of, cell = np.nonzero(~first & able if reach else first & able)
                take = pa.array(of)
                yield pa.RecordBatch.from_arrays([pa.array(cells[cell], pa.int32()), *(b.column(x).take(take) for x in ("query_id", "v", "near"))], names=["cell", "query_id", "v", "near"])

        return queries.select("query_id", "v", "near").mapInArrow(batches, f"cell int, query_id {kind}, v array<double>, near double")

    def _scored(self, pairs: DataFrame, k: int, parts: int) -> DataFrame:
        """(query_id, id, score): the k best of each record for each query that its cell was chosen for."""
        kind = pairs.schema["query_id"].dataType.simpleString()
        cosine = self.metric == "cosine"
        centroids = self.spark.sparkContext.broadcast(self.centroids())

        def block_of(t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            near = np.nan_to_num(t.column("near").to_numpy().astype(np.float64), nan=np.inf)
            v = matrix(t.column("v").combine_chunks())
            return pa.table({"cell": t.column("cell").slice(0, 1), "queries": one(t.column("query_id").combine_chunks()), "asked": pa.array([v.tobytes()], pa.binary()), "near": pa.array([near.tobytes()], pa.binary())})

        part = F.pmod(F.xxhash64("query_id"), F.lit(parts))
        blocks = stored(pairs.withColumn("part", part).groupBy("cell", "part").applyInArrow(block_of, f"cell int, queries array<{kind}>, asked binary, near binary"))

        def batches(it):
            for b in it:
                for cell, ids, v, away, queries, asked, near in zip(*(b.column(c) for c in ("cell", "ids", "vectors", "away", "queries", "asked", "near"))):
                    ids, of = ids.values, queries.values
                    x, y = (np.frombuffer(a.as_buffer()).reshape(len(i), -1) for a, i in ((v, ids), (asked, of)))
                    x, y = (unit(x), unit(y)) if cosine else (x, y)
                    gap = np.abs(np.sqrt(squares(y, centroids.value[cell.as_py()][None, :])) - np.frombuffer(away.as_buffer())[None, :])
                    can = gap <= np.sqrt(np.frombuffer(near.as_buffer()) + SLACK)[:, None] + 1e-9
                    some = can.any(0)
                    if not some.any():
                        continue
                    x, ids, can = x[some], ids.filter(pa.array(some)), can[:, some]
                    score = np.round(y @ x.T if cosine else 1 - ((y**2).sum(1)[:, None] - 2 * y @ x.T + (x**2).sum(1)[None, :]), 6)
                    order = np.array(pc.sort_indices(ids))
                    best = order[np.argsort(np.where(can, -score, np.inf)[:, order], axis=1, kind="stable")[:, :k]]
                    q, at = np.repeat(np.arange(len(of)), best.shape[1]), best.ravel()
                    ok = can[q, at]
                    q, at = q[ok], at[ok]
                    yield pa.RecordBatch.from_arrays([of.take(pa.array(q)), ids.take(pa.array(at)), pa.array(score[q, at] + 0.0)], names=["query_id", "id", "score"])

        met = self.cells.current().join(blocks, "cell").select("cell", "ids", "vectors", "away", "queries", "asked", "near")
        return met.mapInArrow(batches, f"query_id {kind}, id {self.id_type}, score double")

    def pairs(self, queries: DataFrame, k: int, least: float | None = None, query_id: str = "query_id", vector: str = "embedding"):
        """The (cell, query_id) pairs that a search reads, in two tables, and the rows of the first."""
        to_square = (lambda c: 2 - 2 * c) if self.metric == "cosine" else (lambda c: 1 - c)
        near = F.lit(None).cast("double") if least is None else F.lit(float(to_square(least)))
        asked = stored(queries.where(self._usable(vector)).select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("v"), near.alias("near")))
        parts = max(1, -(-asked.count() // BLOCK))
        first = self._bounds(asked, k, False)
        begun = stored(top(self._scored(first, k, parts), ["query_id"], [F.desc("score"), F.asc("id")], k), arrow_bytes=ARROW_BYTES)
        last = begun.where(F.col("rank") == k).select("query_id", to_square(F.col("score")).alias("__near"))
        closer = asked.join(last, "query_id", "left").select("query_id", "v", F.least("near", "__near").alias("near"))
        return first, self._bounds(stored(closer), k, True), begun.drop("rank"), parts

    def search(self, queries: DataFrame, k: int, least: float | None = None, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
        """(query_id, id, score, rank): the k nearest members of each query; ids of queries are unique."""
        _, rest, begun, parts = self.pairs(queries, k, least, query_id, vector)
        found = begun.unionByName(self._scored(rest, k, parts))
        if least is not None:
            found = found.where(F.col("score") >= least)
        return stored(top(found, ["query_id"], [F.desc("score"), F.asc("id")], k), arrow_bytes=ARROW_BYTES)
