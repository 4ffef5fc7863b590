"""A stored collection of vectors against exact search, through upserts and deletes."""

import numpy as np
import pyarrow as pa
import pytest
from tarn.operators import retrieval as R
from tarn.sources.collection import BLOCK, PACK, Collection, fitted, slices
from tarn.sources.files import stored


def clustered(n, seed=1, dim=8, groups=12, spread=0.05):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(groups, dim))
    return [(i, (at[i % groups] + spread * rng.normal(size=dim)).astype("float32").tolist()) for i in range(n)]


def frame(spark, rows, name="vec_id"):
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>")


def rows(df):
    return sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("metric", ["cosine", "l2sq"])
def test_search_is_exact_and_prunes(spark, tmp_path, metric):
    data = clustered(1500) + [(2000, [0.5] * 8), (2001, [0.5] * 8), (2002, None)]
    made = Collection.create(frame(spark, data), f"{tmp_path}/c", metric=metric, cells=24)
    queries = frame(spark, [(q, v) for q, v in clustered(1500)[::60]], "query_id")
    again = Collection(spark, f"{tmp_path}/c", "long", metric)  # opened anew
    assert again.count() == made.count() == 1502
    assert rows(again.search(queries, 7)) == rows(R.vector_top(queries, frame(spark, data), 7, metric))
    assert rows(again.search(queries, 7, least=0.9)) == rows(R.vector_top(queries, frame(spark, data), 7, metric, least=0.9))
    first, rest, _, _ = again.pairs(queries, 7)
    cells = again.cells.current().select("cell").distinct().count()
    assert first.count() + rest.count() < 0.4 * cells * queries.count()


def test_upserts_and_deletes(spark, tmp_path):
    data = dict(clustered(400))
    made = Collection.create(frame(spark, list(data.items())), f"{tmp_path}/c", cells=10)
    moved = {i: v for i, (_, v) in zip(range(0, 60, 3), clustered(60, seed=9))} | {900: data[5], 901: [1.0] * 8}
    gone = [1, 2, 5, 7777]
    for _ in range(2):  # the version is written again
        made.upsert(frame(spark, list(moved.items())), 1, deleted=spark.createDataFrame([(i,) for i in gone], "vec_id long"))
        now = {i: v for i, v in (data | moved).items() if i not in gone}
        assert made.count() == len(now)
        queries = frame(spark, [(q, v) for q, v in clustered(400)[::37]] + [(7, [1.0] * 8)][:0], "query_id")
        assert rows(made.search(queries, 5)) == rows(R.vector_top(queries, frame(spark, list(now.items())), 5))
    # cells that nothing touched kept their version
    made.upsert(frame(spark, [(901, [1.0] * 8)]), 2)
    versions = {r["version"] for r in made.cells.known().select("version").distinct().collect()}
    assert 2 in versions and len(versions) > 1
    assert made.count() == len(now)


def test_a_cell_that_loses_all_members(spark, tmp_path):
    made = Collection.create(frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])]), f"{tmp_path}/c", cells=2)
    made.upsert(frame(spark, []), 1, deleted=spark.createDataFrame([(1,)], "vec_id long"))
    assert rows(made.search(frame(spark, [(9, [1.0, 0.1])], "query_id"), 3)) == [(9, 2, round(0.1 / np.hypot(1, np.float32(0.1)), 6), 1)]


def test_more_asked_than_there_is(spark, tmp_path):
    data = [(i, [float(i), 1.0]) for i in range(5)] + [(6, [0.0, 0.0]), (7, []), (None, [1.0, 1.0])]
    made = Collection.create(frame(spark, data), f"{tmp_path}/c", cells=3)
    assert made.count() == 5
    queries = frame(spark, [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id")
    assert [(r[0], r[1]) for r in sorted(rows(made.search(queries, 50)), key=lambda r: r[3])] == [(1, i) for i in (4, 3, 2, 1, 0)]
    with pytest.raises(ValueError):
        Collection.create(frame(spark, [(1, None)]), f"{tmp_path}/d")


def test_centroids_follow_the_sample():
    x = np.array([v for _, v in clustered(600)])
    c = fitted(x, 12)
    assert c.shape == (12, 8) and np.sqrt(((x[:, None] - c[None]) ** 2).sum(2).min(1)).mean() < 0.2
    assert len(fitted(x[:3], 12)) == 3


def test_what_python_holds_is_bounded(spark, tmp_path):
    """Batches are cut, records are full but for the last of a cell, and blobs go to Python by bytes; results stay exact."""
    batches = [pa.record_batch({"i": list(range(n))}) for n in (0, 5, 3)]
    assert [b.column("i").to_pylist() for b in slices(batches, 2)] == [[0, 1], [2, 3], [4], [0, 1], [2]]
    data = clustered(2 * PACK + 100, groups=2)
    made = Collection.create(frame(spark, data).coalesce(1), f"{tmp_path}/c", cells=1)
    sizes = [r["n"] for r in made.cells.current().collect()]
    assert sum(sizes) == len(data) and max(sizes) <= PACK and sum(n < PACK for n in sizes) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    queries = frame(spark, data[: 2 * BLOCK + 10], "query_id").coalesce(1)
    assert rows(made.search(queries, 3)) == rows(R.vector_top(queries, frame(spark, data), 3))

    def seen(it):
        for b in it:
            yield pa.record_batch({"n": pa.array([b.num_rows], pa.int64())})

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    blobs = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 100000) as v")
    assert max(r["n"] for r in stored(blobs.mapInArrow(seen, "n long"), arrow_bytes=1 << 20).collect()) <= 12
    assert spark.conf.get(name) == before
