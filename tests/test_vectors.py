"""Vector search by chunks and tiles against all scores, and how much it hands on."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tarn.operators import retrieval as R
from tarn.plans import registry


@pytest.mark.parametrize("metric", ["cosine", "l2sq"])
def test_tiles_equal_every_score_and_hand_on_little(spark, monkeypatch, metric):
    monkeypatch.setattr(R, "_ROWS", 50)
    monkeypatch.setattr(R, "_TILE", 7)
    written, keep = [], R.stored
    monkeypatch.setattr(R, "stored", lambda df, **k: written.append((keep(df, **k), k)) or written[-1][0])
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (2000, 4)).astype(float) + [0, 0, 0, 8]  # few values: many equal scores
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    queries = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in R.vector_top(queries, rows, 3, metric, block=30).collect())
    y = x[::20]
    if metric == "cosine":
        score = (y / np.linalg.norm(y, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    else:
        score = 1 - ((y**2).sum(1)[:, None] - 2 * y @ x.T + (x**2).sum(1)[None, :])
    score = np.round(score, 6)
    best = np.argsort(-score, axis=1, kind="stable")[:, :3]
    want = [(20 * q, j + 1, int(i), score[q, i]) for q, b in enumerate(best) for j, i in enumerate(b)]
    assert [w[:3] for w in want] == [g[:3] for g in got] and np.allclose([w[3] for w in want], [g[3] for g in got], atol=1e-6)
    found, how = written[-1]
    # 40 chunks x 100 queries x 3 rows; pairs of chunks and blocks go to Python a few at a time
    assert how["arrow_rows"] <= 2 and found.count() < 40 * 100 * 3


def written_by(monkeypatch):
    """Tables that a search writes, as they come."""
    written, keep = [], R.stored
    monkeypatch.setattr(R, "stored", lambda df, **k: written.append(keep(df, **k)) or written[-1])
    return written


@pytest.mark.parametrize("metric", ["cosine", "l2sq"])
def test_chunks_are_full_and_a_task_hands_on_the_best(spark, monkeypatch, metric):
    """Though pairs go to Python two at a time, chunks aren't of two rows: their number, and so the time, would be 2,048 times as large."""
    monkeypatch.setattr(R, "_ROWS", 100)
    monkeypatch.setattr(R, "_TILE", 7)
    written = written_by(monkeypatch)
    x = np.random.default_rng(4).normal(size=(3000, 4))
    rows = spark.createDataFrame([(f"r{i:05d}", v.tolist()) for i, v in enumerate(x)], "vec_id string, embedding array<double>").repartition(50)
    queries = rows.where("vec_id like '%0'").withColumnRenamed("vec_id", "query_id")
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in R.vector_top(queries, rows, 5, metric, block=70).collect())
    y = x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x
    score = np.round(y[::10] @ y.T if metric == "cosine" else 1 - ((y[::10, None] - y[None]) ** 2).sum(2), 6)
    best = np.argsort(-score, axis=1, kind="stable")[:, :5]
    assert got == sorted((f"r{10 * q:05d}", j + 1, f"r{i:05d}") for q, b in enumerate(best) for j, i in enumerate(b))
    sizes = [len(r["ids"]) for t in written if "ids" in t.columns for r in t.collect()]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(sizes) == 3000 and max(sizes) == 100 and len(sizes) <= 3000 / 100 + partitions
    assert written[-1].count() <= 300 * 5 * partitions * 1.1  # some scores are equal


@pytest.mark.parametrize("metric, least", [("cosine", 0.9), ("l2sq", 0.5)])
def test_tasks_hand_on_what_has_the_least_score(spark, monkeypatch, metric, least):
    monkeypatch.setattr(R, "_ROWS", 100)
    written = written_by(monkeypatch)
    x = np.random.default_rng(6).normal(size=(1000, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in R.vector_top(queries, rows, 10, metric, least=least).collect())
    want = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in R.vector_top(queries, rows, 10, metric).collect() if r["score"] >= least)
    assert got == want and len(got) < 400
    found = written[2]  # after chunks and blocks
    assert found.count() and found.where(f"score < {least}").count() == 0


def test_chunks_of_wide_vectors_have_fewer_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "_BYTES", 64 * 1024)
    written = written_by(monkeypatch)
    rows = spark.range(0, 200, 1, 1).selectExpr("id vec_id", "transform(sequence(1, 256), i -> double(sin((id + 1) * i))) embedding")
    assert R.vector_top(rows.where("vec_id < 3").withColumnRenamed("vec_id", "query_id"), rows, 1).where("query_id = id").count() == 3
    sizes = [len(r["ids"]) for t in written if "ids" in t.columns for r in t.collect()]
    assert sum(sizes) == 200 and max(sizes) <= 64 * 1024 / (256 * 8)


def odd(n=400):
    """Equal vectors, vectors of length 0 and none at all."""
    x = np.random.default_rng(5).integers(-2, 3, (n, 3)).astype("float32")
    x[[0, 7, 20, *range(100, 130), 399]] = 0
    x[200:300] = [1, 2, -1]
    return [(i, None if i % 57 == 3 else v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("name", ["vector_topk_cosine", "vector_topk_l2", "vector_min_similarity"])
@pytest.mark.parametrize("rows", [4096, 3])
def test_odd_vectors_equal_sql(spark, monkeypatch, tmp_path, name, rows):
    monkeypatch.setattr(R, "_ROWS", rows)
    data = odd()
    spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    embeddings = pa.table({"vec_id": pa.array([i for i, _ in data], pa.int64()), "embedding": pa.array([v for _, v in data], pa.list_(pa.float32()))}).filter(pa.array([v is not None for _, v in data]))
    con.register("embeddings", embeddings)
    plain = lambda q, i, s, r: (q, r, i, "nan" if np.isnan(s) else round(s, 6) + 0.0)
    want = sorted(plain(*r) for r in con.execute(f"SELECT query_id, id, score, rank FROM ({registry.ORACLES[name]})").fetchall())
    got = sorted(plain(r["query_id"], r["id"], r["score"], r["rank"]) for r in registry.QUERIES[name](spark, str(tmp_path)).collect())
    assert got == want and any(r[3] == "nan" for r in got) == (name != "vector_topk_l2")


@pytest.mark.parametrize("far", [1_000, 3_000_000])
def test_far_vectors_equal_sql(spark, monkeypatch, tmp_path, far):
    """Scores of very large size, where rounding moves by more than the sixth digit, and many equal ones."""
    monkeypatch.setattr(R, "_ROWS", 64)
    written = written_by(monkeypatch)
    x = np.random.default_rng(7).integers(-2, 3, (600, 3)) * far
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(float))], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(f"SELECT query_id, rank, id, score FROM ({registry.ORACLES['vector_topk_l2']})").fetchall())
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in registry.QUERIES["vector_topk_l2"](spark, str(tmp_path)).collect())
    assert got == want and min(g[3] for g in got) < -far
    assert max(len(r["ids"]) for r in written[0].collect()) == 64


def test_no_rows_and_no_queries(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    queries = rows.withColumnRenamed("vec_id", "query_id")
    for q, r in ((queries.where("false"), rows), (queries, rows.where("false")), (queries.where("false"), rows.where("false"))):
        assert R.vector_top(q, r, 3).count() == 0
