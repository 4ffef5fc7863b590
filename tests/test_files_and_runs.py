"""Images from bytes, tables by strategies, datasets in bounded folders, runs into a knowledge base."""

import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tarn import dictionaries as D
from tarn.operators import page_tables as P
from tarn.sources import files, images, knowledge
from tarn.sources.capabilities import hashed_embedding

# images


def png(w, h):
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0" * 9)) + part(b"IEND", b"")


def jpeg(w, h, frame=0xC0, before=()):
    part = lambda marker, data: bytes([0xFF, marker]) + struct.pack(">H", len(data) + 2) + data
    head = b"".join(part(m, d) for m, d in before)
    return b"\xff\xd8" + part(0xE0, b"JFIF\0" + bytes(9)) + head + part(frame, struct.pack(">BHHB", 8, h, w, 3) + bytes(9)) + part(0xDA, bytes(10)) + b"\x12\x34\xff\xd9"


def test_sizes_of_images(spark):
    given = {
        "png": (png(640, 480), ("png", 640, 480, False)),
        "wide": (png(70_000, 3), ("png", 70_000, 3, False)),
        "jpeg": (jpeg(800, 600), ("jpeg", 800, 600, False)),
        "progressive": (jpeg(33, 44, 0xC2, [(0xC4, bytes(30)), (0xDB, bytes(65)), (0xE1, bytes(60_000))]), ("jpeg", 33, 44, False)),
        "cut png": (png(5, 6)[:-3], ("png", 5, 6, True)),
        "cut jpeg": (jpeg(5, 6)[:-1], ("jpeg", 5, 6, True)),
        "no frame": (b"\xff\xd8\xff\xda\x00\x04ab\xff\xd9", ("jpeg", None, None, True)),
        "head alone": (png(5, 6)[:18], ("png", None, None, True)),
        "no height": (png(5, 0), ("png", 5, 0, True)),
        "text": (b"not an image", (None, None, None, True)),
        "empty": (b"", (None, None, None, True)),
        "null": (None, (None, None, None, True)),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in given.items()], "name string, content binary")
    got = {r["name"]: tuple(r["i"]) for r in df.select("name", images.image_info(F.col("content")).alias("i")).collect()}
    assert got == {k: v[1] for k, v in given.items()}


def test_folders_of_written_files(spark, tmp_path):
    for name, content in {"a/1.png": png(3, 4), "a/2.png": png(3, 4), "a/3.jpg": jpeg(5, 6), "a/4.jpg": b"broken", "b/1.png": png(7, 8)[:-1]}.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = files.binary_files(spark, str(tmp_path))
    got = {r["folder"]: (r["files"], r["corrupt"], r["sizes"]) for r in images.inspected(found, F.element_at(F.split("path", "/"), -2)).collect()}
    assert got == {"a": (4, 1, {"3x4": 2, "5x6": 1}), "b": (1, 1, {})}


# tables by strategies


def test_tables_by_the_first_strategy_that_finds_any(spark):
    wide = [["a", " b ", None, "d", "e"], ["", None, "", "", ""], ["1", "2", "3", "4", "5"]]
    other = [["x", "y", "z", "u", "v"], ["1"]]
    narrow, single = [["a", "b"], ["c", "d"]], [["a", "b", "c", "d", "e"]]
    rows = [
        ("d", 1, 0, [narrow, single]), ("d", 1, 1, [wide]), ("d", 2, 0, [other, wide]), ("d", 2, 1, [[["torn"] * 5] * 2]), ("d", 3, 0, None), ("d", 3, 1, [other]), ("d", 4, 0, []),
        ("e", 1, 0, [wide, wide]),
    ]
    df = spark.createDataFrame(rows, "doc string, page int, strategy int, tables array<array<array<string>>>")
    got = sorted((r["doc"], r["page"], r["table_no"], r["cells"][0][0]) for r in P.page_tables(df, "doc").collect())
    assert got == [("d", 1, 0, "a"), ("d", 2, 1, "x"), ("e", 1, 0, "a")]
    assert P.page_tables(df, "doc").where("doc = 'e'").first()["cells"] == [["a", "b", "", "d", "e"], ["1", "2", "3", "4", "5"]]
    assert P.page_tables(df.where("false"), "doc").count() == 0


def test_rows_with_cells_are_not_sorted(spark):
    rows = [("d", i, 0, [[[f"{i}", "b", "c", "d", "e"], ["1", "2", "3", "4", "5"]]]) for i in range(20)]
    got = P.page_tables(spark.createDataFrame(rows, "doc string, page int, strategy int, tables array<array<array<string>>>"), "doc")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert not [x for x in plan.splitlines() if "Sort" in x and ("__tables" in x or "cells" in x)]
    assert sorted((r["page"], r["table_no"], r["cells"][0][0]) for r in got.collect()) == [(i, i, f"{i}") for i in range(20)]


def test_tasks_grow_with_rows_to_a_limit(spark):
    rows = spark.range(1000)
    assert [files.tasks_of(rows, n) for n in (1000, 100, 1)] == [4, 10, 200]


# datasets


def test_label_lines_are_read_and_judged_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def line(i):
        seen.add(1)
        return f"{i % 4} 0.5 0.5 1.0 1.0"

    rows = spark.range(40).select(F.concat(F.lit("img"), (F.col("id") % 20).cast("string")).alias("image"), F.udf(line)("id").alias("line"))
    got = files.write_dataset(rows, ["a", "b", "c"], f"{tmp_path}/d", buckets=2).agg(F.sum("images"), F.sum("lines"), F.sum("wrong")).first()
    assert (*got, seen.value) == (15, 30, 10, 40)


def test_dataset_in_bounded_folders(spark, tmp_path):
    lines = [(f"img{i}", f"{i % 3} 0.5 0.5 1.0 1.0") for i in range(300)] + [("img0", "2 0.1 0.1 0.1 0.1"), ("img1", "7 0.5 0.5 1 1"), ("bad", "x 0 0 0 0")]
    df = spark.createDataFrame(lines, "image string, line string")
    got = {r["split"]: (r["images"], r["lines"], r["wrong"]) for r in files.write_dataset(df, ["a", "b", "c"], f"{tmp_path}/d", buckets=8).collect()}
    assert {k: v[0] for k, v in got.items()} == {"train": 240, "val": 30, "test": 30, "none": 0}
    assert sum(v[1] for v in got.values()) == 301 and sum(v[2] for v in got.values()) == 2
    folders = [f for s in os.listdir(tmp_path / "d/labels") if s.startswith("split=") for f in os.listdir(tmp_path / "d/labels" / s) if f.startswith("bucket=")]
    assert len(folders) <= 24
    body = {r["image"]: r["body"] for r in spark.read.parquet(f"{tmp_path}/d/labels").collect()}
    assert body["img0"] == "0 0.5 0.5 1.0 1.0\n2 0.1 0.1 0.1 0.1" and len(body) == 300
    assert "nc: 3" in "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/d/data.yaml").collect())
    assert sorted(r["reason"] for r in spark.read.json(f"{tmp_path}/d/wrong").collect()) == ["class id 7 out of range", "non-numeric field"]


def test_datasets_must_not_share_images(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "image string") for xs in (["1", "2"], ["3", "2"]))
    with pytest.raises(ValueError, match=r"2 \(a, b\)"):
        files.merged({"a": a, "b": b})
    both = files.merged({"a": a, "b": b.where("image = '3'")})
    assert sorted(map(tuple, both.collect())) == [("1", "a"), ("2", "a"), ("3", "b")]


# a knowledge base

SOURCE = "filename string, title string, source_org string, source_url string, crop array<string>"


def pages(spark, texts):
    rows = [(name, i, text, str(hash(tuple(ts)))) for name, ts in texts.items() for i, text in enumerate(ts)]
    return spark.createDataFrame(rows, "filename string, page int, text string, content_hash string")


def test_runs_into_a_knowledge_base(spark, tmp_path):
    text = lambda w: f"This page tells about {w}, and about nothing else that anybody would want to read."
    first = {"a": [text("rice"), text("wheat")], "b": [text("maize")], "c": ["short"]}
    sources = spark.createDataFrame([("a", "Book A", "org", "http://a", ["rice"])], SOURCE)
    base = knowledge.KnowledgeBase(spark, f"{tmp_path}/k")
    run = lambda texts, version: base.run(pages(spark, texts), sources, version, script=D.LATIN, cells=2)
    assert run(first, 0) == {"documents": 3, "records": 3, "tables": 0, "without_vector": 0, "chars": sum(len(text(w)) for w in ("rice", "wheat", "maize"))}
    second = first | {"a": [text("barley")], "d": [text("potatoes")]}
    for _ in range(2):  # the run is made again
        assert run(second, 1)["documents"] == 2
        got = {r["chunk_id"]: (r["title"], r["text"]) for r in base.records.current().collect()}
        assert got == {"a::c0": ("Book A", text("barley")), "b::c0": ("b", text("maize")), "d::c0": ("d", text("potatoes"))}
        assert base.vectors().count() == 3
    assert run(second, 2) == {"documents": 0, "records": 0, "tables": 0, "without_vector": 0, "chars": 0}
    call = hashed_embedding().load()
    asked = spark.createDataFrame([(1, call([text("potatoes")])[0]), (2, call([text("maize")])[0])], "query_id int, vector array<float>")
    best = {r["query_id"]: (r["filename"], r["score"], r["source_org"]) for r in knowledge.KnowledgeBase(spark, f"{tmp_path}/k").ask(asked, 1).collect()}
    assert best == {1: ("d", 1.0, "unspecified"), 2: ("b", 1.0, "unspecified")}
