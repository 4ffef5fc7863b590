"""Scans and sinks: page files, manifests, queries, caches, reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.config import Settings
from tarn.functions import text as X
from tarn.operators import detection as V
from tarn.operators.ingest import content_hash, upsert

MANIFEST = (
    "documents array<struct<filename:string,title:string,source_org:string,source_url:string,download_date:date,crop:array<string>,"
    "extraction_hint:string,notes:string,page_ranges:map<string,array<int>>>>"
)
EVAL_QUERY = "id string, query string, lang string, expected_route string, expected_crop string, notes string, ground_truth string"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one on one machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return path or tempfile.mkdtemp(prefix="tarn-")


def stored(df: DataFrame, arrow_rows: int | None = None, arrow_bytes: int | None = None) -> DataFrame:
    """Written to a table in the shared folder and read back: for what several parts of a plan read.

    ``arrow_rows``: at most so many rows go to Python at once; for rows that hold large blobs. ``arrow_bytes``: about so many bytes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tarn-{uuid.uuid4().hex}"
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": arrow_rows, "spark.sql.execution.arrow.maxBytesPerBatch": arrow_bytes}
    limits = {k: v for k, v in limits.items() if v}
    before = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, str(v))
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def tasks_of(rows: DataFrame, each: int = 250_000) -> int:
    """Tasks to deal ``rows`` out to, so that one sorts or keeps about ``each`` of them however many there are: Spark's own
    number at least, and at most 200 unless that is larger, as the writers of a shuffle to more tasks hold and sort their rows."""
    own = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(own, min(200, -(-rows.count() // each)))


def binary_files(spark: SparkSession, path: str, pattern: str = "*", most_bytes: int = 20_000_000, magic: bytes | None = None) -> DataFrame:
    """path, content and content_hash of files below a size, with the given first bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    files = files.where(F.col("length") <= most_bytes)
    if magic:
        files = files.where(F.substring("content", 1, len(magic)) == F.lit(bytearray(magic)))
    return files.withColumn("content_hash", content_hash(F.col("content")))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of a JSON manifest; page ranges as (chapter, start, end)."""
    one = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    docs = one.select(F.explode("documents").alias("d")).select("d.*")
    entry = lambda e: F.struct(e["key"].alias("chapter"), e["value"][0].alias("start"), e["value"][1].alias("end"))
    return docs.withColumn("page_ranges", F.transform(F.map_entries("page_ranges"), entry))


def eval_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL_QUERY).json(path).where("id is not null")


def direct_or_ocr(pages: DataFrame, text: str, ocr_text: str, script: str, s: Settings = Settings(), always_ocr: bool = False) -> DataFrame:
    """The direct text where it is long and enough of the script, else the recognised one; with method and ratio."""
    direct = (F.length(X.strip(F.col(text))) >= s.direct_chars) & (X.script_ratio(F.col(text), script) >= s.direct_ratio) & F.lit(not always_ocr)
    kept = F.when(direct, F.col(text)).otherwise(F.coalesce(F.col(ocr_text), F.lit("")))
    return pages.withColumn("method", F.when(direct, F.lit("direct")).otherwise(F.lit("ocr"))).withColumn("kept", kept).withColumn(
        "script_ratio", F.round(X.script_ratio(F.col("kept"), script), 3)
    )


def write_keyed(spark: SparkSession, rows: DataFrame, path: str, version: str, before: str | None, key: list[str], order: list) -> DataFrame:
    """Upsert into a folder of versions: what stood under ``before`` and the new rows, the latest of each key.

    A version is written whole before anyone reads it, and never read while it is written.
    """
    every = rows if before is None else spark.read.parquet(f"{path}/{before}").unionByName(rows)
    upsert(every, key, order).write.mode("errorifexists").parquet(f"{path}/{version}")
    return spark.read.parquet(f"{path}/{version}")


def append_red(detections: DataFrame, path: str) -> None:
    """Detections of tier red, appended as JSON lines for review."""
    detections.where("tier = 'red'").write.mode("append").json(path)


def write_results(results: DataFrame, path: str, flat: list[str]) -> None:
    """All columns as JSON, the flat ones as CSV."""
    results.write.mode("overwrite").json(f"{path}/json")
    results.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content_hash) of what was ingested; empty where nothing was."""
    try:
        return spark.read.schema("filename string, content_hash string").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "filename string, content_hash string")


def write_manifest(known: DataFrame, done: DataFrame, path: str) -> None:
    """The manifest with new hashes of what was done; written whole to a new ``path``."""
    keep = known.join(done.select("filename"), "filename", "left_anti")
    keep.unionByName(done.select("filename", "content_hash")).write.mode("errorifexists").json(path)


def merged(parts: dict[str, DataFrame], key: str = "image") -> DataFrame:
    """Datasets as one, with ``dataset`` saying where a row is from; an error if two of them hold the same image."""
    every = None
    for name, rows in parts.items():
        part = rows.withColumn("dataset", F.lit(name))
        every = part if every is None else every.unionByName(part)
    twice = every.select(key, "dataset").distinct().groupBy(key).agg(F.sort_array(F.collect_set("dataset")).alias("d")).where(F.size("d") > 1).orderBy(key).limit(5).collect()
    if twice:
        raise ValueError("images in several datasets: " + ", ".join(f"{r[key]} ({', '.join(r['d'])})" for r in twice))
    return every


def write_dataset(lines: DataFrame, classes: list[str], path: str, buckets: int = 64, seed: int = 42) -> DataFrame:
    """Label lines (image, line) as a dataset: checked, split by class and packed; returns (split, images, lines, wrong).

    ``path/labels/split=<s>/bucket=<b>`` has a row (image, body) for each image, so folders are three times ``buckets`` however
    many images there are; ``path/wrong`` has the lines that say nothing valid, with the reason; ``path/data.yaml`` the
    description, written last: a dataset without it isn't whole. An image keeps its split when others come, as far as the shares of
    its class allow: images are ordered by a hash.
    """
    spark = lines.sparkSession
    judged = stored(lines.select("image", "line").withColumn("reason", V.label_line(F.col("line"), len(classes))))  # read four times
    good = judged.where("reason = ''")
    of = stored(V.primary_class(good))
    placed = stored(V.split(of, "class_id", "image", seed).select("image", "split"))
    body = good.groupBy("image").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("body"))
    packed = body.join(placed, "image").withColumn("bucket", F.pmod(F.xxhash64("image"), F.lit(buckets)))
    # a bucket's rows come together first, so that a folder gets a file and not one from each task
    packed.repartition("split", "bucket").write.mode("errorifexists").partitionBy("split", "bucket").parquet(f"{path}/labels")
    judged.where("reason <> ''").write.mode("errorifexists").json(f"{path}/wrong")
    spark.createDataFrame([(dataset_yaml(classes),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/data.yaml")
    kept = spark.read.parquet(f"{path}/labels").groupBy("split").agg(F.count("*").alias("images"), F.sum(F.size(F.split("body", "\n"))).alias("lines"))
    wrong = judged.join(placed, "image", "left").where("reason <> ''").groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(F.count("*").alias("wrong"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return kept.join(wrong, "split", "full_outer").select("split", zero("images"), zero("lines"), zero("wrong"))


def dataset_yaml(classes: list[str], path: str = ".") -> str:
    """The description of an image dataset with its splits and class names."""
    return "\n".join([f"path: {path}", *[f"{s}: images/{s}" for s in ("train", "val", "test")], f"nc: {len(classes)}", "names:", *[f"  {i}: {c}" for i, c in enumerate(classes)]]) + "\n"
