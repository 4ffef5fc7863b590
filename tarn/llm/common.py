"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Words of a text: runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own on one machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="tarn-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path


@contextmanager
def tidy(spark: SparkSession, arrow_rows: int | None = None):
    """Writes within remove their own shuffle files when they are done, rather than when the driver collects its garbage.

    ``arrow_rows``: at most so many rows go to Python at once; for rows that hold large blobs.
    """
    conf = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if arrow_rows:
        conf["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(arrow_rows)
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def saved(df: DataFrame, arrow_rows: int | None = None, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts the lineage and survives lost executors.

    ``group_bytes``: size of the row groups, which readers take whole; for rows that hold large blobs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarn-{uuid.uuid4().hex}"
    with tidy(spark, arrow_rows):
        writer = df.write.option("compression", "zstd")
        if group_bytes:
            writer = writer.option("parquet.block.size", group_bytes).option("parquet.block.size.row.check.min", 1)
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plain_names(docs: DataFrame) -> DataFrame:
    """The same columns by place; those whose names have points or other signs under plain names. ``toDF`` names them again."""
    return docs.toDF(*[c if re.fullmatch(r"\w+", c) else f"__column{i}__" for i, c in enumerate(docs.columns)])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
