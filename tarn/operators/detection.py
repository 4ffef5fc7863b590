"""Detections and image datasets: tiers, class names, splits, label checks, inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn import dictionaries as D


def tier(c: Column, green: float = 0.85, amber: float = 0.60) -> Column:
    return F.when(c >= green, F.lit("green")).when(c >= amber, F.lit("amber")).otherwise(F.lit("red"))


def top_detection(rows: DataFrame, image: str, confidence: str, tie: str) -> DataFrame:
    """The surest detection of each image, the first of equals."""
    w = Window.partitionBy(image).orderBy(F.desc(confidence), F.asc(tie))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def with_class(rows: DataFrame, column: str, classes: dict = D.CLASSES, default: tuple = D.NO_CLASS) -> DataFrame:
    """Rows with crop, label and query of their class; unknown classes get the default. The table is a caller's."""
    spark = rows.sparkSession
    dim = spark.createDataFrame([(k, *v) for k, v in classes.items()], "__class string, crop string, label string, rag_query string")
    met = rows.join(dim, F.col(column) == F.col("__class"), "left").drop("__class")
    return met.fillna(dict(zip(("crop", "label", "rag_query"), default)))


def split(rows: DataFrame, by: str, key: str, seed: int = 42, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Rows with split (train, val, test): shares within each class, in the order of a hash of the seed and the key.

    A class is ranked in 256 slices by the first digits of its hashes, each shifted by what stands before it, so that a
    class of half of all rows is still ranked by many tasks.
    """
    cut = rows.withColumn("__h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)).withColumn("__s", F.substring("__h", 1, 2))
    sums = cut.groupBy(by, "__s").agg(F.count("*").alias("__c"))
    before = Window.partitionBy(by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    # a class has at most 256 rows here
    shift = sums.select(by, "__s", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__b"), F.sum("__c").over(Window.partitionBy(by)).alias("__n"))
    w = Window.partitionBy(by, "__s").orderBy("__h", key)
    placed = cut.withColumn("__r", F.row_number().over(w)).join(shift, [by, "__s"]).withColumn("__i", F.col("__r") + F.col("__b"))
    a = F.bround(F.col("__n") * train, 0)
    b = a + F.bround(F.col("__n") * val, 0)
    return placed.withColumn("split", F.when(F.col("__i") <= a, F.lit("train")).when(F.col("__i") <= b, F.lit("val")).otherwise(F.lit("test"))).drop("__i", "__n", "__h", "__s", "__r", "__b")


def label_line(c: Column, classes: int) -> Column:
    """The reason why a label line (class and box) is wrong, or an empty string."""
    one = lambda value, use: F.get(F.transform(F.array(value), use), 0)  # noqa: E731 - value is worked out once
    parts = F.filter(F.split(F.trim(c), " +"), lambda x: x != "")
    return one(parts, lambda p: one(F.transform(F.slice(p, 2, 4), lambda x: x.try_cast("double")), lambda numbers: _reason(p, numbers, F.get(p, 0).try_cast("int"), classes)))


def _reason(parts: Column, numbers: Column, k: Column, classes: int) -> Column:
    return (
        F.when(F.size(parts) != 5, F.concat(F.lit("expected 5 fields, got "), F.size(parts).cast("string")))
        .when(k.isNull() | F.exists(numbers, lambda x: x.isNull()), F.lit("non-numeric field"))
        .when((k < 0) | (k >= classes), F.concat(F.lit("class id "), k.cast("string"), F.lit(" out of range")))
        .when(F.exists(numbers, lambda x: (x < 0) | (x > 1)), F.lit("coords out of [0,1]"))
        .otherwise(F.lit(""))
    )


def pixel_box(cx: Column, cy: Column, w: Column, h: Column, width: int, height: int) -> Column:
    """Corners in pixels of a box given by its centre and size as shares."""
    cut = lambda a, b, n: ((a + b / 2) * n).cast("int")
    return F.struct(cut(cx, -w, width).alias("x1"), cut(cy, -h, height).alias("y1"), cut(cx, w, width).alias("x2"), cut(cy, h, height).alias("y2"))


def collisions(parts: list[DataFrame], key: str) -> DataFrame:
    """Keys that several datasets hold, with their number; a merge must find none."""
    both = parts[0].select(key)
    for p in parts[1:]:
        both = both.unionByName(p.select(key))
    return both.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")


def missing(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that are expected but not found."""
    return expected.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def remapped(lines: DataFrame, mapping: DataFrame) -> DataFrame:
    """(image, line) with class ids mapped (from_id, to_id); lines of other classes go, and images left without any."""
    m = mapping.select(F.col("from_id").alias("__f"), "to_id")
    return (
        lines.join(m, F.split("line", " ")[0].try_cast("int") == F.col("__f"))
        .select("image", F.concat(F.col("to_id").cast("string"), F.regexp_replace("line", "^[0-9]+", "")).alias("line"))
    )


def full_frame(images: DataFrame, label: str, mapping: DataFrame) -> DataFrame:
    """A label line over the whole image for each image of a mapped folder label (from_label, class_id)."""
    m = mapping.select(F.col("from_label").alias("__l"), "class_id")
    met = images.join(m, F.col(label) == F.col("__l")).drop("__l")
    return met.withColumn("line", F.concat(F.col("class_id").cast("string"), F.lit(" 0.5 0.5 1.0 1.0")))


def stem(name: Column) -> Column:
    """A file's name without its ending."""
    return F.regexp_replace(name, "[.][^.]+$", "")


def annotation_format(files: DataFrame, folder: str, name: str) -> DataFrame:
    """bbox for a folder with text files, else folder if it has any image, else unknown."""
    text, image = F.bool_or(F.lower(F.col(name)).endswith(".txt")), F.bool_or(F.col(name).rlike("(?i)[.](?:jpg|jpeg|png)$"))
    return files.groupBy(folder).agg(F.when(text, F.lit("bbox")).when(image, F.lit("folder")).otherwise(F.lit("unknown")).alias("format"))


def primary_class(lines: DataFrame, image: str = "image", line: str = "line") -> DataFrame:
    """(image, class_id) of each image's first label line."""
    return lines.groupBy(image).agg(F.min_by(F.split(line, " ")[0].try_cast("int"), line).alias("class_id"))


def unmatched(images: DataFrame, label: str, mapping: DataFrame) -> DataFrame:
    """Folder labels without a class, with their images."""
    return images.join(mapping.select(F.col("from_label").alias(label)), label, "left_anti").groupBy(label).agg(F.count("*").alias("images"))
