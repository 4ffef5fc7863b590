"""Width, height and soundness of PNG and JPEG files from their bytes, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PNG, PNG_END = "89504E470D0A1A0A", "0000000049454E44AE426082"
#: Most segments that a JPEG's frame header is looked for behind.
SEGMENTS = 256


def _number(content: Column, at: Column, n: int) -> Column:
    """``n`` bytes from a place (from 1) as a number; null beyond the end."""
    part = F.substring(content, at, F.lit(n))
    return F.when(F.octet_length(part) == n, F.conv(F.hex(part), 16, 10).cast("int"))


def _jpeg_frame(content: Column) -> Column:
    """The place of a JPEG's frame header (its marker's first byte, from 1), by its segments' lengths; null without one."""

    def step(acc, _):
        marker = _number(content, acc["at"], 2)
        kind = marker.bitwiseAND(F.lit(0xFF))
        frame = (kind >= 0xC0) & (kind <= 0xCF) & ~kind.isin(0xC4, 0xC8, 0xCC)
        length = _number(content, acc["at"] + 2, 2)
        bad = marker.isNull() | (marker < 0xFF00) | length.isNull() | (length < 2) | (kind == 0xDA)
        return (
            F.when(acc["done"], acc)
            .when(F.coalesce(bad, F.lit(True)), F.struct(acc["at"].alias("at"), F.lit(True).alias("done"), F.lit(False).alias("found")))
            .when(frame, F.struct(acc["at"].alias("at"), F.lit(True).alias("done"), F.lit(True).alias("found")))
            .otherwise(F.struct((acc["at"] + 2 + length).alias("at"), F.lit(False).alias("done"), F.lit(False).alias("found")))
        )

    start = F.struct(F.lit(3).alias("at"), F.lit(False).alias("done"), F.lit(False).alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), start, step, lambda acc: F.when(acc["found"], acc["at"]))


def image_info(content: Column) -> Column:
    """A struct (kind, width, height, corrupt) of a file's bytes: kind is png, jpeg or null; a file is corrupt if it is of no
    kind, if its header says no size, or if its end is missing."""
    starts = lambda code: F.hex(F.substring(content, F.lit(1), F.lit(len(code) // 2))) == code
    ends = lambda code: F.hex(F.substring(content, F.octet_length(content) - len(code) // 2 + 1, F.lit(len(code) // 2))) == code
    kind = F.when(starts(PNG), F.lit("png")).when(starts("FFD8"), F.lit("jpeg"))
    frame = F.transform(F.array(_jpeg_frame(content)), lambda at: F.struct(_number(content, at + 7, 2).alias("w"), _number(content, at + 5, 2).alias("h")))[0]
    size = F.when(kind == "png", F.struct(_number(content, F.lit(17), 4).alias("w"), _number(content, F.lit(21), 4).alias("h"))).when(kind == "jpeg", frame)
    whole = F.when(kind == "png", ends(PNG_END)).when(kind == "jpeg", ends("FFD9"))

    def told(s):
        sound = whole & (s["w"] > 0) & (s["h"] > 0)
        return F.struct(kind.alias("kind"), s["w"].alias("width"), s["h"].alias("height"), (~F.coalesce(sound, F.lit(False))).alias("corrupt"))

    return F.transform(F.array(size), told)[0]


def inspected(files: DataFrame, folder: Column, content: str = "content") -> DataFrame:
    """(folder, files, corrupt, sizes): for each folder its files, the corrupt ones among them, and how many there are of each
    size (widthxheight) of the sound ones. Bytes go no further than their headers."""
    each = files.select(folder.alias("folder"), image_info(F.col(content)).alias("i")).select("folder", "i.*")
    size = F.when(~F.col("corrupt"), F.concat_ws("x", "width", "height"))
    counts = each.groupBy("folder", size.alias("size")).agg(F.count("*").alias("n"), F.count_if("corrupt").alias("bad"))
    sized = F.filter(F.array_sort(F.collect_list(F.struct("size", "n"))), lambda x: x["size"].isNotNull())
    return counts.groupBy("folder").agg(F.sum("n").alias("files"), F.sum("bad").alias("corrupt"), F.map_from_entries(sized).alias("sizes"))
