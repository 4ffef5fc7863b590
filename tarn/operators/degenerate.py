"""Looping texts: what array functions express only with quadratic work."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import long_lines_repeat


def loops(text: str, shortest: int = 6, longest: int = 24, times: int = 3) -> bool:
    """Whether a block of so many words stands ``times`` in a row.

    Words that equal the one a block further on are counted in runs: a run of (times - 1) * block is a loop.
    """
    words = text.casefold().split()
    for block in range(shortest, min(longest, len(words) // times) + 1):
        run = 0
        for a, b in zip(words, words[block:]):
            run = run + 1 if a == b else 0
            if run >= (times - 1) * block:
                return True
    return False


def flagged(docs: DataFrame, id_col: str, text_col: str, least_words: int = 18) -> DataFrame:
    """doc_id and degenerate."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), F.coalesce(long_lines_repeat(F.col(text_col)), F.lit(False)).alias("lines"))

    def batches(it):
        for b in it:
            out = [bool(t) and len(t.split()) >= least_words and (x or loops(t)) for t, x in zip(b.column("t").to_pylist(), b.column("lines").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.bool_())], names=["doc_id", "degenerate"])

    return chosen.mapInArrow(batches, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, degenerate boolean")
