"""Many words at once: which of thousands of words stand in a text, in one pass over it.

Words become one automaton (Aho-Corasick), whose size is checked before it is sent to the tasks; texts meet it in Arrow
batches, and only what was found becomes rows. So neither the number of words nor that of texts makes a product of both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most words and characters of one automaton: some hundred megabytes in each task.
MOST_WORDS, MOST_CHARS = 2_000_000, 40_000_000
#: Texts that are Python objects at once, with what is found in them.
_TEXTS = 64
_BUILT: dict[int, object] = {}


def _automaton(shared):
    """The automaton of a broadcast list of words; built once in a worker."""
    import ahocorasick

    if shared.value is not None and id(shared.value) not in _BUILT:
        _BUILT.clear()
        a = ahocorasick.Automaton()
        for i, w in enumerate(shared.value):
            a.add_word(w, (i, len(w)))
        a.make_automaton()
        _BUILT[id(shared.value)] = a
    return _BUILT[id(shared.value)]


def _collected(words: DataFrame, word: str) -> list[str]:
    """The distinct words in lower case; an error if they are too many for one automaton."""
    chosen = words.select(F.lower(F.col(word)).alias("w")).where("w <> ''").distinct()
    n, chars = chosen.agg(F.count("*"), F.coalesce(F.sum(F.length("w")), F.lit(0))).first()
    if n > MOST_WORDS or chars > MOST_CHARS:
        raise ValueError(f"{n} words of {chars} characters are too many for one automaton")
    return sorted(r["w"] for r in chosen.collect())


def _found(texts: pa.Array, words: list[str], automaton) -> pa.Array:
    """What ``places`` returns for a batch of texts."""
    which, at, ends = [np.empty(0, np.int32)], [np.empty(0, np.int32)], [0]
    for lo in range(0, len(texts), _TEXTS):
        held: list[dict[int, int]] = []
        for t in texts.slice(lo, _TEXTS).to_pylist():
            first: dict[int, int] = {}
            for end, (i, n) in automaton.iter(t or "") if automaton else ():
                first.setdefault(i, end - n + 1)
            held.append(first)
            ends.append(ends[-1] + len(first))
        n = ends[-1] - ends[-1 - len(held)]
        # numbers of four bytes, not objects, wait for the end of the batch
        which.append(np.fromiter((i for f in held for i in f), np.int32, n))
        at.append(np.fromiter((x for f in held for x in f.values()), np.int32, n))
    which, at = np.concatenate(which), np.concatenate(at)
    distinct, code = np.unique(which, return_inverse=True)
    names = pa.array([words[i] for i in distinct.tolist()], pa.string()).take(pa.array(code, pa.int32()))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([names, pa.array(at)], names=["word", "at"]))


def places(text: Column, words: list[str], spark) -> Column:
    """An array of (word, at): each word of the list that stands in the lower-cased text, with its first place (from 0)."""
    shared = spark.sparkContext.broadcast(words)

    def find(texts: pa.Array) -> pa.Array:
        return _found(texts, shared.value, _automaton(shared) if shared.value else None)

    find.__annotations__ = {"texts": pa.Array, "return": pa.Array}  # real types: this module's annotations are strings
    return F.arrow_udf(find, "array<struct<word:string,at:int>>")(F.lower(text))


def occurring(rows: DataFrame, text: Column, words: DataFrame, word: str) -> DataFrame:
    """Rows with each row of ``words`` whose word (without regard to case) their text holds, and ``at``, its first place.

    Columns are those of both, and at. A null or empty word stands nowhere.
    """
    hits = rows.withColumn("__hit", F.explode(places(text, _collected(words, word), rows.sparkSession)))
    met = hits.join(words.withColumn("__word", F.lower(F.col(word))), F.col("__hit.word") == F.col("__word"))
    return met.withColumn("at", F.col("__hit.at")).drop("__hit", "__word")


def longest(rows: DataFrame, text: Column, aliases: DataFrame, alias: str = "alias", to: str = "canonical") -> DataFrame:
    """Rows with what the longest alias in their text stands for (of equals the first by its letters); null without any."""
    spark = rows.sparkSession
    found = rows.withColumn("__hits", places(text, _collected(aliases, alias), spark))
    by = lambda x: F.struct((-F.length(x["word"])).alias("n"), x["word"].alias("word"))
    best = found.withColumn("__best", F.array_min(F.transform("__hits", by))["word"]).drop("__hits")
    first = Window.partitionBy("__alias").orderBy(to)
    named = aliases.select(F.lower(F.col(alias)).alias("__alias"), F.col(to)).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return best.join(named, F.col("__best") == F.col("__alias"), "left").drop("__best", "__alias")
