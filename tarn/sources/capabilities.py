"""Models and networks behind one shape: a function over Arrow batches, and rows that say so where none is set up."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn import dictionaries as D


#: Rows whose answers are held at once.
HELD = 1024


@dataclass(frozen=True)
class Capability:
    """``load`` runs once for each task and returns a function from a list of inputs to a list of outputs (or None)."""

    name: str
    load: Callable[[], Callable[[list], list]] | None = None
    kind: str = "string"
    batch: int = 32


def apply(rows: DataFrame, column: str, capability: Capability, to: str) -> DataFrame:
    """Rows with ``to``, ``to``_available and ``to``_error. A failing batch fails its own rows, not the job."""
    if capability.load is None:
        return rows.select(
            "*", F.lit(None).cast(capability.kind).alias(to), F.lit(False).alias(f"{to}_available"), F.lit(f"{capability.name} is not configured").alias(f"{to}_error")
        )
    schema = rows.select("*", F.lit(None).cast(capability.kind).alias(to), F.lit(True).alias(f"{to}_available"), F.lit(None).cast("string").alias(f"{to}_error")).schema
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(schema[to].dataType)

    def batches(it):
        call = capability.load()
        each = max(1, HELD // capability.batch) * capability.batch
        for b in (b.slice(i, each) for b in it for i in range(0, b.num_rows, each)):
            out, error = [], []
            values = b.column(column).to_pylist()
            for at in range(0, len(values), capability.batch):
                part = values[at : at + capability.batch]
                try:
                    got = call(part)
                    out += got
                    error += [None if g is not None else "no answer" for g in got]
                except Exception as e:  # noqa: BLE001  what a model raises is not known here
                    out += [None] * len(part)
                    error += [f"{type(e).__name__}: {e}"] * len(part)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(out, kind), pa.array([e is None for e in error]), pa.array(error, pa.string())], names=[f.name for f in schema]
            )

    return rows.mapInArrow(batches, schema)


def hashed_embedding(dim: int = 64) -> Capability:
    """Deterministic unit vectors from the hashes of a text's tokens, for use without a model."""

    def load():
        import re
        import zlib

        import numpy as np

        def call(texts):
            out = []
            for t in texts:
                v = np.zeros(dim)
                for w in re.findall(r"\w+", (t or "").lower()):
                    h = zlib.crc32(w.encode())
                    v[h % dim] += 1 if h & 1 << 31 else -1
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype("float32").tolist())
            return out

        return call

    return Capability("embedding", load, "array<float>")


def stopped_short(reason: str | None) -> bool:
    """Whether a service's reason for stopping says that the reply was cut off."""
    return any(x in str(reason or "").upper() for x in D.CUT_OFF)


def sound_reply(text: str | None, as_json: bool = False, least_words: int = 18) -> bool:
    """Whether a reply says something, doesn't loop, and (if long) ends where a sentence does; JSON only has to be there."""
    from tarn.operators.degenerate import loops

    text = (text or "").strip()
    if as_json or not text:
        return bool(text)
    return not loops(text) and (len(text.split()) < least_words or text[-1] in D.CLOSING_MARKS)


def first_of(name: str, providers: list[Capability], sound: Callable[[str | None], bool] = sound_reply) -> Capability:
    """The first provider's answer that is sound; a provider that fails or answers badly hands its inputs to the next."""
    ready = [p for p in providers if p.load is not None]

    def load():
        calls = [p.load() for p in ready]

        def call(inputs):
            out, left, last = [None] * len(inputs), list(range(len(inputs))), None
            for f in calls:
                if not left:
                    break
                try:
                    got = f([inputs[i] for i in left])
                except Exception as e:  # noqa: BLE001  what a provider raises is not known here
                    last = e
                    continue
                for i, g in zip(left, got):
                    out[i] = g if sound(g) else None
                left = [i for i in left if out[i] is None]
            if last is not None and len(left) == len(inputs):
                raise last
            return out

        return call

    return Capability(name, load if ready else None)
