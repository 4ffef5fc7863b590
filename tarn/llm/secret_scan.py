"""Secret scan: fixed patterns, and windows of high Shannon entropy.

Candidate strings (long runs of the characters that keys are made of) are split into runs of one character class. Over
each, a window of fixed width slides by one character; the counts of its characters are updated by the one that leaves
and the one that enters, and so is the sum of count*log2(count) from which the entropy follows. The windows at or above
the class's limit make a span, unless the allow-list suppresses the candidate.

Edge cases: a null or empty text has no spans; texts are scanned whole; repeated rows each return a row; an empty table
gives an empty result; only the named columns are read, so further columns never clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_names, table

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
#: Runs are maximal, so a minimum length in the pattern drops the same matches as a test of their lengths afterwards.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HINTS = ("passw", "secret", "token", "api")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{24,}")


@dataclass(frozen=True)
class EntropyRules:
    """Width of the window, and the least entropy in bits a character for each class, tried in this order."""

    width: int = 20
    classes: tuple[tuple[str, str, float], ...] = (
        ("hex", r"[0-9a-fA-F]+", 3.0),
        ("alnum", r"[A-Za-z0-9]+", 3.7),
        ("base64", r"[A-Za-z0-9+/_=-]+", 3.9),
    )
    #: A candidate that one of these matches whole is no secret: words joined by marks, one case only, paths, numbers.
    allow: tuple[str, ...] = (
        r"[-_/=+]*(?:[A-Za-z][a-z]*[-_/=+]+)*(?:[A-Za-z][a-z]*)?",
        r"[-_/=+]*(?:[A-Z]+[-_/=+]+)*(?:[A-Z]+)?",
        r"[0-9]+(?:[-_/=+][0-9]+)*",
        r"[-+/_=]+",
        r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}",
        r"[A-Za-z]{0,40}(?:/[A-Za-z]{0,40}[0-9]{0,4})+/?",
    )


def entropy_windows(s: str, width: int) -> list[float]:
    """Shannon entropy, in bits, of each window of ``width`` characters, by incremental counts."""
    if len(s) < width:
        return []
    xlog = [0.0] + [k * math.log2(k) for k in range(1, width + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    out = []
    for i, c in enumerate(s):
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += xlog[k + 1] - xlog[k]
        if i >= width:
            left = s[i - width]
            k = counts[left]
            counts[left] = k - 1
            total += xlog[k - 1] - xlog[k]
        if i >= width - 1:
            out.append(math.log2(width) - total / width)
    return out


class Scanner:
    """Finds the spans of one text; built once for each task."""

    def __init__(self, rules: EntropyRules = EntropyRules()):
        self.rules = rules
        self.classes = [(name, re.compile(p), least) for name, p, least in rules.classes]
        self.allow = [re.compile(p) for p in rules.allow]

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the fixed patterns' matches, sorted."""
        found = []
        low = text.lower()
        if any(k in low for k in _HINTS):
            found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        return sorted(found)

    def entropic(self, text: str) -> list[tuple[int, int, int]]:
        found = []
        for m in _CANDIDATE.finditer(text):
            s = m[0]
            if any(p.fullmatch(s) for p in self.allow):
                continue
            taken: list[tuple[int, int]] = []
            for _, pattern, least in self.classes:
                for run in pattern.finditer(s):
                    start = end = -1
                    for i, h in enumerate(entropy_windows(run[0], self.rules.width)):
                        if h >= least:
                            if i > end:
                                if end > 0:
                                    taken.append((run.start() + start, run.start() + end))
                                start = i
                            end = i + self.rules.width
                    if end > 0:
                        taken.append((run.start() + start, run.start() + end))
            last = -1
            for a, b in sorted(taken):
                if a >= last:
                    found.append([m.start() + a, 3, m.start() + b])
                else:
                    found[-1][2] = max(found[-1][2], m.start() + b)
                last = max(last, b)
        return [tuple(x) for x in found]

    def scan(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """The base spans, and all spans: entropy adds what no base span covers."""
        if not text:
            return [], []
        base = self.base(text)
        more, i, covered = [], 0, 0
        for a, kind, b in self.entropic(text):
            # base spans up to this one's end, in step with the entropy's; ``covered`` is how far they reach
            while i < len(base) and base[i][0] < b:
                if a < base[i][0] and covered < base[i][0]:
                    more.append((max(a, covered), kind, base[i][0]))
                covered = max(covered, base[i][2])
                a = max(a, covered)
                i += 1
            if max(a, covered) < b:
                more.append((max(a, covered), kind, b))
        return base, sorted(base + more)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: EntropyRules = EntropyRules()) -> DataFrame:
    """For each document its counts by kind and its spans as an array of (kind, start, end), in code points."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def batches(it):
        scanner = Scanner(rules)
        for b in it:
            counts, shas, strings, spans = ([], [], []), [], [], []
            for t in b.column("text").to_pylist():
                base, every = scanner.scan(t)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                shas.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                strings.append(_joined(every))
                spans.append([{"kind": KINDS[k], "start": a, "end": e} for a, k, e in every])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()), pa.array(strings, pa.string()), pa.array(spans, span)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "span_list"],
            )

    of = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(
        batches,
        f"doc_id {of}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, span_list array<struct<kind:string,start:long,end:long>>",
    )


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", rules: EntropyRules = EntropyRules()) -> DataFrame:
    """The same rows and columns with every span of ``text_col`` replaced by ``mask``; other texts are left as they are."""
    columns = docs.columns
    at, docs = columns.index(text_col), plain_names(docs)

    def batches(it):
        scanner = Scanner(rules)
        for b in it:
            out = []
            for t in b.column(at).to_pylist():
                spans = scanner.scan(t)[1]
                if spans:
                    parts, last = [], 0
                    for a, _, e in spans:
                        if a >= last:
                            parts += [t[last:a], mask]
                        last = max(last, e)
                    t = "".join(parts) + t[last:]
                out.append(t)
            cols = list(b.columns)
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(batches, docs.schema).toDF(*columns)


def op6_secret_scan(spark, sf_dir):
    """Secrets in every whole text of documents."""
    return scan_documents(table(spark, sf_dir, "documents")).drop("span_list")


QUERIES = {"op6_secret_scan": op6_secret_scan}
