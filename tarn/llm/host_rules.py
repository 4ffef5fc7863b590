"""Quality rules judged by document and by host.

Every document is measured and held against the rules. The failures are then summed by host, each host's failure rate
is shrunk towards the rate of all hosts by a beta prior that is fitted to the hosts themselves, and the host's verdict
is joined back. A host is bad if its posterior lies clearly above the prior's mean, good if clearly below, else like most.
A document goes if it fails a hard rule. A soft rule failed is a point, and two if it is missed by more than twice its limit;
the host decides how many points are too many: one on a bad host, two on a host like most, none is on a good host. So a
document that fails no rule always stays.

Edge cases: a null or empty text has no words (it fails the word-count rule); documents without a host form one group
of their own, as null; an empty table gives an empty result; repeated rows each count and each return a row. Only the
named columns are read, so further columns never clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, plain_names, saved, table

#: Characters that the symbol rule counts.
SYMBOLS = "#*$%&|<>"

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. The first two are hard, the others soft.

    A host is bad if its shrunk rate is above ``bad_share`` of the prior's mean, and by ``deviations`` of the posterior's
    standard deviations above the mean itself; good likewise below. Hosts with fewer than ``min_host_documents`` are like most.
    """

    min_words: int = 50
    max_repeat_share: float = 0.5
    max_symbols_per_word: float = 0.1
    max_dup_line_share: float = 0.4
    mean_word_chars: tuple[float, float] = (2.5, 12.0)
    good_share: float = 0.8
    bad_share: float = 1.25
    deviations: float = 2.0
    min_host_documents: int = 5


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = WORD.findall(text)
    n = len(words)
    lines, seen, dup = 0, set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeated = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        once, twice = set(), set()
        if len(set(windows)) < len(windows):
            for x in windows:
                (twice if x in once else once).add(x)
            end = 0
            for i, x in enumerate(windows):
                if x in twice:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeated, lines


def document_measures(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the measures of each document's whole text."""
    chosen = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))

    def batches(it):
        for b in it:
            rows = [measure(t) for t in b.column("__text").to_pylist()]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in keep] + [pa.array(c, pa.int64()) for c in cols],
                names=[*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"],
            )

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(batches, f"{head}, {MEASURES}")


def with_failures(measures: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds base_failed (a hard rule), n_soft (points of soft ones) and rule_failed (any rule)."""
    n = F.col("n_words")
    low, high = rules.mean_word_chars
    base = (n < rules.min_words) | (F.col("n_repeat_words") > rules.max_repeat_share * n)
    soft = lambda k: [
        F.col("n_symbols") > k * rules.max_symbols_per_word * n,
        F.col("n_dup_lines") > k * rules.max_dup_line_share * F.col("n_lines"),
        (F.col("word_chars") < low / k * n) | (F.col("word_chars") > k * high * n),
    ]
    failed = measures.withColumn("base_failed", base).withColumn("n_soft", sum(x.cast("int") for x in [*soft(1), *soft(2)]))
    return failed.withColumn("rule_failed", base | (F.col("n_soft") > 0))


def _gone():
    """Whether a document goes, by its own failures and its host's verdict (host_tail: -1 good, 0 like most, 1 bad)."""
    tail = F.coalesce("host_tail", F.lit(0))
    return F.col("base_failed") | ((tail > 0) & (F.col("n_soft") >= 1)) | ((tail == 0) & (F.col("n_soft") >= 2))


def host_verdicts(judged: DataFrame, host_col: str, rules: Rules = Rules()) -> DataFrame:
    """A row for each host: documents, failures, shrunk failure rate and verdict.

    The prior's mean is the mean of the hosts' rates and its weight comes from their variance (method of moments): the
    less hosts differ, the more a host with few documents is drawn to the mean. Failures are summed before the shuffle.
    """
    hosts = judged.groupBy(F.col(host_col).alias("__host")).agg(
        F.count("*").alias("host_documents"), F.sum(F.col("rule_failed").cast("long")).alias("host_failures")
    )
    rate = F.col("host_failures") / F.col("host_documents")
    fit = hosts.agg(
        F.avg(rate).alias("__m"),
        F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("__v"),
        F.coalesce(F.avg(1.0 / F.col("host_documents")), F.lit(1.0)).alias("__inv"),
    )
    # variance of the rates = spread of the hosts + m(1-m)/n of their sampling
    mean = F.col("__m") * (1 - F.col("__m"))
    spread = F.greatest(F.col("__v") - mean * F.col("__inv"), F.lit(1e-6))
    weight = F.least(F.greatest(mean / spread - 1, F.lit(1.0)), F.lit(1e4))
    prior = fit.select(F.col("__m"), weight.alias("__w"))
    known = F.col("host_documents") >= rules.min_host_documents
    x, m = F.col("host_rate"), F.col("__m")
    far = rules.deviations * F.sqrt(x * (1 - x) / (F.col("host_documents") + F.col("__w") + 1))
    bad, good = (x > rules.bad_share * m) & (x - far > m), (x < rules.good_share * m) & (x + far < m)
    tail = F.when(known & bad, 1).when(known & good, -1).otherwise(0)
    # the prior is one row by construction, so this is no cross join of data
    return hosts.join(F.broadcast(prior)).select(
        "__host",
        "host_documents",
        "host_failures",
        ((F.col("host_failures") + F.col("__m") * F.col("__w")) / (F.col("host_documents") + F.col("__w"))).alias("host_rate"),
        F.col("__m"),
        F.col("__w"),
    ).select("__host", "host_documents", "host_failures", "host_rate", tail.alias("host_tail"))


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: Rules = Rules()) -> DataFrame:
    """Each document's columns ``keep``, its measures, the rules it fails, its host's rate and whether it is kept.

    Texts are read once and never shuffled: the measures go to a table in the shared folder, and only they meet the
    host verdicts.
    """
    chosen = docs.select(*[F.col(c) for c in keep], F.col(host_col).alias("__of"), F.col(text_col).alias("__body"))
    judged = saved(with_failures(document_measures(chosen, "__body", (*keep, "__of")), rules))
    hosts = host_verdicts(judged, "__of", rules)
    return judged.join(hosts, judged["__of"].eqNullSafe(hosts["__host"]), "left").withColumn("kept", ~_gone()).drop("__of", "__host")


def keep(docs: DataFrame, host_col: str = "source", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Texts are measured twice, first for the hosts' verdicts and then for their own, and never shuffled for a host table
    that Spark can broadcast.
    """
    columns, docs = docs.columns, plain_names(docs)
    slim = docs.select(F.col(host_col).alias("__of"), F.col(text_col).alias("__body"))
    hosts = saved(host_verdicts(with_failures(document_measures(slim, "__body", ("__of",)), rules), "__of", rules).select("__host", "host_tail"))
    row = docs.select(F.struct(*docs.columns).alias("__row"), F.col(host_col).alias("__of"), F.col(text_col).alias("__body"))
    judged = with_failures(document_measures(row, "__body", ("__row", "__of")), rules)
    met = judged.join(hosts, judged["__of"].eqNullSafe(hosts["__host"]), "left")
    return met.where(~_gone()).select("__row.*").toDF(*columns)


def op9_quality_rules(spark, sf_dir):
    """The measures and verdicts of every whole text of documents, by source."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate")
    )


_BLANK = "[ \\t\\n\x0b\\f\\r]"
SQL = f"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}+'), lambda x: x <> '') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_replace(l, '{_BLANK}', '', 'g') <> '') AS ls FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w WHERE len(ws) >= 3),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR n_repeat_words > 0.5 * n_words AS base_failed,
  (n_symbols > 0.1 * n_words)::INT + (n_dup_lines > 0.4 * n_lines)::INT + (word_chars < 2.5 * n_words OR word_chars > 12 * n_words)::INT
  + (n_symbols > 0.2 * n_words)::INT + (n_dup_lines > 0.8 * n_lines)::INT + (word_chars < 1.25 * n_words OR word_chars > 24 * n_words)::INT AS n_soft FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, count_if(base_failed OR n_soft > 0)::DOUBLE AS bad FROM f GROUP BY source),
a AS (SELECT avg(bad / n) AS m, var_pop(bad / n) AS v, avg(1 / n) AS inv FROM h),
p AS (SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * inv, 1e-6) - 1, 1), 1e4) AS weight FROM a),
q AS (SELECT source, n, (bad + m * weight) / (n + weight) AS host_rate, weight, m FROM h, p),
d AS (SELECT *, 2 * sqrt(host_rate * (1 - host_rate) / (n + weight + 1)) AS far FROM q),
v AS (SELECT source, host_rate, CASE WHEN n < 5 THEN 0 WHEN host_rate > 1.25 * m AND host_rate - far > m THEN 1 WHEN host_rate < 0.8 * m AND host_rate + far < m THEN -1 ELSE 0 END AS tail FROM d)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR (tail = 1 AND n_soft >= 1) OR (tail = 0 AND n_soft >= 2)) AS kept, round(host_rate, 6) AS host_rate
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES = {"op9_quality_rules": SQL}
