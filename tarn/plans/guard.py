"""Queries of routing and guardrails."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.operators import evaluation as E
from tarn.operators import routing as N

from .common import D, WS, class_of, q, strip_sql, t
from .registry import query

FLAT = f"trim(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g'))"
GREET = f"regexp_matches({FLAT}, {q(f'(?i)^(?:(?:{D.GREETINGS})[ ,!.?।]+)*(?:{D.GREETINGS})[ ,!.?।]*$')})"
KNOWN = q(f"(?i){D.WEATHER}|{D.PRICE}|{D.ADVICE}|" + "|".join(D.CROPS.values()))
UNCLEAR = f"""({FLAT} <> '' AND NOT {GREET} AND NOT regexp_matches({FLAT}, {KNOWN}) AND len(string_split({FLAT}, ' ')) <= 6
 AND (regexp_matches({FLAT}, '^[A-Za-z]+(?: [A-Za-z]+)*$') OR (regexp_matches({FLAT}, {q(f'^[{D.BANGLA} ,!.?।]+$')}) AND length({FLAT}) <= 40)))"""
TURNS = "conv_id, turn"


@query("greeting_filter", f"SELECT {TURNS}, {GREET} AS greeting FROM conversations")
def greeting_filter(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", N.is_greeting(F.col("text")).alias("greeting"))


@query("unclear_input", f"SELECT doc_id, {UNCLEAR} AS unclear FROM documents")
def unclear_input(spark, d):
    return t(spark, d, "documents").select("doc_id", N.is_unclear(F.col("text")).alias("unclear"))


CROP_LIST = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {q('(?i)' + p)}) THEN {q(k)} END" for k, p in D.CROPS.items()) + "], lambda x: x IS NOT NULL)"
ROUTE = f"""r AS (SELECT {TURNS}, ({GREET} OR {UNCLEAR}) AS off, regexp_matches(coalesce(text, ''), {q('(?i)' + D.WEATHER)}) AS w, regexp_matches(coalesce(text, ''), {q('(?i)' + D.PRICE)}) AS p,
 regexp_matches(coalesce(text, ''), {q('(?i)' + D.ADVICE)}) AS a, {CROP_LIST} AS crops FROM conversations),
f AS (SELECT {TURNS}, NOT off AND (a OR NOT (w OR p)) AS needs_rag, NOT off AND w AS needs_weather, NOT off AND p AS needs_price, off AS is_off_topic, array_to_string(CASE WHEN NOT off AND p THEN crops ELSE [] END, '+') AS crops FROM r),
b AS (SELECT *, CASE WHEN NOT needs_rag AND NOT needs_weather AND NOT needs_price THEN 'rag' ELSE array_to_string(list_filter([CASE WHEN needs_rag THEN 'rag' END, CASE WHEN needs_weather THEN 'weather' END, CASE WHEN needs_price THEN 'price' END], lambda x: x IS NOT NULL), '+') END AS branches FROM f)"""


def _routed(spark, d):
    got = t(spark, d, "conversations").select("conv_id", "turn", N.route(F.col("text")).alias("r")).select("conv_id", "turn", "r.*")
    got = got.withColumn("crops", F.array_join("crops", "+"))
    return got.withColumn("branches", F.array_join(N.branches(F.col("needs_rag"), F.col("needs_weather"), F.col("needs_price")), "+"))


@query("keyword_route", f"WITH {ROUTE} SELECT * FROM f")
def keyword_route(spark, d):
    """Intents and crops of each turn by keywords."""
    return _routed(spark, d).drop("branches")


@query("route_branches", f"WITH {ROUTE} SELECT {TURNS}, branches FROM b")
def route_branches(spark, d):
    return _routed(spark, d).select("conv_id", "turn", "branches")


@query("route_counts", f"WITH {ROUTE} SELECT branches, count(*)::BIGINT AS turns, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM b), 1) AS share FROM b GROUP BY branches")
def route_counts(spark, d):
    r = _routed(spark, d)
    total = r.agg(F.count("*").alias("n"))
    return r.groupBy("branches").agg(F.count("*").alias("turns")).join(F.broadcast(total)).select("branches", "turns", F.bround(F.lit(100.0) * F.col("turns") / F.col("n"), 1).alias("share"))


@query("route_accuracy", f"WITH {ROUTE}, x AS (SELECT branches, CASE WHEN role = 'user' THEN 'rag' ELSE 'price+rag' END AS expected FROM b JOIN conversations USING (conv_id, turn)) SELECT count(*)::BIGINT AS turns, count_if(list_sort(string_split(branches, '+')) = list_sort(string_split(expected, '+')))::BIGINT AS matched FROM x")
def route_accuracy(spark, d):
    """How often a route names the same branches as an expected one (here one for each role), in whatever order."""
    x = _routed(spark, d).join(t(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    expected = F.when(F.col("role") == "user", F.lit("rag")).otherwise(F.lit("price+rag"))
    return x.agg(F.count("*").alias("turns"), F.count_if(E.route_matches(expected, F.col("branches"))).alias("matched"))


CASES = "CASE " + " ".join(f"WHEN regexp_matches(text, {q('(?i)' + p)}) THEN {q(p)}" for p in D.INJECTIONS) + " END"


@query("injection_flag", f"SELECT doc_id, {CASES} AS reason FROM documents")
def injection_flag(spark, d):
    return t(spark, d, "documents").select("doc_id", X.injection(F.col("text")).alias("reason"))


@query("injection_filter", f"SELECT {TURNS}, role, length(text)::INTEGER AS chars FROM conversations WHERE ({CASES}) IS NULL")
def injection_filter(spark, d):
    return t(spark, d, "conversations").where(X.injection(F.col("text")).isNull()).select("conv_id", "turn", "role", F.length("text").alias("chars"))


CORE = f"regexp_replace(w, {q(f'^{X._MARK_CLASS}|{X._MARK_CLASS}$')}, '', 'g')"
GARBAGE = f"(length(w) >= 6 AND NOT regexp_matches({CORE}, {q(X.NUMERIC)}) AND NOT regexp_matches(w, {q(class_of(X.LETTER))}) AND len(regexp_extract_all(w, '\\p{{Nd}}')) >= 3 AND regexp_matches(w, '[()\\[\\]/:|]'))"
WORDS_OF = f"list_filter(regexp_split_to_array({{}}, '{WS}+'), lambda w: w <> '')"


@query("garbage_tokens", f"SELECT doc_id, len(list_filter({WORDS_OF.format('text')}, lambda w: {GARBAGE}))::INTEGER AS n_garbage FROM documents")
def garbage_tokens(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(F.filter(X.words(F.col("text")), lambda w: X.is_garbage(w))).alias("n_garbage"))


LINE = f"array_to_string(list_filter({WORDS_OF.format('x')}, lambda w: NOT {GARBAGE}), ' ')"


@query("strip_garbled", f"""WITH c AS (SELECT doc_id, text, len(list_filter({WORDS_OF.format('text')}, lambda w: {GARBAGE})) > 0 AS any_garbage, array_to_string(list_transform(string_split(text, '\n'), lambda x: {LINE}), '\n') AS cleaned FROM documents)
SELECT doc_id, sha256(CASE WHEN any_garbage AND regexp_replace(cleaned, '[ \\n]', '', 'g') <> '' THEN cleaned ELSE text END) AS sha FROM c""")
def strip_garbled(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2(X.strip_garbage(F.col("text")), 256).alias("sha"))


SOURCES = f"regexp_replace(text, {q(X.SOURCE_BLOCK)}, '')"
for _p in X.SOURCE_INLINE:
    SOURCES = f"regexp_replace({SOURCES}, {q(_p)}, '', 'g')"
SOURCES = strip_sql(f"regexp_replace(regexp_replace({SOURCES}, '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', '\n\n', 'g')")


@query("strip_sources", f"SELECT doc_id, sha256({SOURCES}) AS sha, length({SOURCES})::INTEGER AS chars FROM documents")
def strip_sources(spark, d):
    c = X.strip_sources(F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.sha2(c, 256).alias("sha"), F.length(c).alias("chars"))


@query("sanitize_input", f"SELECT {TURNS}, left({strip_sql(r'''regexp_replace(coalesce(text, ''), '[\x{0}-\x{8}\x{b}-\x{1f}\x{7f}-\x{a0}\x{ad}\x{2028}\x{2029}\x{2000}-\x{200b}\x{200e}\x{200f}\x{202a}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]', '', 'g')''')}, 1000) AS clean FROM conversations")
def sanitize_input(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", X.sanitize(F.col("text")).alias("clean"))


@query("incomplete_text", f"SELECT doc_id, len({WORDS_OF.format('text')}) >= 18 AND NOT regexp_matches({strip_sql('text')}, {q(chr(91) + '.!?।॥:;)' + chr(92) + ']}»”' + chr(34) + chr(39) + '’]$')}) AS incomplete FROM documents")
def incomplete_text(spark, d):
    return t(spark, d, "documents").select("doc_id", X.looks_incomplete(F.col("text")).alias("incomplete"))


@query("long_lines_repeat", f"""WITH l AS (SELECT doc_id, unnest(string_split(lower(text), '\n')) AS x FROM documents), m AS (SELECT doc_id, array_to_string({WORDS_OF.format('x')}, ' ') AS x, len({WORDS_OF.format('x')}) AS n FROM l),
r AS (SELECT doc_id FROM (SELECT doc_id, x FROM m WHERE n >= 8 GROUP BY ALL HAVING count(*) >= 3)) SELECT doc_id, doc_id IN (SELECT doc_id FROM r) AS repeats FROM documents""")
def long_lines_repeat(spark, d):
    return t(spark, d, "documents").select("doc_id", X.long_lines_repeat(F.col("text")).alias("repeats"))


@query("degenerate_output")
def degenerate_output(spark, d):
    """Texts that loop: a block of 6 to 24 words three times in a row, or a long line three times."""
    from tarn.operators.degenerate import flagged

    return flagged(t(spark, d, "documents"), "doc_id", "text")


OVER = (("certainly ([a-z]+)", "perhaps $1"), ("\\bthe\\b", "a"), ("([a-z]+)ing\\b", "$1in"))
NOTICE = "This may be wrong. "


@query("uncertainty_language", "WITH s AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'green' WHEN doc_id % 3 = 1 THEN 'amber' ELSE 'red' END AS tier, regexp_replace(regexp_replace(regexp_replace(text, 'certainly ([a-z]+)', 'perhaps \\1', 'g'), '\\bthe\\b', 'a', 'g'), '([a-z]+)ing\\b', '\\1in', 'g') AS soft FROM documents) "
       f"SELECT doc_id, tier, sha256(CASE WHEN tier = 'green' THEN text WHEN (contains(text, 'est') OR contains(text, '%')) AND soft = text THEN text ELSE {q(NOTICE)} || soft END) AS sha FROM s")
def uncertainty_language(spark, d):
    """Overclaims softened and a notice in front, by tier; with word lists that fit the tables' texts."""
    tier = F.when(F.col("doc_id") % 3 == 0, F.lit("green")).when(F.col("doc_id") % 3 == 1, F.lit("amber")).otherwise(F.lit("red"))
    docs = t(spark, d, "documents").withColumn("tier", tier)
    out = X.enforce_uncertainty(F.col("text"), F.col("tier"), NOTICE, ("est", "%"), OVER)
    return docs.select("doc_id", "tier", F.sha2(out, 256).alias("sha"))


ALIASES = {"the": "article", "then": "time", "thenth": "odd", "and": "conjunction", "de": "von", "der": "masculine", "des": "genitive", "que": "which"}
LONGEST = "CASE " + " ".join(f"WHEN contains(lower(text), {q(k)}) THEN {q(v)}" for k, v in sorted(ALIASES.items(), key=lambda x: (-len(x[0]), x[0]))) + " END"


@query("longest_alias", f"SELECT {TURNS}, {LONGEST} AS meaning FROM conversations")
def longest_alias(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", N.longest_alias(F.col("text"), ALIASES).alias("meaning"))


@query("alias_canonicalize", "WITH a AS (SELECT lower(n_name) AS alias, r_name AS canonical FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0) SELECT c_custkey, n_name, coalesce(canonical, n_name) AS canonical FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN a ON lower(n_name) = alias")
def alias_canonicalize(spark, d):
    """Names with their canonical one; names without an alias pass through."""
    nation = t(spark, d, "nation")
    aliases = nation.where("n_nationkey % 2 = 0").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("alias"), F.col("r_name").alias("canonical"))
    rows = t(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return N.canonical(rows, "n_name", aliases).select("c_custkey", "n_name", "canonical")


RATIO = f"len(regexp_extract_all({{c}}, '[{D.LATIN}]'))::DOUBLE / nullif(len(regexp_extract_all({{c}}, {q(class_of(X.LINE_CHARS))})), 0)"


@query("script_ratio", f"SELECT doc_id, round(coalesce({RATIO.replace('{c}', 'text')}, 0), 6) AS ratio FROM documents")
def script_ratio(spark, d):
    return t(spark, d, "documents").select("doc_id", F.round(X.script_ratio(F.col("text"), D.LATIN), 6).alias("ratio"))


@query("script_detect", f"""WITH n AS (SELECT doc_id, len(regexp_extract_all(text, {q(class_of(X.QUERY_CHARS))})) AS n, len(regexp_extract_all(text, '[{D.BANGLA}]')) AS b, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents)
SELECT doc_id, CASE WHEN n = 0 THEN 'unknown' WHEN b::DOUBLE / n >= 0.7 THEN 'bangla' WHEN l::DOUBLE / n >= 0.7 THEN 'latin' ELSE 'mixed' END AS script FROM n""")
def script_detect(spark, d):
    return t(spark, d, "documents").select("doc_id", X.script_of(F.col("text")).alias("script"))
