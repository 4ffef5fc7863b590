"""URL filter: fixed rules, and path templates judged by their labels. DataFrame functions only.

Each host has a tree of path segments. From the root down, a branch stays literal if its share of labelled blocks differs
from that of its labelled siblings (two-proportion z test), however small it is, or if it does so on ``min_hosts`` other
hosts. Of the others, segments of fewer than ``min_urls`` urls are variable and merge into one wildcard ``*``. Larger ones with labels that don't differ merge into
``+`` (a single one stays literal); larger ones without labels stay literal, as nothing says that they are like others.

A template is rejected if the share of blocks among its labelled urls is above ``reject``, after smoothing towards the
share of the same template over all hosts, which in turn is smoothed towards the share of all labelled urls.

Labels are given, or else the verdicts of the fixed rules. The longest rule that fits decides before any template.

Edge cases: a null url, or one without ``://``, has empty host and path; urls of equal path count together; repeated
rows each return a row; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, table

#: (rule, verdict): host, slash, start of the path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


@dataclass(frozen=True)
class Templates:
    depth: int = 4  # segments; what lies deeper belongs to the last
    min_urls: int = 8
    min_hosts: int = 2
    z: float = 1.96
    prior: float = 4.0  # weight of the share over all hosts, in labelled urls
    reject: float = 0.75


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does. Rules are a short list of the caller's."""
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        h, _, p = rule.partition("/")
        fit = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        fits.append((fit, rule, verdict))
    pick = lambda i: F.coalesce(*[F.when(x[0], F.lit(x[i])) for x in fits]) if fits else F.lit(None).cast("string")
    return pick(1), pick(2)


def templates(urls: DataFrame, config: Templates = Templates()) -> DataFrame:
    """(host, key, template, labelled, blocked) of each distinct path; ``urls`` has host, key (its segments) and label."""
    tree = saved(
        urls.groupBy("host", "key").agg(
            F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).cast("double").alias("blocked")
        ).withColumn("template", F.lit(""))
    )
    for level in range(config.depth):
        rows = tree.withColumn("seg", F.get(F.split("key", "/", config.depth), F.lit(level)))
        if level:
            rows = rows.withColumn("seg", F.when(F.col("seg") != "", F.col("seg")))
        else:
            rows = rows.withColumn("seg", F.when(F.col("key") != "", F.col("seg")))
        child = rows.where("seg is not null").groupBy("host", "template", "seg").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
        child = saved(child)
        large = F.col("n") >= config.min_urls
        labelled_large = F.sum((large & (F.col("labelled") > 0)).cast("long")).alias("p_large")
        parent = child.groupBy("host", "template").agg(*[F.sum(c).alias(f"p_{c}") for c in ("labelled", "blocked")], labelled_large)
        parent = saved(parent)  # so that Spark can split a host with many branches in the join
        # the parent without the child: the branches that the child is held against
        other_n, other_b = F.col("p_labelled") - F.col("labelled"), F.col("p_blocked") - F.col("blocked")
        pooled = F.col("p_blocked") / F.col("p_labelled")
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / other_n))
        z = F.abs(F.col("blocked") / F.col("labelled") - other_b / other_n) / error
        differs = F.when((F.col("labelled") > 0) & (other_n > 0) & (F.col("p_blocked") > 0) & (F.col("p_blocked") < F.col("p_labelled")), z > config.z).otherwise(F.lit(False))
        step = F.when(differs, F.col("seg")).when(~large, F.lit("*")).when((F.col("labelled") == 0) | (F.col("p_large") == 1), F.col("seg")).otherwise(F.lit("+"))
        # few of many variable segments are in here: all without a step become wildcards
        apart = child.where(large | (F.col("labelled") > 0)).join(parent, ["host", "template"]).withColumn("differs", differs).withColumn("step", step)
        apart = saved(apart.where("step <> '*'").select("host", "template", "seg", "step", "differs"))
        common = saved(apart.where("differs").groupBy("template", "seg").count().where(F.col("count") >= config.min_hosts).select("template", "seg"))
        named = child.join(common, ["template", "seg"], "left_semi").select("host", "template", "seg", F.col("seg").alias("step"))
        steps = saved(apart.drop("differs").join(common, ["template", "seg"], "left_anti").unionByName(named))
        tree = rows.join(steps, ["host", "template", "seg"], "left").select(
            "host", "key", "n", "labelled", "blocked",
            F.when(F.col("seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.coalesce("step", F.lit("*")))).alias("template"),
        )
    return tree


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", label_col: str | None = None, rules=RULES, config: Templates = Templates()) -> DataFrame:
    """For each row: page_id, host, path, rule, verdict, template and purity.

    ``label_col``: 1 block, 0 allow, null unknown; without it, the rules' verdicts are the labels.
    """
    host, path = host_and_path(F.col(url_col))
    own = F.col(label_col).cast("int") if label_col else F.lit(None).cast("int")
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), own.alias("label"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    key = F.array_join(F.filter(F.split("path", "/"), lambda s: s != ""), "/")
    base = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "label", key.alias("key"))
    if not label_col:
        base = base.withColumn("label", F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("int")))
    base = saved(base)
    tree = saved(templates(base.select("host", "key", "label"), config))
    sums = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    share = tree.agg(F.coalesce(F.sum("blocked") / F.sum("labelled"), F.lit(0.0)).alias("share"))
    # one row, by construction
    shrunk = lambda mean: (F.col("blocked") + config.prior * F.col(mean)) / (F.col("labelled") + config.prior)
    everywhere = sums.groupBy("template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    everywhere = saved(everywhere.join(F.broadcast(share)).select("template", shrunk("share").alias("mean")))
    judged = sums.join(everywhere, "template").select("host", "template", shrunk("mean").alias("purity"))
    of_path = saved(tree.select("host", "key", "template").join(judged, ["host", "template"]))
    return base.join(of_path, ["host", "key"]).select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("purity") > config.reject, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template", F.round("purity", 6).alias("purity"),
    )


def _sql(rules=RULES, c: Templates = Templates()) -> str:
    """The same judgement in DuckDB's SQL: a few common table expressions for each level of the tree."""
    cases = {"rule": "", "verdict": ""}
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        h, _, p = rule.partition("/")
        for what, value in (("rule", rule), ("verdict", verdict)):
            cases[what] += f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{value}'"
    parts = [
        "u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        "x AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u)",
        f"y AS (SELECT page_id, translate(raw, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM x)",
        f"b AS (SELECT *, CASE {cases['rule']} END AS rule, CASE {cases['verdict']} END AS ruled, array_to_string(list_filter(string_split(path, '/'), lambda s: s <> ''), '/') AS key FROM y)",
        "t0 AS (SELECT host, key, count(*)::DOUBLE AS n, count(ruled)::DOUBLE AS labelled, (count(*) FILTER (WHERE ruled = 'block'))::DOUBLE AS blocked, '' AS template FROM b GROUP BY host, key)",
    ]
    for k in range(c.depth):
        last = k == c.depth - 1
        seg = f"array_to_string(string_split(key, '/')[{k + 1}:], '/')" if last else f"string_split(key, '/')[{k + 1}]"
        parts += [
            f"r{k} AS (SELECT *, nullif({seg}, '') AS seg FROM t{k})",
            f"c{k} AS (SELECT host, template, seg, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked FROM r{k} WHERE seg IS NOT NULL GROUP BY ALL)",
            f"p{k} AS (SELECT host, template, sum(labelled) AS pl, sum(blocked) AS pb, count_if(n >= {c.min_urls} AND labelled > 0) AS big FROM c{k} GROUP BY ALL)",
            f"d{k} AS (SELECT *, CASE WHEN labelled > 0 AND pl > labelled AND pb > 0 AND pb < pl "
            f"THEN abs(blocked / labelled - (pb - blocked) / (pl - labelled)) / sqrt(pb / pl * (1 - pb / pl) * (1 / labelled + 1 / (pl - labelled))) > {c.z} ELSE false END AS differs "
            f"FROM c{k} JOIN p{k} USING (host, template))",
            f"l{k} AS (SELECT host, template, seg, CASE WHEN differs OR (template, seg) IN (SELECT (template, seg) FROM d{k} WHERE differs GROUP BY template, seg HAVING count(*) >= {c.min_hosts}) THEN seg "
            f"WHEN n < {c.min_urls} THEN '*' WHEN labelled = 0 OR big = 1 THEN seg ELSE '+' END AS step FROM d{k})",
            f"t{k + 1} AS (SELECT r.host, key, n, labelled, blocked, CASE WHEN r.seg IS NULL THEN r.template ELSE r.template || '/' || step END AS template FROM r{k} r LEFT JOIN l{k} l ON r.host = l.host AND r.template = l.template AND r.seg = l.seg)",
        ]
    parts += [
        f"s AS (SELECT host, template, sum(labelled) AS labelled, sum(blocked) AS blocked FROM t{c.depth} GROUP BY ALL)",
        f"g AS (SELECT coalesce(sum(blocked) / nullif(sum(labelled), 0), 0) AS share FROM t{c.depth})",
        f"e AS (SELECT template, (sum(blocked) + {c.prior} * any_value(share)) / (sum(labelled) + {c.prior}) AS mean FROM s, g GROUP BY template)",
        f"j AS (SELECT host, template, (blocked + {c.prior} * mean) / (labelled + {c.prior}) AS purity FROM s JOIN e USING (template))",
    ]
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT page_id, b.host, path, rule, coalesce(ruled, CASE WHEN purity > {c.reject} THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6) AS purity"
        f" FROM b JOIN t{c.depth} USING (host, key) JOIN j USING (host, template)"
    )


def op4_url_filter(spark, sf_dir):
    """Verdicts of every url of pages."""
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {"op4_url_filter": op4_url_filter}
ORACLES = {"op4_url_filter": _sql()}
