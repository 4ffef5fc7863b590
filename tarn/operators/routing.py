"""Intent routing by keywords, branch selection, alias lookups, crop scoping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn import dictionaries as D
from tarn.functions.text import without_fences
from tarn.sources.capabilities import Capability, apply

_BLANKS = "[ \\t\\n\\x0B\\f\\r]+"


def _flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _BLANKS, " "))


def is_greeting(c: Column, words: str = D.GREETINGS) -> Column:
    """Nothing but greetings, thanks or farewells.

    The repeated group is possessive: Java matches it in a loop, while others recurse once for each word of a long text.
    """
    return F.concat(_flat(c), F.lit(" ")).rlike(f"(?i)^(?:(?:{words})[ ,!.?।]+)++$")


def crops(c: Column, table: dict[str, str] = D.CROPS) -> Column:
    """All crops named, in the table's order."""
    return F.array_compact(F.array(*[F.when(c.rlike("(?i)" + p), F.lit(k)) for k, p in table.items()]))


def is_unclear(c: Column, weather: str = D.WEATHER, price: str = D.PRICE, advice: str = D.ADVICE, table: dict[str, str] = D.CROPS) -> Column:
    """A short text without any keyword, of Latin letters only or of at most 40 Bangla characters."""
    t = _flat(c)
    known = t.rlike(f"(?i){weather}|{price}|{advice}|" + "|".join(table.values()))
    # blanks are single here, and at no end; no group repeats, which would recurse once for each word of a long text
    shape = t.rlike("^[A-Za-z ]+$") | (t.rlike(f"^[{D.BANGLA} ,!.?।]+$") & (F.length(t) <= 40))
    short = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) <= 5
    return (t != "") & short & shape & ~is_greeting(c) & ~known


def route(c: Column, weather: str = D.WEATHER, price: str = D.PRICE, advice: str = D.ADVICE) -> Column:
    """STRUCT<needs_rag, needs_weather, needs_price, is_off_topic, crops> by keywords."""
    c = F.coalesce(c, F.lit(""))
    w, p, a = (c.rlike("(?i)" + x) for x in (weather, price, advice))
    off = is_greeting(c) | is_unclear(c, weather, price, advice)
    return F.struct(
        (~off & (a | ~(w | p))).alias("needs_rag"),
        (~off & w).alias("needs_weather"),
        (~off & p).alias("needs_price"),
        off.alias("is_off_topic"),
        F.when(~off & p, crops(c)).otherwise(F.array().cast("array<string>")).alias("crops"),
    )


def merged(decision: Column, reply: Column) -> Column:
    """A decision of a model's JSON reply where it parses and is complete, else the one by keywords."""
    got = F.from_json(without_fences(reply), "needs_rag boolean, needs_weather boolean, needs_price boolean")
    whole = got["needs_rag"].isNotNull() & got["needs_weather"].isNotNull() & got["needs_price"].isNotNull()
    pick = lambda n: F.when(whole & ~decision["is_off_topic"], got[n]).otherwise(decision[n]).alias(n)
    return F.struct(pick("needs_rag"), pick("needs_weather"), pick("needs_price"), decision["is_off_topic"].alias("is_off_topic"), decision["crops"].alias("crops"))


def branches(needs_rag: Column, needs_weather: Column, needs_price: Column) -> Column:
    """Names of the branches to run; rag if none."""
    a = F.array_compact(F.array(F.when(needs_rag, F.lit("rag")), F.when(needs_weather, F.lit("weather")), F.when(needs_price, F.lit("price"))))
    return F.when(F.size(a) == 0, F.array(F.lit("rag"))).otherwise(a)


def longest_alias(c: Column, aliases: dict[str, str]) -> Column:
    """What the longest alias in the text stands for; null if there is none. For tables of a caller's few aliases."""
    low = F.lower(c)
    return F.coalesce(*[F.when(F.contains(low, F.lit(k.lower())), F.lit(v)) for k, v in sorted(aliases.items(), key=lambda x: (-len(x[0]), x[0]))])


def canonical(rows: DataFrame, column: str, aliases: DataFrame, to: str = "canonical", default: str | None = None) -> DataFrame:
    """Rows with the canonical name of a column's alias; unknown names pass through, none at all is ``default`` if one is given."""
    a = aliases.select(F.lower("alias").alias("__a"), F.col("canonical").alias("__c"))
    name = F.col(column) if default is None else F.coalesce(F.when(F.trim(F.col(column)) != "", F.col(column)), F.lit(default))
    return rows.join(a, F.lower(name) == F.col("__a"), "left").withColumn(to, F.coalesce("__c", name)).drop("__a", "__c")


def scoped(ranked: DataFrame, by_source: Column, by_text: Column, k: int, unscoped: bool = True) -> DataFrame:
    """Of each query's ranked rows, those whose source fits; if none does, whose text fits; else (``unscoped``) all; k at most."""
    q = Window.partitionBy("query_id")
    flagged = ranked.withColumn("__s", F.coalesce(by_source, F.lit(False))).withColumn("__t", F.coalesce(by_text, F.lit(False)))
    flagged = flagged.withColumn("__any_s", F.bool_or("__s").over(q)).withColumn("__any_t", F.bool_or("__t").over(q))
    keep = F.when(F.col("__any_s"), F.col("__s")).when(F.col("__any_t"), F.col("__t")).otherwise(F.lit(unscoped))
    scope = F.when(F.col("__any_s"), F.lit("source")).when(F.col("__any_t"), F.lit("text")).otherwise(F.lit("none"))
    kept = flagged.where(keep).withColumn("scope", scope).drop("__s", "__t", "__any_s", "__any_t")
    return kept.withColumn("place", F.row_number().over(q.orderBy("rank"))).where(F.col("place") <= k)


def first_of_each(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """Distinct keys with their first row in order (what dropDuplicates doesn't promise)."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def crop_key(c: Column, terms: dict[str, tuple[str, ...]]) -> Column:
    """The first crop of which a text (a query, or a class's name) holds a term; empty if there is none."""
    low = F.lower(c)
    return F.coalesce(*[F.when(F.contains(low, F.lit(t.lower())), F.lit(k)) for k, ts in terms.items() for t in ts], F.lit(""))


def routed(rows: DataFrame, text: str, model: Capability, locations: dict[str, str] = D.DIVISIONS, attempts: int = 2) -> DataFrame:
    """Rows with route (needs_*, is_off_topic, crops), location and source: ``model`` or ``keywords``.

    Off-topic turns never meet the model. A reply that doesn't parse or isn't complete is asked for again, ``attempts`` times
    in all; then keywords decide. Crops and places that the text names override the reply's.
    """
    base = rows.withColumn("__d", route(F.col(text))).withColumn("__reply", F.lit(None).cast("string"))
    shape = "needs_rag boolean, needs_weather boolean, needs_price boolean, location string, crop string, crops array<string>"
    got = F.from_json(without_fences(F.col("__reply")), shape)
    whole = F.coalesce(got["needs_rag"].isNotNull() & got["needs_weather"].isNotNull() & got["needs_price"].isNotNull(), F.lit(False))
    if model.load is not None:
        for _ in range(attempts):
            again = ~whole & ~F.col("__d.is_off_topic")
            told = apply(base.where(again).drop("__reply"), text, model, "__reply").drop("__reply_available", "__reply_error")
            base = base.where(~again).unionByName(told)
    d = F.col("__d")
    named = F.when(d["needs_price"] | F.coalesce(F.col(text), F.lit("")).rlike("(?i)" + D.PRICE), crops(F.col(text))).otherwise(F.array().cast("array<string>"))
    explicit = F.size(named) > 0
    theirs = F.coalesce(got["crops"], F.when(got["crop"].isNotNull(), F.array(got["crop"])), F.array().cast("array<string>"))
    pick = lambda n: F.when(whole, got[n]).otherwise(d[n])
    out = F.struct(
        pick("needs_rag").alias("needs_rag"), pick("needs_weather").alias("needs_weather"), (pick("needs_price") | (whole & explicit)).alias("needs_price"),
        d["is_off_topic"].alias("is_off_topic"), F.when(whole, F.when(explicit, named).otherwise(theirs)).otherwise(d["crops"]).alias("crops"),
    )
    place = F.coalesce(longest_alias(F.col(text), locations), F.when(whole, got["location"]))
    return base.select(*rows.columns, out.alias("route"), place.alias("location"), F.when(whole, F.lit("model")).otherwise(F.lit("keywords")).alias("source"))
