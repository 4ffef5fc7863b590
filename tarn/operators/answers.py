"""From questions to answers: guard, route, retrieve, assemble, answer without a model where one isn't needed, guard again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn import dictionaries as D
from tarn.config import Settings
from tarn.functions import text as X
from tarn.operators import retrieval as R
from tarn.operators import routing as N
from tarn.sources.capabilities import Capability, apply
from tarn.sources.files import stored


def compact(c: Column, most: int = 850) -> Column:
    """A text of at most ``most`` characters, cut at the last blank, with an ellipsis where something was cut."""
    cut = F.regexp_extract(F.substring(c, 1, most + 1), f"(?s)^(.{{0,{most}}})[ \\n]", 1)
    return F.when(F.length(c) > most, F.concat(F.when(cut != "", cut).otherwise(F.substring(c, 1, most)), F.lit("…"))).otherwise(c)


def prepared(queries: DataFrame, id_col: str, text_col: str, s: Settings = Settings()) -> DataFrame:
    """(query_id, query, script, injected, needs_*, is_off_topic, crops, branches) of each question."""
    clean = X.sanitize(F.col(text_col), s.max_input)
    base = queries.select(F.col(id_col).alias("query_id"), clean.alias("query"))
    routed = base.select("*", X.script_of(F.col("query")).alias("script"), X.injection(F.col("query")).isNotNull().alias("injected"), N.route(F.col("query")).alias("r"))
    return routed.select("query_id", "query", "script", "injected", "r.*").withColumn(
        "branches", F.when(F.col("is_off_topic"), F.array().cast("array<string>")).otherwise(N.branches(F.col("needs_rag"), F.col("needs_weather"), F.col("needs_price")))
    )


def contexts(questions: DataFrame, docs: DataFrame, source: str, s: Settings = Settings(), first: int = 3, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, context, citations) of the questions that need retrieval; suspicious documents are no context.

    By words, or by words and ``vectors`` fused: those of questions (query_id, embedding) and of documents (vec_id, embedding).
    """
    asked = questions.where("needs_rag").select(F.col("query_id").alias("item_id"), F.col("query").alias("text"))
    safe = docs.where(X.injection(F.col("text")).isNull())
    hits = R.bm25_of_many(asked, safe, first if vectors is None else s.pool, s)
    if vectors is not None:
        near = vectors[1].join(safe.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
        mine = vectors[0].join(questions.where("needs_rag").select("query_id"), "query_id", "left_semi")
        hits = R.fuse(R.vector_top(mine, near, s.pool), hits, first, s.rrf_k)
    hits = hits.where(F.col("rank") <= first).select("query_id", "doc_id", "rank")
    body = safe.select("doc_id", F.col(source).alias("source"), compact(F.col("text")).alias("cut"))
    rows = hits.join(body, "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "cut"))).alias("h"))
    line = lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["source"], F.lit(": "), x["cut"])
    return rows.select("query_id", F.array_join(F.transform("h", line), "\n").alias("context"), F.array_distinct("h.source").alias("citations"))


def price_answer(prices: DataFrame, labels: dict[str, str] = D.CROP_LABELS) -> DataFrame:
    """(query_id, price_answer) from (query_id, crop, price_range, unit): one line a crop, the first of repeated ones."""
    once = N.first_of_each(prices, ["query_id", "crop"], ["price_range", "unit"])
    label = F.coalesce(*[F.when(F.col("crop") == k, F.lit(v)) for k, v in labels.items()], F.col("crop"))
    line = F.concat(label, F.lit(": "), "price_range", F.lit(" ("), "unit", F.lit(")"))
    return once.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("price_answer"))


def answered(questions: DataFrame, context: DataFrame, prices: DataFrame | None, model: Capability = Capability("language model"), none: str = "No information.", concise: str = "Answer in three to five short sentences, and finish the last one.") -> DataFrame:
    """Questions with answer and method.

    Price-only questions never meet the model; those that do are filtered first, as Spark evaluates Python for all rows.
    A reply that was cut off is asked for once more, with ``concise`` after the question. Where the model then has no
    answer, or a looping or cut-off one, the first context line stands in.
    """
    q = questions.join(context, "query_id", "left")
    q = q.join(prices, "query_id", "left") if prices is not None else q.withColumn("price_answer", F.lit(None).cast("string"))
    short = F.col("price_answer").isNotNull() & ~F.col("needs_rag") & ~F.col("needs_weather")
    cheap = q.where(F.col("is_off_topic") | short).select("query_id", F.coalesce("price_answer", F.lit(none)).alias("answer"), F.when(F.col("is_off_topic"), F.lit("off_topic")).otherwise(F.lit("price")).alias("method"))
    rest = q.where(~F.col("is_off_topic") & ~F.coalesce(short, F.lit(False)))
    fallback = F.coalesce(F.get(F.split("context", "\n"), F.lit(0)), F.lit(none))
    if model.load is None:
        full = rest.select("query_id", fallback.alias("answer"), F.lit("fallback").alias("method"))
        return _guarded(cheap.unionByName(full))
    prompt = F.concat(F.coalesce("context", F.lit("")), F.lit("\n\n"), "query")
    told = _replies(rest.select("query_id", fallback.alias("fallback"), prompt.alias("prompt")), model)
    again = told.where("cut").select("query_id", "fallback", F.concat("prompt", F.lit("\n\n" + concise)).alias("prompt"))
    told = told.where("not cut").withColumn("by", F.lit("model")).unionByName(_replies(again, model).withColumn("by", F.lit("retry")))
    full = told.select("query_id", F.when(F.col("good"), F.col("reply")).otherwise(F.col("fallback")).alias("answer"), F.when(F.col("good"), F.col("by")).otherwise(F.lit("fallback")).alias("method"))
    return _guarded(cheap.unionByName(full))


def _replies(rows: DataFrame, model: Capability) -> DataFrame:
    """Rows (query_id, fallback, prompt) with reply, whether it is good, and whether it was cut off; written, so that no model is
    asked twice for the same."""
    from tarn.operators.degenerate import flagged

    told = stored(apply(rows, "prompt", model, "reply"))
    bad = flagged(told.select("query_id", "reply"), "query_id", "reply").withColumnRenamed("doc_id", "query_id")
    met = told.join(bad, "query_id", "left")
    short = F.coalesce(X.looks_incomplete(F.col("reply")), F.lit(False)) | F.coalesce(F.col("reply_error").rlike("(?i)truncat|token.?limit|max.?tokens|length"), F.lit(False))
    good = F.col("reply").isNotNull() & ~F.coalesce("degenerate", F.lit(False)) & ~short
    return met.select("query_id", "fallback", "prompt", "reply", good.alias("good"), short.alias("cut"))


def _guarded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("answer", X.strip_sources(X.strip_garbage(F.col("answer"))))


def names_another_crop(answer: Column, crop: Column, table: dict[str, str] = D.CROPS) -> Column:
    """Whether an answer names a crop other than the predicted one, and not that one."""
    named = N.crops(answer, table)
    return crop.isNotNull() & (F.size(named) > 0) & ~F.array_contains(named, crop)


def normalized(rows: DataFrame, text: str, model: Capability = Capability("transliteration"), least: float = 0.7) -> DataFrame:
    """Rows with script, normalized, method and warning.

    Texts of the script itself (or without letters) pass; others are the model's to write in it, and its answer counts only
    if enough of it is of the script. Without one the text stays, with a warning.
    """
    t = X.strip(F.coalesce(F.col(text), F.lit("")))
    base = rows.withColumn("__t", t).withColumn("script", X.script_of(t))
    passes = F.col("script").isin("bangla", "unknown")
    kept = base.where(passes).select(*rows.columns, "script", F.col("__t").alias("normalized"), F.lit("passthrough").alias("method"), F.lit(None).cast("string").alias("warning"))
    told = apply(base.where(~passes), "__t", model, "__r")
    answer = X.strip(F.regexp_replace(X.strip(F.col("__r")), "^\"+|\"+$", ""))
    good = F.coalesce((answer != "") & (X.script_ratio(answer, D.BANGLA, X.QUERY_CHARS) >= least), F.lit(False))
    why = F.when(~good, F.coalesce(F.col("__r_error"), F.lit("the answer is not of the script")))
    rest = told.select(*rows.columns, "script", F.when(good, answer).otherwise(F.col("__t")).alias("normalized"), F.when(good, F.lit("model")).otherwise(F.lit("fallback")).alias("method"), why.alias("warning"))
    return kept.unionByName(rest)


def image_contexts(detections: DataFrame, hits: DataFrame, docs: DataFrame, source_terms: dict[str, tuple[str, ...]], text_terms: dict[str, tuple[str, ...]], k: int = 5) -> DataFrame:
    """(image, doc_id, source, scope, place) from each image's surest detection and what its class's query retrieved.

    ``detections``: image, class_name, confidence; ``hits``: class_name, doc_id, rank (eight or so); ``docs``: doc_id, source,
    text. Suspicious documents are left out, and so is what names another crop: by source, else by text, else nothing stays.
    """
    from tarn.operators import detection as V

    best = V.with_class(V.top_detection(detections, "image", "confidence", "class_name"), "class_name").select(F.col("image").alias("query_id"), "class_name")
    best = best.withColumn("crop_key", N.crop_key(F.col("class_name"), text_terms))
    safe = docs.where(X.injection(F.col("text")).isNull())
    met = best.join(hits, "class_name").join(safe, "doc_id")
    fits = lambda c, terms: F.coalesce(*[F.when(F.col("crop_key") == key, F.exists(F.array(*[F.lit(t.lower()) for t in ts]), lambda t: F.contains(F.lower(c), t))) for key, ts in terms.items()], F.lit(False))
    scoped = N.scoped(met, fits(F.col("source"), source_terms), fits(F.col("text"), text_terms), k, unscoped=False)
    return scoped.select(F.col("query_id").alias("image"), "doc_id", "source", "scope", "place")
