"""The whole way of a batch of queries: results known, guards, language, retrieval, route, answer, grounding, response."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import text as X
from textloom.operators import routing
from textloom.sources.store import staged

#: What a response holds beside query_id.
_TEXT, _FLAG = T.StringType(), T.BooleanType()
RESPONSE = T.StructType(
    [T.StructField(*f) for f in (
        ("answer", _TEXT), ("status", _TEXT), ("grounded", _FLAG), ("guardrail_status", _TEXT), ("guardrail_reason", _TEXT), ("route", _TEXT), ("confidence_decision", _TEXT), ("fallback_used", _FLAG),
        ("retrieval_route", _TEXT), ("num_results", T.IntegerType()), ("language", _TEXT), ("answer_language", _TEXT), ("translation_used", _FLAG),
        ("citations", T.ArrayType(T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("chunk_id", _TEXT), T.StructField("document_id", _TEXT), T.StructField("text", _TEXT), T.StructField("score", T.DoubleType())]))),
    )]
)
_REASONS = {"min_query_length": "Query is empty", "max_query_length": "Query exceeds maximum length", "prompt_injection": "Prompt injection pattern detected"}


def request_key(query: Column, language: Column, top_k: Column) -> Column:
    """What makes two requests the same."""
    return F.concat_ws(":", F.lower(F.trim(query)), language, F.coalesce(top_k, F.lit(0)).cast("string"))


def _generated(model: Callable[[list[str], list[str]], list[str | None]], query: Column, context: Column) -> Column:
    """A model's raw output, one call for each Arrow batch; null where there is none."""
    return F.pandas_udf(lambda q, c: pd.Series(model(q.tolist(), c.tolist()), dtype=object), "string")(query, context)


def answer_queries(
    queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], *, cache: DataFrame | None = None, local: Callable | None = None, remote: Callable | None = None,
    translations: DataFrame | None = None, thresholds: routing.Thresholds = routing.Thresholds(), max_length: int = 2000, top_k: int = 3,  # noqa: B008
) -> DataFrame:
    """One response (query_id and RESPONSE) for each query (query_id, query; perhaps language and top_k).

    1. A request that cache (request_key, response) has is answered from it; others are answered once for each key.
    2. Blank, overlong and injected queries are refused.
    3. retrieve(query_id, query, language) gives results: query_id, chunk_id, document_id, text, score, rank, route and,
       if it translates, translated. A query without results is refused.
    4. The best score and text choose the way: the text's own first sentences, where these hold up; else the local
       model; else the remote one. Models are functions of (questions, contexts), called on Arrow batches: the local
       gives text, the remote JSON as ``routing.parse_output`` reads it. An answer that fails its checks, and the local
       model's INSUFFICIENT_CONTEXT, fall through to the next.
    5. Where the remote model is needed and there is none, or its output is malformed, status is ``error``. An empty
       answer is refused. Else the query is answered; grounded tells if the answer shares enough words with its sources.

    translations (source, target, phrase, translation) turn direct answers back to the query's language.
    """
    columns = {c: (F.col(c) if c in queries.columns else F.lit(v).cast(t)) for c, v, t in (("language", "en", "string"), ("top_k", None, "int"))}
    asked = queries.select("query_id", "query", request_key(F.coalesce("query", F.lit("")), columns["language"], columns["top_k"]).alias("request_key"))
    known = asked.join(cache, "request_key") if cache is not None else None
    fresh = asked.join(cache, "request_key", "left_anti") if cache is not None else asked
    # one of the queries of each key stands for all
    each = fresh.groupBy("request_key").agg(F.min_by("query", "query_id").alias("query"), F.min("query_id").alias("query_id"))
    guard = X.input_guards(F.col("query"), 2, max_length)
    each = each.withColumn("rule", guard["rule"]).withColumn("detected", X.detect_language(F.col("query"))["code"])
    fits = each.filter("rule IS NULL")
    found = staged(retrieve(fits.select("query_id", "query", F.col("detected").alias("language"))).filter(F.col("rank") <= top_k), "found")
    if "translated" not in found.columns:
        found = found.withColumn("translated", F.lit(False))
    cited = F.struct(F.col("rank").cast("int").alias("rank"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("document_id").cast("string").alias("document_id"), F.substring("text", 1, 500).alias("text"), F.round("score", 6).alias("score"))
    best = found.groupBy("query_id").agg(
        F.max_by("score", -F.col("rank")).alias("score"), F.max_by("text", -F.col("rank")).alias("text"), F.max_by("route", -F.col("rank")).alias("retrieval_route"), F.max_by("translated", -F.col("rank")).alias("retried"),
        F.array_sort(F.collect_list(cited)).alias("citations"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ").alias("passages"),
    )
    met = each.join(best, "query_id", "left").join(routing.context(found, top_k), "query_id", "left")
    way = routing.decide_route(F.col("score"), thresholds, fast=F.col("retrieval_route") == "fast", text=F.col("text"))
    met = met.withColumn("way", F.when(F.col("score").isNotNull(), way))
    direct = X.extract_answer(X.bare(F.col("text")))
    direct = F.when((F.col("way") == routing.EXTRACTIVE) & X.grounded(direct, F.col("text")) & (F.trim(direct) != ""), direct)
    met = met.withColumn("direct", direct)
    failed = (F.col("way") == routing.EXTRACTIVE) & F.col("direct").isNull()
    met = met.withColumn("decision", F.when(failed, routing.LOCAL).otherwise(F.col("way"))).withColumn("fell", F.coalesce(failed, F.lit(False)))
    tried = F.col("direct").isNull() & F.col("decision").isin(routing.LOCAL, routing.UNCERTAIN)
    none = F.lit(None).cast("string")
    if local is not None:
        # the model reads only what reaches it
        said = met.filter(tried).select("query_id", F.trim(_generated(local, F.col("query"), F.col("context"))).alias("said"))
        met = met.join(said, "query_id", "left")
        good = ~F.contains(F.upper("said"), F.lit("INSUFFICIENT_CONTEXT")) & (F.col("said") != "") & (X.grounding(F.col("said"), F.col("passages")) >= 0.10)
        met = met.withColumn("local", F.when(F.coalesce(good, F.lit(False)), F.col("said"))).withColumn("fell", F.col("fell") | F.coalesce(tried & F.col("local").isNull(), F.lit(False))).drop("said")
    else:
        met = met.withColumn("local", none)
    open_ = F.col("decision").isNotNull() & F.col("direct").isNull() & F.col("local").isNull()
    if remote is not None:
        raw = met.filter(open_).select("query_id", "citations", _generated(remote, F.col("query"), F.col("context")).alias("raw"))
        numbered = lambda i: F.concat(F.lit("source-"), (i + 1).cast("string"))
        valid = F.transform("citations", lambda c, i: numbered(i))
        alias = F.flatten(F.transform("citations", lambda c, i: F.array(F.struct(c["chunk_id"].alias("k"), numbered(i).alias("v")), F.struct(c["document_id"].alias("k"), numbered(i).alias("v")))))
        alias = F.map_from_entries(F.filter(alias, lambda e, i: F.array_position(F.transform(alias, lambda x: x["k"]), e["k"]) == i + 1))
        met = met.join(raw.select("query_id", routing.parse_output(F.col("raw"), valid, alias)["answer"].alias("remote")), "query_id", "left")
    else:
        met = met.withColumn("remote", none)
    answer = F.coalesce("direct", "local", "remote")
    met = met.withColumn("made", answer)
    route = F.when(F.col("direct").isNotNull(), "extractive").when(F.col("local").isNotNull(), "local").when(open_, "groq")
    met = met.withColumn("via", route)
    status = F.when(F.col("rule").isNotNull() | F.col("score").isNull(), "refused").when(F.col("made").isNull(), "error").when(F.trim("made") == "", "refused").otherwise("answered")
    met = met.withColumn("status", status)
    done, sure = F.col("status") == "answered", F.coalesce(F.col("direct").isNotNull() | (X.grounding(F.col("made"), F.col("passages")) >= 0.10), F.lit(False))
    foreign = done & (F.col("via") == "extractive") & (F.col("detected") != "en")
    met = met.withColumn("source", F.lit("en"))
    if translations is not None:
        met = routing.translate(met, translations, "made", "source", "detected")
    shown = F.when(foreign, F.col("translated")).otherwise(F.col("made")) if translations is not None else F.col("made")
    guard_status = F.when(F.col("rule").isNotNull(), "blocked").when(F.col("score").isNull() | (F.trim("made") == ""), "low_confidence").when(F.col("status") == "error", "error").when(sure, "passed").otherwise("ungrounded")
    reasons = F.create_map(*[F.lit(x) for kv in _REASONS.items() for x in kv])
    reason = (
        F.when(F.col("rule").isNotNull(), F.try_element_at(reasons, F.col("rule"))).when(F.col("score").isNull(), "No relevant passages found").when(F.col("status") == "error", "Generation failed")
        .when(F.trim("made") == "", "Model declined to answer: insufficient context").when(~sure, "Insufficient source overlap")
    )
    decision = F.when(F.col("rule").isNotNull(), "INPUT_BLOCKED").when(F.col("score").isNull(), "NO_PASSAGES").otherwise(F.col("decision"))
    response = met.select("request_key", *[c.cast(RESPONSE[k].dataType).alias(k) for k, c in {
        "answer": F.when(done, shown), "status": F.col("status"), "grounded": done & sure, "guardrail_status": guard_status, "guardrail_reason": reason,
        "route": F.when(F.col("rule").isNull() & F.col("score").isNotNull(), F.col("via")), "confidence_decision": decision, "fallback_used": F.col("fell"),
        "retrieval_route": F.col("retrieval_route"), "num_results": F.coalesce(F.size("citations"), F.lit(0)), "language": F.col("detected"),
        "answer_language": F.when(done, F.when(foreign, F.col("detected")).otherwise("en")), "translation_used": F.coalesce("retried", F.lit(False)) | foreign,
        "citations": F.when(done, F.col("citations")).otherwise(F.array().cast(RESPONSE["citations"].dataType)),
    }.items()])
    out = fresh.select("query_id", "request_key").join(response, "request_key")
    if known is not None:
        again = known.select("query_id", "request_key", *[F.col(f"response.{f.name}").alias(f.name) for f in RESPONSE.fields])
        again = again.withColumns({"route": F.lit("cache"), "confidence_decision": F.lit("CACHE_HIT"), "fallback_used": F.lit(False)})
        out = out.unionByName(again)
    return out.select("query_id", *RESPONSE.names)


def cacheable(responses: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (request_key, response) of the responses worth keeping: answers, and refusals for want of confidence in what was found."""
    columns = {c: (F.col(c) if c in queries.columns else F.lit(v).cast(t)) for c, v, t in (("language", "en", "string"), ("top_k", None, "int"))}
    keyed = queries.select("query_id", request_key(F.coalesce("query", F.lit("")), columns["language"], columns["top_k"]).alias("request_key"))
    worth = (F.col("status") == "answered") | ((F.col("status") == "refused") & (F.col("num_results") > 0))
    return responses.filter(worth).join(keyed, "query_id").groupBy("request_key").agg(F.first(F.struct(*RESPONSE.names)).alias("response"))
