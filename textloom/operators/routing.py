"""What happens to a query's results: gates, routes, expansion, translation, context, output checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: how an answer is made, and why one is refused
EXTRACTIVE, LOCAL, UNCERTAIN, REMOTE = "EXTRACTIVE_ELIGIBLE", "LOCAL_ELIGIBLE", "LOCAL_UNCERTAIN", "GROQ_REQUIRED"
REFUSALS = (
    "A. input guardrail",
    "B. retrieval.found == false (no passages)",
    "C. output grounding",
    "D. low confidence / model refused",
    "E. other guardrail",
)
# ---


@dataclass(frozen=True)
class Thresholds:
    """Least scores for a direct answer and for the local model. Fused scores of the fast route have another scale than reranked ones."""

    extractive: float = 0.50
    local: float = 0.20
    fast_extractive: float = 0.015
    fast_local: float = 0.005
    extractive_enabled: bool = True


def decide_route(score: Column, t: Thresholds = Thresholds(), *, fast: Column | None = None, text: Column | None = None) -> Column:  # noqa: B008
    """How an answer is made from the best result's score: from its text, by the local model, or by the remote one.

    No result (a null score), or a score below 0, needs the remote model; a blank text can't answer directly.
    """
    quick = F.lit(False) if fast is None else F.coalesce(fast, F.lit(False))
    least = lambda a, b: F.when(quick, F.lit(a)).otherwise(F.lit(b))
    direct = F.lit(t.extractive_enabled) & (score >= least(t.fast_extractive, t.extractive))
    if text is not None:
        direct = direct & (F.trim(F.coalesce(text, F.lit(""))) != "")
    return F.when(direct, EXTRACTIVE).when(score >= least(t.fast_local, t.local), LOCAL).when(score >= 0, UNCERTAIN).otherwise(REMOTE)


def adaptive_gate(fused: DataFrame, k: int = 3, rrf: float = 0.025, agreeing: int = 2, bm25: float = 5.0) -> DataFrame:
    """query_id, top_score, top_bm25, n_agreeing, fast: fast where the best fused result is sure and lists agree."""
    first = F.col("rank") == 1
    g = fused.groupBy("query_id").agg(
        F.max(F.when(first, F.col("score"))).alias("top_score"),
        F.coalesce(F.max(F.when(first, F.col("bm25_score"))), F.lit(0.0)).alias("top_bm25"),
        F.count_if((F.col("rank") <= k) & F.col("vector_score").isNotNull() & F.col("bm25_score").isNotNull()).alias("n_agreeing"),
    )
    return g.withColumn("fast", (F.col("top_score") >= rrf) & (F.col("top_bm25") >= bm25) & (F.col("n_agreeing") >= agreeing))


def adaptive(fused: DataFrame, rerank, k: int = 3, **gate) -> DataFrame:
    """Fast queries keep their fused order; only the others reach rerank(DataFrame) -> DataFrame with rerank_score."""
    g = adaptive_gate(fused, k, **gate)
    fast = fused.join(g.filter("fast").select("query_id"), "query_id", "left_semi").filter(F.col("rank") <= k)
    slow = rerank(fused.join(g.filter("NOT fast").select("query_id"), "query_id", "left_semi")).filter(F.col("rank") <= k)
    cols = lambda d, s, r: d.select("query_id", "chunk_id", F.col(s).alias("score"), "rank", F.lit(r).alias("route"))
    return cols(fast, "score", "fast").unionByName(cols(slow, "rerank_score", "quality"))


def _runs(text: Column, n: int) -> Column:
    """All runs of n letters of a text."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))


def expand_queries(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """queries (query_id, query, language) with expanded: the query and the English terms of what it contains.

    terms: ord, term, expansions (array). English and blank queries stay as they are, and so do those that contain
    no term. A term may be any substring, so queries meet terms by the runs of letters of each length that terms have.
    """
    q = queries.filter((F.col("language") != "en") & (F.trim("query") != ""))
    lengths = [r[0] for r in terms.select(F.length("term")).distinct().collect() if r[0]]  # as many as terms have different lengths
    runs = [_runs(F.col("query"), n) for n in lengths]
    parts = q.select("query_id", F.explode(F.array_distinct(F.flatten(F.array(*runs)) if runs else F.array().cast("array<string>"))).alias("term"))
    hit = parts.join(terms, "term")
    found = hit.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", "expansions"))).alias("e"))
    found = found.select("query_id", F.array_distinct(F.flatten(F.transform("e", lambda x: x["expansions"]))).alias("_new"))
    return queries.join(found, "query_id", "left").withColumn("expanded", F.when(F.col("_new").isNull(), F.col("query")).otherwise(F.concat_ws(" ", "query", F.array_join("_new", " ")))).drop("_new")


def translate(texts: DataFrame, dictionary: DataFrame, text_col: str = "text", source: str = "source", target: str = "target") -> DataFrame:
    """texts with translated: the entry (source, target, phrase, translation) of the exact phrase, else of it in any
    case, else the text itself. Distinct phrases are looked up once each."""
    bare = F.trim(text_col)
    asked = texts.select(F.col(source).alias("_s"), F.col(target).alias("_t"), bare.alias("_p")).distinct()
    d = dictionary.select(F.col("source").alias("_s"), F.col("target").alias("_t"), F.col("phrase").alias("_d"), "translation", F.monotonically_increasing_id().alias("_o"))
    a, b = asked.alias("a"), d.alias("d")
    hit = a.join(b, (F.col("a._s") == F.col("d._s")) & (F.col("a._t") == F.col("d._t")) & (F.lower("_p") == F.lower("_d")))
    best = hit.groupBy("a._s", "a._t", "_p").agg(F.min_by("translation", F.struct(F.col("_p") != F.col("_d"), "_o")).alias("_x"))
    out = texts.join(best, (F.col(source) == F.col("_s")) & (F.col(target) == F.col("_t")) & (bare == F.col("_p")), "left")
    keep = F.col("_x").isNull() | (F.col(source) == F.col(target)) | (bare == "")
    return out.withColumn("translated", F.when(keep, F.col(text_col)).otherwise(F.col("_x"))).drop("_s", "_t", "_p", "_x")


def translate_cached(texts: DataFrame, cache: DataFrame, translator: Callable[[DataFrame], DataFrame], text_col: str = "text", source: str = "source", target: str = "target") -> tuple[DataFrame, DataFrame]:
    """(texts with translated, new cache rows): each trimmed text and pair of languages absent from cache (text, source,
    target, translated) is translated once by translator(rows of text, source, target) -> rows with translated.

    What the translator leaves null, and a text of the target's own language, stays as it is.
    """
    keys = ["text", "source", "target"]
    named = texts.withColumns({"_text": F.trim(text_col), "_source": F.col(source), "_target": F.col(target)})
    asked = named.filter("_text <> '' AND _source <> _target").select(F.col("_text").alias("text"), F.col("_source").alias("source"), F.col("_target").alias("target")).distinct()
    new = translator(asked.join(cache.select(*keys), keys, "left_anti")).select(*keys, "translated").filter("translated IS NOT NULL")
    known = cache.select(*keys, "translated").unionByName(new).dropDuplicates(keys).toDF("_text", "_source", "_target", "translated")
    out = named.join(known, ["_text", "_source", "_target"], "left").withColumn("translated", F.coalesce("translated", text_col))
    return out.drop("_text", "_source", "_target"), new


def multilingual(queries: DataFrame, retrieve, translations: DataFrame, least: float = 0.015) -> DataFrame:
    """retrieve(queries) for all; queries whose best score stays under least try once more in translation.

    translations: query_id, translated. Only non-English queries that a translation changes are tried again.
    """
    first = retrieve(queries)
    top = first.groupBy("query_id").agg(F.max("score").alias("_top"))
    low = queries.join(top, "query_id", "left").filter((F.coalesce("_top", F.lit(0.0)) < least) & (F.col("language") != "en")).drop("_top")
    again = low.join(translations, "query_id").filter(F.col("translated") != F.col("query")).withColumn("query", F.col("translated")).drop("translated")
    second = retrieve(again)
    kept = first.join(second.select("query_id").distinct(), "query_id", "left_anti")
    return kept.withColumn("translated", F.lit(False)).unionByName(second.withColumn("translated", F.lit(True)))


def context(results: DataFrame, k: int = 3) -> DataFrame:
    """query_id, context: the first k results as numbered sources in rank order (results: query_id, chunk_id, document_id, text, rank)."""
    g = results.filter(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "document_id", "text"))).alias("s"))
    block = lambda x, i: F.concat(F.lit("[source-"), (i + 1).cast("string"), F.lit("] chunk_id="), x["chunk_id"].cast("string"), F.lit(" document_id="), x["document_id"].cast("string"), F.lit("\n"), x["text"])
    return g.select("query_id", F.array_join(F.transform("s", block), "\n\n").alias("context"))


def citations(results: DataFrame) -> DataFrame:
    return results.select("query_id", "rank", "chunk_id", F.substring("text", 1, 500).alias("text"), F.round("score", 6).alias("score"))


def parse_output(raw: Column, valid: Column, aliases: Column | None = None) -> Column:
    """struct<answer, grounded, source_ids, confidence> of a model's JSON output, null where malformed.

    A code fence and text around the outermost braces are dropped; confidence must lie in 0..1. Source ids go
    through aliases (a map), unknown and repeated ones are dropped, and an answer without any is not grounded.
    """
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    v = F.from_json(body, "answer string, grounded boolean, source_ids array<string>, confidence double")
    ids = F.coalesce(v["source_ids"], F.array().cast("array<string>"))
    if aliases is not None:
        ids = F.transform(ids, lambda i: F.coalesce(F.try_element_at(aliases, i), i))
    ids = F.array_distinct(F.filter(ids, lambda i: F.array_contains(valid, i)))
    sure = F.coalesce(v["confidence"], F.lit(0.0))
    well = (body != "") & v.isNotNull() & sure.between(0, 1) & ~F.to_json(v).eqNullSafe("{}")
    return F.when(
        well,
        F.struct(
            F.coalesce(v["answer"], F.lit("")).alias("answer"), (F.coalesce(v["grounded"], F.lit(False)) & (F.size(ids) > 0)).alias("grounded"), ids.alias("source_ids"), sure.alias("confidence")
        ),
    )


def refusal_origin(status: Column, guard: Column, n_results: Column, grounded: Column) -> Column:
    """Why a request was refused, or null where it was answered and grounded."""
    why = (
        F.when(guard == "blocked", REFUSALS[0])
        .when(n_results == 0, REFUSALS[1])
        .when(~grounded & (status == "answered"), REFUSALS[2])
        .when(guard == "low_confidence", REFUSALS[3])
        .otherwise(REFUSALS[4])
    )
    return F.when((status == "refused") | ~grounded, why)


def first_per_query(results: DataFrame) -> DataFrame:
    """The first result of each query and chunk, by rank."""
    w = Window.partitionBy("query_id", "chunk_id").orderBy("rank")
    return results.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
