"""SpotSigs fingerprints, in DataFrame functions only.

A spot signature is a common word (the anchor) with the chain of content words that follows it; common words inside
the chain are skipped. A document's fingerprint is the set of its signatures as 32-bit hashes. So that texts with
few or no anchors have one too, it also holds the hashes of all single content words.

Fingerprints are compared by Jaccard similarity. The join over all documents collapses equal fingerprints,
partitions the rest by set length so that only lengths within the threshold's ratio of each other meet, lets a set
be found by the rarest of its signatures only, and skips pairs whose lengths or positions rule the threshold out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import shuffle_width, staged
from textloom.llm.components import components

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with",
    "als", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "avec", "ce", "dans", "du", "elle", "en", "est", "et", "la", "le", "les", "pas", "pour", "qui", "sur", "un", "une",
    "al", "como", "con", "de", "del", "el", "las", "los", "no", "para", "por", "que", "se", "su", "y",
)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def signatures(w: Column, chain: int = 3, reach: int = 8) -> Column:
    """The fingerprint of a list of words (a column of its own, as it is read often): sorted distinct integers."""
    common = lambda x: x.isin(*ANCHORS)
    spots = F.transform(w, lambda x, i: F.when(common(x), F.hash(x, F.slice(F.filter(F.slice(w, i + 2, reach), lambda y: ~common(y)), 1, chain))))
    single = F.transform(w, lambda x: F.when(~common(x), F.hash(x)))
    return F.sort_array(F.array_distinct(F.filter(F.concat(spots, single), lambda x: x.isNotNull())))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def written(signature: Column) -> Column:
    return F.array_join(signature.cast("array<string>"), ",")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and signature (array of int) for each row of docs; a null text counts as empty and has none."""
    got = docs.select(F.col(id_col).alias("doc_id"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("_w"))
    return got.select("doc_id", signatures(F.col("_w")).alias("signature"))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges_per_partition: int = 4) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document, ascending doc_id, after the last the first. A null text is empty: no signatures, like any other empty
    text. Rows that repeat a doc_id follow each other by text. A row without an id has no next document: its edit
    only drops the end, and near_next is null. Other columns are ignored; an empty table gives an empty result.

    Texts are shuffled once, by ranges of doc_id; the bounds of the ranges and the first id of each, as many as
    there are ranges, go through the driver. The first document of a range is also sent to the range before it.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = base.filter("doc_id IS NOT NULL")
    ranges = ranges_per_partition * shuffle_width(docs.sparkSession)
    cuts = known.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(10 * ranges))).first()[0] or []
    kind = docs.schema[id_col].dataType
    bounds = F.lit(sorted(set(cuts))).cast(T.ArrayType(kind)) if cuts else F.array().cast(T.ArrayType(kind))
    placed = known.withColumn("part", F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))))
    heads = sorted((r[0], r[1]) for r in placed.groupBy("part").agg(F.min("doc_id")).collect())
    before = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    first = docs.sparkSession.createDataFrame(before, T.StructType([T.StructField("doc_id", kind), T.StructField("part", T.IntegerType())]))
    # one row for each range
    guests = known.join(F.broadcast(first), "doc_id").select("doc_id", "text", "part", F.lit(1).alias("guest"))
    rows = placed.withColumn("guest", F.lit(0)).unionByName(guests)
    order = Window.partitionBy("part").orderBy("guest", "doc_id", "text")
    met = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("_w", words(F.col("text")))
    met = met.withColumn("a", signatures(F.col("_w"))).drop("_w").withColumn("next_signature", F.lead("a").over(order)).filter("guest = 0")
    loose = base.filter("doc_id IS NULL").withColumn("_w", words(F.col("text"))).select("doc_id", "text", F.lit("").alias("next_text"), signatures(F.col("_w")).alias("a"), F.lit(None).cast("array<int>").alias("next_signature"))
    met = met.select("doc_id", "text", "next_text", "a", "next_signature").unionByName(loose)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edit = met.select(
        "doc_id", n.cast("long").alias("n_chars"), "a", "next_signature",
        F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter)).alias("edited"),
    )
    edit = edit.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", words(F.col("edited")).alias("_v"), "next_signature")
    out = edit.select("doc_id", "n_chars", "edited_sha256", "a", signatures(F.col("_v")).alias("b"), "next_signature")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("a")).alias("fingerprint"),
        written(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("next_signature")).alias("near_next"),
    )


def near_fingerprints(prints: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of fingerprints (doc_id, signature) that are alike by at least threshold.

    members (doc_id, rep, print, n_signatures) gives each document the number of its fingerprint and the least doc_id
    with an equal one; pairs (a, b, likeness, print_a, print_b) those of different fingerprints, a and b being such least ids.
    Documents with an empty fingerprint are alike only among themselves. Every pair is found: none is capped. Rows
    without an id are left out; rows that repeat an id are members of each fingerprint that it has. Empty tables give
    empty results.
    """
    known = prints.filter("doc_id IS NOT NULL").select("doc_id", F.sort_array("signature").alias("signature"))
    groups = staged(known.groupBy("signature").agg(F.min("doc_id").alias("rep")).withColumn("print", F.monotonically_increasing_id()), "spot_groups")
    members = known.alias("k").join(groups.alias("g"), F.col("k.signature") == F.col("g.signature")).select("doc_id", "rep", "print", F.size("g.signature").cast("long").alias("n_signatures"))
    sets = groups.filter(F.size("signature") > 0).select("rep", "print", "signature", F.size("signature").alias("n"))
    items = sets.select("print", "n", F.explode("signature").alias("s"))
    rarity = items.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    ranked = items.join(rarity, "s").withColumn("at", F.row_number().over(Window.partitionBy("print").orderBy("df", "s")))
    # two sets alike by t share one of the first n - ceil(t n) + 1 signatures of either, in any order common to all
    prefix = ranked.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1)
    step = -math.log(threshold)
    band = prefix.withColumn("band", F.floor(F.log("n") / step + 1e-9))
    left = band.select("s", "band", F.col("print").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"))
    right = band.select("s", F.explode(F.array("band", F.col("band") + 1, F.col("band") - 1)).alias("band"), F.col("print").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"))
    met = left.join(right, ["s", "band"]).filter("a < b")
    met = met.filter(F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9)
    # past this signature the sets share at most the shorter rest
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + F.least("pa", "pb")
    met = met.filter(rest >= threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9).select("a", "b").distinct()
    one = sets.select(F.col("print").alias("a"), F.col("rep").alias("rep_a"), F.col("signature").alias("x"))
    two = sets.select(F.col("print").alias("b"), F.col("rep").alias("rep_b"), F.col("signature").alias("y"))
    found = met.join(one, "a").join(two, "b").withColumn("likeness", likeness(F.col("x"), F.col("y"))).filter(F.col("likeness") >= threshold - 1e-9)
    swapped = F.col("rep_a") > F.col("rep_b")
    pick = lambda x, y: F.when(swapped, F.col(y)).otherwise(F.col(x))
    return members, found.select(pick("rep_a", "rep_b").alias("a"), pick("rep_b", "rep_a").alias("b"), "likeness", pick("a", "b").alias("print_a"), pick("b", "a").alias("print_b"))


def near_classes(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_signatures, n_links and component_id for each row of docs that has an id.

    Documents link whose fingerprints are alike by at least threshold, equal ones too; n_links counts the other
    documents' rows that one links with, component_id is the smallest doc_id reachable. Documents without signatures
    (null, empty or blank texts) link with nothing. Rows that repeat an id with other texts are rows of their own that
    share no link. Very long texts are read whole; other columns are ignored; an empty table gives an empty result.
    """
    prints = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    members, pairs = near_fingerprints(prints.filter(F.size("signature") > 0), threshold)
    members, pairs = staged(members, "members"), staged(pairs, "pairs")
    size = members.groupBy("print").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("least"))
    ends = F.array(F.struct(F.col("print_a").alias("print"), F.col("print_b").alias("other")), F.struct(F.col("print_b").alias("print"), F.col("print_a").alias("other")))
    beside = pairs.select(F.explode(ends).alias("e")).select("e.*").join(size.select(F.col("print").alias("other"), F.col("rows").alias("others")), "other").groupBy("print").agg(F.sum("others").alias("others"))
    found = components(pairs.select(F.col("print_a").alias("a"), F.col("print_b").alias("b"))).withColumnRenamed("node", "print")
    known = size.join(beside, "print", "left").join(found, "print", "left").withColumn("component", F.coalesce("component", "print"))
    first = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(first, "component").select("print", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    alone = prints.filter("doc_id IS NOT NULL AND size(signature) = 0").select("doc_id", F.lit(0).cast("long").alias("n_signatures"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return members.join(known, "print").select("doc_id", "n_signatures", "n_links", "component_id").unionByName(alone)
