"""Mixing sources to target weights, by hash-random order and distributed prefix sums. DataFrame functions only.

Every document gets a random but fixed key, the MD5 of seed and id (of the text where there is no id). Within a source, documents are ranged by key into
`ranges` slices of equal width; the slices' sums give each slice its offset, and a running sum inside the slice gives each
document its exact place. No task holds more than one slice of one source. A source's words are then taken in that
order up to its budget: whole epochs first, and the last one cut at the exact word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textatlas.llm.common import NOT_BLANK, staged


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(NOT_BLANK + "+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target (double) for sizes(source, size).

    Sources by code point, null last, weigh `weights`, repeating, and share `share` times all sizes by weight; a target
    stops at `most` times its source's size, the excess goes to the others by weight until none is above. That is a
    level L with sum(min(weight * L, most * size)) = the total: with sources in the order of most * size / weight, the
    first ones are full, and L is what is left over the weights left. A row a source, so windows over all of them are
    over the list of sources."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(in_order) - 1) % len(weights) + 1)
    w = per.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    left = (
        w.withColumn("total", share * F.sum("source_size").over(everything))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    # a source is not full if the level that fills those before it stays below its own cap
    level = (F.col("total") - F.col("full")) / F.col("rest")
    found = left.withColumn("level", F.when(level * F.col("weight") < F.col("cap"), level))
    open_at = F.min(F.when(F.col("level").isNotNull(), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)
    return found.withColumn("at", open_at).select(
        "source",
        "source_size",
        F.when(F.col("at").isNull(), F.col("cap"))
        .otherwise(F.least(F.col("cap"), F.col("at.level") * F.col("weight")))
        .alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    range_digits: int = 3,
) -> DataFrame:
    """doc_id, size, source, source_size, target, taken: a row per document of docs(doc_id, text, source).

    size: words of the text, null 0. taken: words that the mix takes of it, repeats counted; a source's sum to the floor
    of its target. Equal ids are told apart by size only, and rows alike in both are interchangeable; a null id has
    the text in its place, so that rows without ids are dealt over all slices. A null source is a source. Empty tables give no rows, sources without a word take none. Other columns
    are ignored. `range_digits` hexadecimal digits of the key make a slice: 4,096 slices a source."""
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(":"), F.coalesce("text", F.lit(""))))
    key = F.md5(F.concat(F.lit(seed + ":"), named))
    sized = staged(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key")), "sizes")
    sized = sized.withColumn("slice", F.substring("key", 1, range_digits))
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("size"))
    before = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = slices.select("source", "slice", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    goal = targets(slices.select("source", "size"), weights, share, most)
    plan = (
        offsets.alias("o")
        .join(goal.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source")))
        .select("o.source", "o.slice", "o.offset", "g.source_size", "g.target")
    )
    inside = W.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = (
        placed.alias("p")
        .join(plan.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.slice") == F.col("t.slice")))
        .select("p.doc_id", "p.source", "p.size", "t.source_size", "t.target", (F.col("p.inside") + F.col("t.offset")).alias("place"))
    )
    budget = F.floor("target")
    full = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(budget / F.greatest("source_size", F.lit(1))))
    rest = budget - full * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("place")))
    return joined.select("doc_id", "size", "source", "source_size", "target", (full * F.col("size") + part).cast("long").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, n), "")


def _alike() -> Column:
    """MD5 of size, id and source; rows with the same one are interchangeable in the mix. Never null."""
    doc_id, source = F.col("doc_id").cast("string"), F.col("source")
    parts = [F.col("__size").cast("string"), F.lit("|"), F.coalesce(F.concat(F.length(doc_id).cast("string"), F.lit(":"), doc_id), F.lit("-")), F.lit("|")]
    return F.md5(F.concat(*parts, F.coalesce(F.concat(F.lit("s"), source), F.lit("-"))))


def materialise(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: docs' columns and mix_epoch, mix_words; a document once for every epoch that takes words of it.

    The copy at which a budget ends is cut after its last taken word. Rows of docs and of mixed that are alike in doc_id
    (which may be null), source and size are numbered and meet one to one: of docs' by text, of mixed's by words taken."""
    ours = docs.withColumn("__size", n_words(F.col("text"))).withColumn("__alike", _alike())
    ours = ours.withColumn("__n", F.row_number().over(W.partitionBy("__alike").orderBy(F.md5(F.col("text")))))
    taken = mixed.withColumn("__size", F.col("size")).select(_alike().alias("__alike"), F.col("taken").alias("__taken"))
    taken = taken.withColumn("__n", F.row_number().over(W.partitionBy("__alike").orderBy(F.desc("__taken"))))
    out = ours.join(taken.where("__taken > 0"), ["__alike", "__n"])
    last = F.ceil(F.col("__taken") / F.col("__size")).cast("int") - 1
    out = out.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), last)))
    words = F.least(F.col("__size"), F.col("__taken") - F.col("__size") * F.col("mix_epoch")).cast("int")
    out = out.withColumn("mix_words", words)
    cut = F.when(F.col("mix_words") < F.col("__size"), first_words(F.col("text"), F.col("mix_words"))).otherwise(F.col("text"))
    return out.select(*[cut.alias("text") if c == "text" else F.col(c) for c in docs.columns], "mix_epoch", "mix_words")
