"""Line dedup by distinct-site spread: cross-site boilerplate lines go, by HyperLogLog sketches. DataFrame functions only.

A sketch of the sites per line hash, merged by aggregation, estimates on how many sites a line stands. Lines whose
estimate is near the threshold get an exact distinct count; so the sketches' error never decides. Of a boilerplate line, its
first place in the corpus (least doc_id, then line number) may stay, so that no content goes altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textatlas.llm.common import NOT_BLANK, staged
from textatlas.plans.sizing import broadcast_if_small

LINE_KEY = ["h1", "h2"]


def _hashes(line: Column) -> list[Column]:
    """128 bits of the line without its outer blanks."""
    line = F.btrim(line, F.lit(" \t\n\v\f\r"))
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def line_places(docs: DataFrame, site: str) -> DataFrame:
    """h1, h2, site, doc_id, t1, t2, pos: a row per line with a word. t1, t2: hash of the text, with doc_id its row's name."""
    rows = docs.select(
        "doc_id", F.col(site).cast("string").alias("site"), "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")
    )
    lines = rows.select("doc_id", "site", "t1", "t2", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.where(F.col("line").rlike(NOT_BLANK))
    return lines.select(*_hashes(F.col("line")), "site", "doc_id", "t1", "t2", "pos")


def boilerplate(places: DataFrame, min_sites: int = 8, near: float = 0.25, log2_registers: int = 10) -> DataFrame:
    """h1, h2, sites, n_places, first: lines that stand on at least min_sites distinct sites. A null site is none.

    first: the struct (doc_id, pos, t1, t2) of the line's first place, null ids last. Estimates that are within `near` of
    the threshold (at least 2 off it) are replaced by exact counts: over seven standard errors at 2^10 registers."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "pos", "t1", "t2")
    per = places.groupBy(*LINE_KEY).agg(
        F.hll_sketch_agg("site", F.lit(log2_registers)).alias("sketch"), F.count("*").alias("n_places"), F.min(place).alias("first")
    )
    band = max(2.0, near * min_sites)
    # a line can't stand on more sites than it has places
    spread = per.where(F.col("n_places") >= min_sites).select(
        *LINE_KEY, F.hll_sketch_estimate("sketch").alias("sites"), "n_places", "first"
    )
    spread = staged(spread.where(F.col("sites") >= min_sites - band), "spread")
    close = spread.where(F.col("sites") <= min_sites + band)
    exact = (
        places.join(broadcast_if_small(close.select(*LINE_KEY)), LINE_KEY)
        .where(F.col("site").isNotNull())
        .select(*LINE_KEY, "site").distinct()
        .groupBy(*LINE_KEY).agg(F.count("*").alias("sites"))
    )
    sure = spread.where(F.col("sites") > min_sites + band)
    checked = close.drop("sites").join(exact, LINE_KEY).where(F.col("sites") >= min_sites)
    return sure.unionByName(checked.select(sure.columns))


def _gone_by_set(docs: DataFrame, common: DataFrame, keep_first: bool) -> DataFrame:
    """docs with `__kept`, the text's lines that stay: the common lines are a set inside the expression, nothing is shuffled.
    Only the rows that hold a first place, no more than there are common lines, are joined, by broadcast."""
    keys = [(r.h1, r.h2) for r in common.select(*LINE_KEY).collect()]
    firsts = common.where(F.lit(keep_first)).select("first.*").groupBy("doc_id", "t1", "t2").agg(F.collect_set("pos").alias("__first"))
    firsts = F.broadcast(firsts.toDF("__id", "__t1", "__t2", "__first"))
    on = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__t1")) & (F.xxhash64(F.lit(1), docs["text"]) == F.col("__t2"))

    def stays(line: Column, i: Column) -> Column:
        h1, h2 = _hashes(line)
        common_line = h1.isin([k[0] for k in keys]) & h2.isin([k[1] for k in keys]) & line.rlike(NOT_BLANK)
        return ~common_line | F.array_contains(F.coalesce("__first", F.array().cast("array<int>")), i)

    lines = F.split(docs["text"], "\n")
    return docs.join(firsts, on, "left").select(docs["*"], (F.filter(lines, stays) if keys else lines).alias("__kept"))


def _gone_by_join(docs: DataFrame, site: str, common: DataFrame, keep_first: bool, most: int) -> DataFrame:
    """The same by joins. The places of a line with over `most` of them are dealt over several tasks."""
    large = F.broadcast(common.where(F.col("n_places") > most).select(*LINE_KEY, F.ceil(F.col("n_places") / most).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("t1", "pos"), F.coalesce("parts", F.lit(1))).cast("int")
    places = line_places(docs, site).join(large, LINE_KEY, "left").withColumn("part", part).drop("parts", "site")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    spread = common.select(*LINE_KEY, "first").join(large, LINE_KEY, "left").withColumn("part", every)
    gone = places.join(spread.select(*LINE_KEY, "part", "first"), [*LINE_KEY, "part"])
    if keep_first:
        same = [F.col(c).eqNullSafe(F.col(f"first.{c}")) for c in ("doc_id", "pos", "t1", "t2")]
        gone = gone.where(~(same[0] & same[1] & same[2] & same[3]))
    # a document's own lines: as many as it has
    per_row = gone.groupBy("doc_id", "t1", "t2").agg(F.collect_set("pos").alias("__gone")).toDF("__id", "__t1", "__t2", "__gone")
    on = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__t1")) & (F.xxhash64(F.lit(1), docs["text"]) == F.col("__t2"))
    none = F.array().cast("array<int>")
    kept = F.filter(F.split(docs["text"], "\n"), lambda line, i: ~F.array_contains(F.coalesce("__gone", none), i))
    return docs.join(per_row, on, "left").select(docs["*"], kept.alias("__kept"))


def dedup_lines(
    docs: DataFrame,
    site: str = "source",
    min_sites: int = 8,
    keep_first: bool = True,
    near: float = 0.25,
    counts: bool = True,
    most_in_set: int = 10_000,
    most_places: int = 200_000,
) -> DataFrame:
    """docs with the boilerplate lines taken out of `text`: a row per row. With counts, n_lines and n_removed (long) are added.

    Lines are the \\n-split parts that hold a word, alike if equal without outer blanks; blank lines stay. A null text
    stays null, with 0 lines. A text whose lines all go becomes empty. Rows alike in doc_id and text are one place, so
    they keep or lose the same lines. Other columns pass through; with counts, docs' own n_lines and n_removed
    are replaced.

    Up to `most_in_set` boilerplate lines (32 bytes each) are a set that goes to the executors, and the texts aren't
    shuffled; with more, places, lines and texts are joined. The rows are the same."""
    common = staged(boilerplate(line_places(docs, site), min_sites, near).select(*LINE_KEY, "n_places", "first"), "common")
    if common.count() <= most_in_set:
        both = _gone_by_set(docs, common, keep_first)
    else:
        both = _gone_by_join(docs, site, common, keep_first, most_places)
    before = F.size(F.split("text", "\n"))
    n_removed = F.when(F.col("text").isNull(), 0).otherwise(before - F.size("__kept")).cast("long")
    text = F.when(F.size("__kept") < before, F.array_join("__kept", "\n")).otherwise(F.col("text"))
    out = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    if not counts:
        return both.select(*out)
    n_lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: line.rlike(NOT_BLANK))).cast("long")
    return both.select(*out, n_lines.alias("n_lines"), n_removed.alias("n_removed"))
