"""Keyword in context: every occurrence of a concept dictionary's variants, with the words around it.

A document is cleaned once and split into words once. The runs of word characters that are a variant are looked up in each
text, in lower case: in a set while the dictionary is small, word by word in generated code; else texts' distinct runs are
joined with it, under a key of the text, and each text gets its own list. Only occurrences are written. A variant of several
runs is found by splitting the texts that may hold it. Either way an occurrence is a word number, and the excerpt a slice
of the words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textatlas.functions.text import clean_words, context_of, is_plain, let, nfkc_changed, normalize_text
from textatlas.plans.sizing import broadcast_if_small

CONTEXT_WORDS = 30
#: Variants that are matched with their case.
CASE_SENSITIVE = ("Gen",)
#: What may stand in cleaned text besides letters and blanks.
_PUNCTUATION = ",.;:/-"
#: Up to so many variants of several runs are sought in each text one by one.
MOST_SOUGHT = 32


def parse_dictionary(lines: DataFrame, line: str = "value", order: str | None = None) -> DataFrame:
    """lemma, lemma_ord, variant, variant_ord from lines "lemma, variant, ..."; the lemma is its own first variant.

    Blank lines and variants go; repeated variants stay. lemma_ord is the line's `order` if given, else 0."""
    parts = F.filter(F.transform(F.split(F.trim(line), ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = lines.select(parts.alias("p"), (F.col(order) if order else F.lit(0)).alias("lemma_ord")).where(F.size("p") > 0)
    return rows.select(F.get("p", 0).alias("lemma"), "lemma_ord", F.posexplode("p").alias("variant_ord", "variant"))


def dictionary_from(spark, concepts: dict[str, list[str]]) -> DataFrame:
    """The same table from {lemma: variants}; here the variants hold the lemma only if listed."""
    rows = [(k, i, v, j) for i, (k, vs) in enumerate(concepts.items()) for j, v in enumerate(vs) if v]
    return spark.createDataFrame(rows, "lemma string, lemma_ord int, variant string, variant_ord int")


def _is_one_run(variant: Column) -> Column:
    return variant.rlike(r"(?U)^\w+$")


def _is_case_sensitive(variant: Column) -> Column:
    return variant.isin(*CASE_SENSITIVE)


def prepared(docs: DataFrame, text: str = "text", nfkc: bool = True) -> DataFrame:
    """docs with `words`, the words of the normalised and cleaned text; without the text itself."""
    keep = [c for c in docs.columns if c != text]
    value = F.coalesce(F.col(text), F.lit(""))
    # null where nothing is to be normalised: a text is looked at once for that
    both = docs.select(*keep, value.alias("__text"), F.when(~is_plain(value), normalize_text(value, nfkc=False)).alias("__normal"))
    normal = F.coalesce(nfkc_changed(F.col("__normal")), "__normal") if nfkc else F.col("__normal")
    both = both.select(*keep, "__text", normal.alias("__normal"))
    return both.select(*keep, clean_words(F.coalesce("__normal", "__text"), F.col("__normal").isNull()).alias("words"))


def _parts(word: Column) -> Column:
    """The runs of word characters of a word; empty ones too."""
    # one mark in place of each punctuation character: a split at a single mark is quick
    return F.split(F.translate(word, _PUNCTUATION, "\x01" * len(_PUNCTUATION)), F.lit("\x01"))


def _runs(words: Column) -> Column:
    """Structs (pos, run): the runs of word characters of each word."""
    placed = F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("run")))
    return _parted(placed)


def _parted(placed: Column) -> Column:
    """Structs (pos, run) of words parted into their runs."""
    return F.flatten(F.transform(placed, lambda r: F.transform(_parts(r["run"]), lambda x: F.struct(r["pos"].alias("pos"), x.alias("run")))))


def _is_punctuated(word: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(word, F.lit(c)) for c in _PUNCTUATION])


def _runs_among(words: Column, wanted: list[str]) -> Column:
    """Those of _runs() that are among `wanted` in lower case. Most words have no punctuation and are one run each: only those
    that do, or are wanted, are parted."""
    among = lambda x: F.lower(x).isin(wanted)
    placed = F.transform(words, lambda w, i: F.when(among(w) | _is_punctuated(w), F.struct(i.alias("pos"), w.alias("run"))))
    return F.filter(_parted(F.array_compact(placed)), lambda r: among(r["run"]))


def _few(keys: DataFrame, most_in_set: int) -> list[str] | None:
    """The distinct values of keys(__key) if they are at most most_in_set."""
    few = [r[0] for r in keys.distinct().limit(most_in_set + 1).collect()]
    return few if len(few) <= most_in_set else None


def _hits(base: DataFrame, keys: DataFrame) -> tuple[DataFrame, Column]:
    """base without the texts that hold none of keys(__key), and a column of the runs (pos, run) that are among them in lower case.

    To be exploded as it is: an attribute of it would be filtered for emptiness first, and so computed twice."""
    keyed = base.withColumn("__text", F.sha2(F.array_join("words", " "), 256))
    runs = F.array_distinct(F.transform(_runs(F.col("words")), lambda r: F.lower(r["run"])))
    found = keyed.select("__text", F.explode(runs).alias("__key")).join(keys.distinct(), "__key")
    own = found.groupBy("__text").agg(F.collect_set("__key").alias("__own"))  # at most a text's words
    return keyed.join(own, "__text"), F.filter(_runs(F.col("words")), lambda r: F.array_contains("__own", F.lower(r["run"])))


def _occurrences(base: DataFrame, keys: DataFrame, most_in_set: int) -> DataFrame:
    """base with __pos and __run, a row for each run that is among keys(__key) in lower case.

    Against a set, words become rows inside generated code, which lambdas over arrays are not; a row that doesn't pass is never
    written. Most words have no punctuation and are one run each: only those that do, or are wanted, are parted."""
    keep = [c for c in base.columns if c != "words"]
    wanted = _few(keys, most_in_set)
    if wanted is None:
        texts, found = _hits(base, keys)
        rows = texts.select(*keep, "words", F.explode(found).alias("__r"))
        return rows.select(*keep, "words", F.col("__r.pos").alias("__pos"), F.col("__r.run").alias("__run"))
    among = lambda c: F.lower(c).isin(wanted) if wanted else F.lit(False)
    # not the attribute itself: it would be filtered for emptiness first, and so computed twice
    rows = base.select(*keep, "words", F.posexplode(F.when(F.size("words") > 0, F.col("words"))).alias("__pos", "__word"))
    rows = rows.where(among("__word") | _is_punctuated(F.col("__word")))
    return rows.select(*keep, "words", "__pos", F.explode(_parts(F.col("__word"))).alias("__run")).where(among("__run"))


def find_terms(docs: DataFrame, dictionary: DataFrame, context: int = CONTEXT_WORDS, text: str = "text", nfkc: bool = True, most_in_set: int = 10_000) -> DataFrame:
    """docs' other columns, search_term, match_term, text_excerpt, excerpt_length, lemma_ord, variant_ord, pos.

    A row for each occurrence of each dictionary row: repeated and case variants count again. Matching is on whole runs
    of word characters in any case, but for the case-sensitive variants. pos: the word's number from 0. Null and
    empty texts have no rows. nfkc: ligatures and other compatibility forms are matched as their plain letters."""
    base = prepared(docs, text, nfkc)
    keep = [c for c in base.columns if c != "words"]
    several = dictionary.where(~_is_one_run(F.col("variant")))
    phrases = None if several.isEmpty() else _rows(_phrase_hits(base, several, keep, most_in_set), keep, F.col("__pos"), context)
    single = dictionary.where(_is_one_run(F.col("variant"))).select(F.lower("variant").alias("__key"), "lemma", "lemma_ord", "variant", "variant_ord")
    if phrases is not None and single.isEmpty():
        return phrases  # no second pass over the texts
    hits = _occurrences(base, single.select("__key"), most_in_set).join(broadcast_if_small(single), F.lower("__run") == F.col("__key"))
    hits = hits.where(~_is_case_sensitive(F.col("variant")) | (F.col("__run") == F.col("variant")))
    out = _rows(hits, keep, F.col("__pos"), context)
    return out if phrases is None else out.unionByName(phrases)


def _texts_with(base: DataFrame, several: DataFrame, keep: list[str], most_in_set: int) -> DataFrame:
    """base and several, joined where a text may hold a variant of several runs.

    Up to MOST_SOUGHT variants are sought as they stand, in lower case, unless they have one of the letters that match another of
    cleaned text without being the same in lower case. Any others are joined on their first run, so only texts that hold it
    have them."""
    several = several.withColumn("__low", F.lower("variant"))
    if several.where(F.col("variant").rlike("[ſıİ]")).isEmpty():
        sought = _few(several.select(F.col("__low").alias("__key")), MOST_SOUGHT)
        if sought is not None:
            held = let(F.lower(F.array_join("words", " ")), lambda t: F.array_compact(F.array(*[F.when(F.contains(t, F.lit(v)), F.lit(v)) for v in sought])))
            return base.select(*keep, "words", F.explode(held).alias("__held")).join(broadcast_if_small(several), F.col("__held") == F.col("__low"))
    several = several.withColumn("__first", F.lower(F.regexp_extract("variant", r"(?U)\w+", 0)))
    firsts = several.select(F.col("__first").alias("__key"))
    wanted = _few(firsts, most_in_set)
    texts, found = _hits(base, firsts) if wanted is None else (base, _runs_among(F.col("words"), wanted))
    texts = texts.select(*keep, "words", F.explode(F.array_distinct(F.transform(found, lambda r: F.lower(r["run"])))).alias("__run"))
    return texts.join(broadcast_if_small(several), F.col("__run") == F.col("__first"))


def _phrase_hits(base: DataFrame, several: DataFrame, keep: list[str], most_in_set: int) -> DataFrame:
    """Occurrences of variants of several runs: the text is split at each, and blanks before a piece's end are counted."""
    both = _texts_with(base, several, keep, most_in_set)
    flags = F.when(_is_case_sensitive(F.col("variant")), F.lit("(?U)")).otherwise(F.lit("(?iU)"))
    start = F.when(F.col("variant").rlike(r"(?U)^\w"), F.lit(r"\b")).otherwise(F.lit(r"(?<=\w)"))
    end = F.when(F.col("variant").rlike(r"(?U)\w$"), F.lit(r"\b")).otherwise(F.lit(r"(?=\w)"))
    pattern = F.concat(flags, start, F.lit("\\Q"), F.col("variant"), F.lit("\\E"), end)
    pieces = F.split(F.array_join("words", " "), pattern)
    blanks = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    at = let(
        pieces,
        lambda p: F.transform(
            F.slice(p, 1, F.size(p) - 1),
            lambda _, i: F.aggregate(F.slice(p, 1, i + 1), F.lit(0), lambda acc, x: acc + blanks(x)) + i * blanks(F.col("variant")),
        ),
    )
    return both.withColumn("__pos", F.explode(at))


def _rows(hits: DataFrame, keep: list[str], pos: Column, context: int) -> DataFrame:
    first = F.greatest(pos - context, F.lit(0))
    return hits.select(
        *keep,
        F.col("lemma").alias("search_term"),
        F.col("variant").alias("match_term"),
        context_of(F.col("words"), pos, context).alias("text_excerpt"),
        (F.least(pos + context + 1, F.size("words")) - first).cast("int").alias("excerpt_length"),
        "lemma_ord",
        "variant_ord",
        pos.cast("int").alias("pos"),
    )


def search(docs: DataFrame, dictionary: DataFrame, search_term: str | None = None, **parameters) -> DataFrame:
    """find_terms() for all concepts or one; an unknown one is a KeyError."""
    if search_term is not None:
        dictionary = dictionary.where(F.col("lemma") == search_term)
        if dictionary.isEmpty():
            raise KeyError(search_term)
    return find_terms(docs, dictionary, **parameters)


def splice(old: DataFrame, new: DataFrame, file: str, order: str) -> DataFrame:
    """old with the rows of new's files replaced by new's, at the place of each file's first old row.

    `order` numbers old's rows; new's rows follow their own `order`. Adds splice_major and splice_minor to sort by. Files
    without an old row come last. Fails if a font artefact is left in new's excerpts."""
    if "text_excerpt" in new.columns and not new.where(F.col("text_excerpt").rlike("[ŸŠšã]")).isEmpty():
        raise ValueError("new rows still hold mis-mapped letters")
    files = new.select(file).distinct()
    kept = old.join(files, file, "left_anti").withColumn("splice_major", F.col(order).cast("long")).withColumn("splice_minor", F.lit(-1).cast("long"))
    first = old.join(files, file).groupBy(file).agg(F.min(order).cast("long").alias("splice_major"))
    put = new.join(first, file, "left").withColumn("splice_minor", F.col(order).cast("long"))
    put = put.withColumn("splice_major", F.coalesce("splice_major", F.lit((1 << 62))))
    return kept.unionByName(put.select(kept.columns))
