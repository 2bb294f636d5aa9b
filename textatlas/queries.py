"""The registered queries of the engine, over whole tables, and their DuckDB SQL.

Binding: doc_id stands for a file, source for a state, lang for a subject, embeddings.label for a document's topic.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textatlas.functions import colors, metadata, stopwords, text
from textatlas.operators import cross, export, kwic, matrix, quality
from textatlas.operators.topics import clusters, dtm, lda, scores
from textatlas.plans import pipelines
from textatlas.plans.sizing import spread
from textatlas.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CONCEPTS = {"Artikel": ["Artikel", "der", "die", "das", "Der"], "Konnektor": ["Konnektor", "und", "que"], "Pronomen": ["Pronomen", "that"], "Leer": ["Leer", "zzzz"]}
PHRASES = {"Genitiv": ["of the"]}
STOP = ["the", "and", "und", "les", "que"]
FILENAMES = [
    "LP Bayern Gymnasium 5-10 2024 Bio.pdf", "LP BaWü Realschule 7,8 2016.pdf", "KMK Bildungsstandards 2020.pdf",
    "LP RheinPfalz Philosohpie Gym Sek2.pdf", "LP NRW GemS Sek1,2 2019.pdf", "LP Hamburg Studienstufe 2022.pdf",
    "LP BerlinBB Gym 9 2018.pdf", "LP Sachsen-Anhalt Hauptschule 12.pdf", ".hidden.pdf", "LP foo-bar 123 1999.pdf",
]
STATES = ["Bayern", " bw ", "NRW", "MeckPomm", "thüringen", "Thueringen", "THÜRINGEN", "", "None", "nan", "<NA>", "kmk", "foo-bar", "foo-bar", "éire", None, "Sachsen-Anhalt"]
GRADES = ["9", "9-10", "5-10", "7,8", "EF", "SekII", "Sek II", "Sek I", "Sek1", "Sek2", "Q1", "Sekundarstufe", "Studienstufe", "14", "0", "", None, "Oberstufe 12/13"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df  # only texts are long to work on


def scratch(spark: SparkSession) -> str:
    """A new path in the folder all executors share; a local temporary one only where none is set, in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="textatlas-")
    return f"{root.rstrip('/')}/textatlas-{uuid.uuid4().hex}"


def dictionary(spark: SparkSession, concepts: dict[str, list[str]] = CONCEPTS) -> DataFrame:
    return kwic.dictionary_from(spark, concepts)


def q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def values(rows: list) -> str:
    return ", ".join("(" + ", ".join(q(x) if isinstance(x, str) or x is None else str(x) for x in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows)


# --- SQL fragments ---------------------------------------------------------------------------------------------------

NORMAL = f"translate(translate(coalesce(text, ''), '{text.FONT_ARTIFACTS[0]}', '{text.FONT_ARTIFACTS[1]}'), '{text.DASHES}', '{'-' * len(text.DASHES)}')"
NUMBERED = rf"regexp_replace(regexp_replace(regexp_replace({NORMAL}, '-\s*\n\s*', '', 'g'), '\b\d+(\.\d+)*\.?(\s|$)', '\2', 'g'), '\.(\s*\.){{3,}}', '', 'g')"
CLEAN = rf"trim(regexp_replace(regexp_replace(regexp_replace({NUMBERED}, '[^{text.LETTERS}\s,.;:/-]', '', 'g'), '\s*\n\s*', ' ', 'g'), '\s+', ' ', 'g'))"
DICT = values([(k, i, v, j) for i, (k, vs) in enumerate(CONCEPTS.items()) for j, v in enumerate(vs)])
MATCHES = rf"""
clean AS MATERIALIZED (SELECT doc_id, source, lang, list_filter(string_split({CLEAN}, ' '), lambda x: x <> '') AS ws FROM documents),
dict(lemma, lemma_ord, variant, variant_ord) AS (VALUES {DICT}),
runs AS (
  SELECT doc_id, source, lang, ws, i - 1 AS pos, unnest(regexp_extract_all(ws[i], '[\p{{L}}\p{{N}}_]+')) AS run
  FROM clean, unnest(range(1, len(ws) + 1)) AS t(i)
),
matches AS (
  SELECT doc_id, source, lang, lemma AS search_term, variant AS match_term, array_to_string(ws[greatest(pos - 30, 0) + 1:pos + 31], ' ') AS text_excerpt,
         CAST(len(ws[greatest(pos - 30, 0) + 1:pos + 31]) AS INTEGER) AS excerpt_length, lemma_ord, variant_ord, CAST(pos AS INTEGER) AS pos
  FROM runs JOIN dict ON lower(run) = lower(variant)
)"""
WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')"
TOKENS = rf"list_filter(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '\p{{L}}{{3,}}')), lambda x: x NOT IN ({', '.join(map(q, STOP))}))"
# terms of the documents with a topic
TOPIC_COUNTS = rf"""
tok AS (SELECT d.doc_id, e.label AS topic, d.lang, unnest({TOKENS.replace('text', 'd.text')}) AS term FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
counts AS (SELECT topic, term, count(*) AS n FROM tok GROUP BY ALL)"""
PRUNED = TOPIC_COUNTS + """,
often AS (SELECT term FROM tok GROUP BY term HAVING count(DISTINCT doc_id) >= 5),
weights AS (SELECT topic + 1 AS topic_id, term, n::DOUBLE AS weight FROM counts SEMI JOIN often USING (term)),
totals AS (SELECT term, sum(weight)::BIGINT AS total FROM weights GROUP BY term)"""
# a document-topic matrix without a model: the share of its words by length modulo 5
DOC_TOPICS = rf"""
lens AS (SELECT doc_id, lang, len(w) % 5 + 1 AS topic_id FROM (SELECT doc_id, lang, unnest({WORDS}) AS w FROM documents)),
cnt AS (SELECT doc_id, topic_id, count(*) AS n FROM lens GROUP BY ALL),
grid AS (SELECT d.doc_id, t.topic_id FROM (SELECT DISTINCT doc_id FROM cnt) d, range(1, 6) AS t(topic_id)),
doc_topics AS (SELECT g.doc_id, g.topic_id, coalesce(n, 0)::DOUBLE / sum(coalesce(n, 0)) OVER (PARTITION BY g.doc_id) AS p FROM grid g LEFT JOIN cnt USING (doc_id, topic_id)),
dominant AS (SELECT doc_id, arg_max(topic_id, (p, -topic_id)) AS topic_id, max(p) AS p FROM doc_topics GROUP BY doc_id)"""
FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(list_filter(string_split({x}, ''), lambda c: c <> ''), lambda c: unicode(c)::BIGINT)), lambda h, u: (xor(h, u) * 16777619) & 4294967295::BIGINT)"


def fnv_sql(x: str) -> str:
    return FNV.format(x=x)


# --- shared inputs ---------------------------------------------------------------------------------------------------


def _with_topic(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("topic"), "embedding")
    return table(spark, d, "documents").join(e, "doc_id")


def _topic_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _with_topic(spark, d).select("doc_id", "topic", "lang", text.topic_tokens(F.coalesce("text", F.lit("")), STOP).alias("tokens"))


def _topic_counts(spark: SparkSession, d: str) -> DataFrame:
    return _topic_tokens(spark, d).select("topic", F.explode("tokens").alias("term")).groupBy("topic", "term").agg(F.count("*").alias("n"))


def _weights(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A topic-term matrix without a model, the counts of terms in five documents or more, and its totals.

    Written once: callers read it several times, and it is as long as the vocabulary, not the corpus."""
    tokens = _topic_tokens(spark, d)
    pruned = dtm.prune(dtm.document_terms(tokens, "doc_id", "tokens"), "doc_id", 0, min_df=5, max_df=1 << 40)
    counts = pruned.join(tokens.select("doc_id", "topic"), "doc_id").groupBy((F.col("topic") + 1).alias("topic_id"), "term").agg(F.sum("n").cast("double").alias("weight"))
    at = scratch(spark)
    counts.write.parquet(at)
    counts = spark.read.schema(counts.schema).parquet(at)
    return counts, counts.groupBy("term").agg(F.sum("weight").cast("long").alias("total"))


def _doc_topics(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select("doc_id", F.explode(text.words(F.coalesce("text", F.lit("")))).alias("w"))
    some = words.groupBy("doc_id", (F.length("w") % 5 + 1).alias("topic_id")).agg(F.count("*").alias("n"))
    wide = some.groupBy("doc_id").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("topic_id", "n"))).alias("m"))
    one = wide.select("doc_id", "all", "m", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("topic_id"))
    return one.select("doc_id", "topic_id", (F.coalesce(F.try_element_at("m", F.col("topic_id")), F.lit(0)) / F.col("all")).alias("p"))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return kwic.find_terms(table(spark, d, "documents").drop("n_chars"), dictionary(spark))


# --- keyword search --------------------------------------------------------------------------------------------------


@query(f"WITH {MATCHES} SELECT doc_id, search_term, match_term, text_excerpt, excerpt_length, lemma_ord, variant_ord, pos FROM matches")
def kwic_matches(spark, d):
    return _matches(spark, d).drop("source", "lang")


@query(f"WITH {MATCHES} SELECT l.lemma AS concept, count(m.search_term) AS n FROM (SELECT DISTINCT lemma FROM dict) l LEFT JOIN matches m ON m.search_term = l.lemma GROUP BY l.lemma")
def kwic_term_counts(spark, d):
    return pipelines.term_counts(_matches(spark, d), dictionary(spark))


@query(f"WITH {MATCHES} SELECT doc_id, match_term, excerpt_length, pos FROM matches WHERE search_term = 'Konnektor'")
def kwic_one_concept(spark, d):
    found = kwic.search(table(spark, d, "documents").select("doc_id", "text"), dictionary(spark), "Konnektor")
    return found.select("doc_id", "match_term", "excerpt_length", "pos")


@query(rf"""
WITH clean AS MATERIALIZED (SELECT doc_id, list_filter(string_split({CLEAN}, ' '), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id, 'of the' AS match_term, CAST(i - 1 AS INTEGER) AS pos, array_to_string(ws[greatest(i - 31, 0) + 1:i + 30], ' ') AS text_excerpt
FROM clean, unnest(range(1, len(ws))) AS t(i)
WHERE regexp_matches(ws[i], '(?i)(^|[^\p{{L}}\p{{N}}_])of$') AND regexp_matches(ws[i + 1], '(?i)^the($|[^\p{{L}}\p{{N}}_])')""")
def kwic_phrases(spark, d):
    found = kwic.find_terms(table(spark, d, "documents").select("doc_id", "text"), dictionary(spark, PHRASES))
    return found.select("doc_id", "match_term", "pos", "text_excerpt")


@query(rf"""
WITH {MATCHES}, dd AS (SELECT DISTINCT doc_id, source, lang FROM matches),
c AS (SELECT coalesce(source, 'Total') AS source, coalesce(lang, 'Total') AS lang, count(*) AS n FROM dd WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY CUBE (source, lang))
SELECT a.source, b.lang, coalesce(n, 0) AS n FROM (SELECT DISTINCT source FROM c) a CROSS JOIN (SELECT DISTINCT lang FROM c) b LEFT JOIN c USING (source, lang)""")
def match_document_pivot(spark, d):
    return matrix.crosstab(_matches(spark, d), "source", "lang", ["doc_id", "source", "lang"])


@query(f"SELECT doc_id, source, lang, CAST(len({WORDS}) AS INTEGER) AS word_count FROM documents")
def doc_word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "lang", text.word_count(F.col("text")).alias("word_count"))


@query("""
WITH old AS (SELECT doc_id, text, doc_id AS ord FROM documents),
new AS (SELECT doc_id, text || '!' AS text, doc_id * 10 AS ord FROM documents WHERE doc_id % 7 = 3)
SELECT doc_id, md5(text) AS h, ord AS splice_major, -1::BIGINT AS splice_minor FROM old ANTI JOIN new USING (doc_id)
UNION ALL SELECT n.doc_id, md5(n.text), o.ord, n.ord FROM new n JOIN old o USING (doc_id)""")
def splice_rows(spark, d):
    old = table(spark, d, "documents").select("doc_id", "text", F.col("doc_id").alias("ord"))
    new = old.where("doc_id % 7 = 3").select("doc_id", F.concat("text", F.lit("!")).alias("text"), (F.col("ord") * 10).alias("ord"))
    return kwic.splice(old, new, "doc_id", "ord").select("doc_id", F.md5("text").alias("h"), "splice_major", "splice_minor")


@query()
def kwic_stream(spark, d):
    """Only files whose name ends in the usual way make a stream; the table's folder is one batch."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    at = scratch(spark)
    docs.write.parquet(f"{at}/in")
    from textatlas.streaming.kwic_stream import stream_matches

    stream_matches(spark, f"{at}/in", docs.schema, dictionary(spark), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("doc_id", "search_term", "match_term", "pos")


# --- text ------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({CLEAN}) AS h, length({CLEAN}) AS n FROM documents")
def clean_documents(spark, d):
    c = text.clean_text(text.normalize_text(F.coalesce("text", F.lit(""))))
    return table(spark, d, "documents").select("doc_id", c.alias("c")).select("doc_id", F.md5("c").alias("h"), F.length("c").cast("long").alias("n"))


@query(f"SELECT doc_id, md5(nfc_normalize({NORMAL})) AS h FROM documents")
def normalize_documents(spark, d):
    """The SQL has no NFKC; on these tables, whose letters are all precomposed, NFC gives the same. tests/test_functions.py has
    other letters."""
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize_text(F.coalesce("text", F.lit("")))).alias("h"))


@query(rf"SELECT DISTINCT doc_id, letter FROM (SELECT doc_id, unnest(regexp_extract_all({NUMBERED}, '\p{{L}}')) AS letter FROM documents) WHERE NOT regexp_matches(letter, '[{text.LETTERS}]')")
def stripped_letters(spark, d):
    docs = table(spark, d, "documents").withColumn("text", text.normalize_text(F.coalesce("text", F.lit(""))))
    return quality.stripped_letter_audit(docs, "doc_id")


@query(rf"""
WITH c AS (SELECT doc_id, {CLEAN} AS c FROM documents), w AS (SELECT doc_id, c, list_filter(string_split(c, ' '), lambda x: x <> '') AS ws, length(c[1:100]) - length(replace(c[1:100], ' ', '')) AS k FROM c)
SELECT doc_id, CASE WHEN length(c) > 100 THEN array_to_string(ws[greatest(k - 10, 0) + 1:k + 11], ' ') END AS context FROM w""")
def word_contexts(spark, d):
    c = text.clean_text(text.normalize_text(F.coalesce("text", F.lit(""))))
    return table(spark, d, "documents").select("doc_id", c.alias("c")).select("doc_id", text.word_context(F.col("c"), F.lit(100), 10).alias("context"))


@query(rf"""
WITH k AS (SELECT doc_id, list_filter(list_transform(list_filter(list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '[^{text.LETTERS}\s]', '', 'g'), '\s+'), lambda x: x <> ''), lambda x: length(x) > 2), lambda x: lower(x)), lambda x: x NOT IN ({', '.join(map(q, STOP))})) AS t FROM documents)
SELECT doc_id, len(t) AS n, md5(array_to_string(list_transform(t, lambda x: CASE WHEN x = 'for' THEN 'fore' ELSE x END), ' ')) AS h FROM k""")
def lda_preparation(spark, d):
    t = text.lda_words(F.col("text"), STOP, {"for": "fore"})
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("h"))


@query(rf"""
WITH k AS (SELECT doc_id, {TOKENS} AS t FROM documents)
SELECT doc_id, len(t) AS n, len(t) + greatest(len(t) - 1, 0) AS n_all, md5(array_to_string(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), '|')) AS h FROM k""")
def topic_tokens_bigrams(spark, d):
    t = text.topic_tokens(F.coalesce("text", F.lit("")), STOP)
    out = table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), text.with_bigrams(F.col("t")).alias("b"))
    return out.select("doc_id", "n", F.size("b").cast("long").alias("n_all"), F.md5(F.array_join("b", "|")).alias("h"))


@query(r"""
WITH k AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), lambda x: length(x) > 1) AS t FROM documents)
SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS h FROM k""")
def word_token_lists(spark, d):
    t = text.word_tokens(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("h"))


@query(r"""
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name || '-' || p_type, '\p{L}+|\P{L}+'), lambda r: upper(r[1]) || lower(r[2:])), '') AS title,
       regexp_replace(p_name || ' / ' || p_type, '[^a-zA-Z0-9_-]+', '_', 'g') AS slug FROM part""")
def title_and_slug(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", text.title_case(F.concat_ws("-", "p_name", "p_type")).alias("title"), text.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


@query("SELECT event_id, CASE WHEN regexp_matches(props, '[\",\\n]') THEN '\"' || replace(props, '\"', '\"\"') || '\"' ELSE coalesce(props, '') END AS cell, replace(replace(replace(replace(replace(coalesce(props, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM events")
def escaped_cells(spark, d):
    return table(spark, d, "events").select("event_id", text.csv_cell(F.col("props")).alias("cell"), text.html_text(F.col("props")).alias("html"))


@query(f"SELECT DISTINCT p_brand, round(('0x' || md5('subject::' || p_brand)[1:8])::BIGINT / 4294967295.0::DOUBLE, 9) AS unit FROM part")
def stable_hash_units(spark, d):
    return table(spark, d, "part").select("p_brand", F.round(colors.hash_unit(F.col("p_brand"), "subject"), 9).alias("unit")).distinct()


@query(f"""
WITH l AS (SELECT DISTINCT unnest([source, lang, 'é' || lang]) AS label FROM documents), h AS (SELECT label, {fnv_sql("label")} AS h, ({fnv_sql("'subject::' || label")} % 360)::DOUBLE / 360 AS hue FROM l),
ch AS (SELECT label, h, list_transform([0, 8, 4], lambda n: round(255 * (0.55::DOUBLE - 0.62::DOUBLE * least(0.55::DOUBLE, 1 - 0.55::DOUBLE) * greatest(-1.0, least((n + hue * 12) % 12 - 3, 9 - (n + hue * 12) % 12, 1.0))))::INTEGER) AS c FROM h)
SELECT label, h AS hash, format('#{{:02x}}{{:02x}}{{:02x}}', c[1], c[2], c[3]) AS color FROM ch""")
def label_colors(spark, d):
    docs = table(spark, d, "documents")
    one = docs.select(F.explode(F.array("source", "lang", F.concat(F.lit("é"), F.col("lang")))).alias("label")).distinct().where("label is not null")
    return one.select("label", colors.fnv1a(F.col("label")).alias("hash"), colors.label_color(F.col("label"), "subject").alias("color"))


@query(f"""
WITH s AS (SELECT ('0x' || md5('start::subject')[1:8])::BIGINT / 4294967295.0::DOUBLE * 360 AS st),
l AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, ('0x' || md5('subject::' || source)[1:8])::BIGINT / 4294967295.0::DOUBLE AS j FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
h AS (SELECT source, ((st + i * 137.508::DOUBLE) % 360) / 360 AS hue, 0.52::DOUBLE + 0.10::DOUBLE * (1 - j) AS li, 0.55::DOUBLE + 0.15::DOUBLE * j AS sa FROM l, s),
ch AS (SELECT source, list_transform([0, 8, 4], lambda n: floor(255 * (li - sa * least(li, 1 - li) * greatest(-1.0, least((n + hue * 12) % 12 - 3, 9 - (n + hue * 12) % 12, 1.0))))::INTEGER) AS c FROM h)
SELECT source, format('#{{:02x}}{{:02x}}{{:02x}}', c[1], c[2], c[3]) AS color FROM ch""")
def label_palette(spark, d):
    return colors.palette(table(spark, d, "documents"), "source", "subject", colors.SUBJECT_COLORS)


@query(f"""
WITH l AS (SELECT lang AS term, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang), h AS (SELECT *, {fnv_sql("'home-wordcloud::' || term")} AS h, max(n) OVER () AS most FROM l),
t AS (SELECT *, (h % 1000)::DOUBLE / 1000 AS t, (h >> 10) % 21 - 10 AS j FROM h),
c AS (SELECT *, list_transform([1, 2, 3], lambda i: greatest(0, least(255, CASE WHEN t < 0.5 THEN round([8, 94, 101][i] + ([83, 209, 255][i] - [8, 94, 101][i]) * (t / 0.5::DOUBLE) + j) ELSE round([83, 209, 255][i] + ([39, 45, 99][i] - [83, 209, 255][i]) * ((t - 0.5::DOUBLE) / 0.5::DOUBLE) + j) END))::INTEGER) AS c FROM t)
SELECT term, format('#{{:02x}}{{:02x}}{{:02x}}', c[1], c[2], c[3]) AS color, round(4 + 36 * sqrt(n::DOUBLE / most), 6) AS size, round(greatest(20.0, 7 * sqrt(greatest(n::DOUBLE, 0.1))), 6) AS bubble FROM c""")
def word_cloud_style(spark, d):
    n = table(spark, d, "documents").where("lang is not null").groupBy(F.col("lang").alias("term")).agg(F.count("*").alias("n"))
    most = n.agg(F.max("n")).scalar()
    return n.select(
        "term", colors.gradient_color(F.col("term")).alias("color"), F.round(colors.font_size(F.col("n"), most), 6).alias("size"),
        F.round(colors.bubble_size(F.col("n").cast("double")), 6).alias("bubble"),
    )


# --- metadata --------------------------------------------------------------------------------------------------------

_STATE_CASES = values(sorted(metadata._state_cases(True).items()))
_NO_STATE = ", ".join(map(q, metadata.NO_STATE))
_STATE_SQL = f"""CASE WHEN coalesce(trim(raw), '') = '' OR lower(strip_accents(trim(raw))) IN ({_NO_STATE}) THEN 'KMK'
 ELSE coalesce(k.state, array_to_string(list_transform(regexp_extract_all(trim(raw), '\\p{{L}}+|\\P{{L}}+'), lambda r: upper(r[1]) || lower(r[2:])), '')) END"""


def _first_sql(x: str, cases: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, {q(p)}) THEN {q(v)}" for p, v in cases) + " END"


@query(rf"""
WITH f(file) AS (VALUES {values(FILENAMES)}), p AS (SELECT file, string_split(file, ' ') AS w FROM f WHERE NOT starts_with(file, '.')),
r AS (SELECT *, CASE w[2] WHEN 'BerlinBB' THEN 'Berlin' WHEN 'RheinPfalz' THEN 'Rheinland-Pfalz' ELSE w[2] END AS raw FROM p), k(key, state) AS (VALUES {_STATE_CASES})
SELECT file, CASE WHEN w[1] = 'KMK' THEN 'KMK' ELSE {_STATE_SQL} END AS state,
  coalesce({_first_sql("file", [(s, s) for s in metadata.SCHOOL_TYPES])}, list_filter(w, lambda x: contains(x, 'schule'))[1]) AS school_type,
  coalesce({_first_sql("file", [(g, g) for g in metadata.GRADE_LABELS])}, nullif(regexp_extract(regexp_replace(file, '\b\d{{4}}\b', ' ', 'g'), '\b(\d{{1,3}}(?:[-,]\d{{1,3}})*)\b', 1), '')) AS grade,
  nullif(regexp_extract(file, '\b(19\d{{2}}|20\d{{2}})\b', 1), '') AS year
FROM r LEFT JOIN k ON k.key = lower(strip_accents(trim(raw)))""")
def filename_metadata(spark, d):
    return metadata.file_metadata(spark.createDataFrame([(f,) for f in FILENAMES], "file string"))


@query(rf"""
WITH s(raw) AS (VALUES {values(STATES)}), k(key, state) AS (VALUES {_STATE_CASES}), c(key, state) AS (VALUES {values(sorted((metadata._state_cases(False) | {n: 'KMK' for n in metadata.NO_STATE} | {'bawü': 'Baden-Württemberg', 'bawue': 'Baden-Württemberg'}).items()))})
SELECT raw, {_STATE_SQL} AS state, CASE WHEN coalesce(trim(raw), '') = '' THEN 'KMK' ELSE coalesce(c.state, trim(raw)) END AS display
FROM s LEFT JOIN k ON k.key = lower(strip_accents(trim(raw))) LEFT JOIN c ON c.key = lower(trim(raw))""")
def canonical_states(spark, d):
    s = spark.createDataFrame([(x,) for x in STATES], "raw string")
    return s.select("raw", metadata.canonical_state(F.col("raw")).alias("state"), metadata.display_state(F.col("raw")).alias("display"))


@query(rf"""
WITH s(raw) AS (VALUES {values(STATES)}), k(key, state) AS (VALUES {_STATE_CASES}), u AS (SELECT trim(raw) AS state, count(*) AS n FROM s LEFT JOIN k ON k.key = lower(strip_accents(trim(raw))) WHERE coalesce(trim(raw), '') <> '' AND lower(strip_accents(trim(raw))) NOT IN ({_NO_STATE}) AND k.key IS NULL GROUP BY 1)
SELECT lpad(n::VARCHAR, 6, ' ') || '  ' || state AS line, row_number() OVER (ORDER BY n DESC, state)::INTEGER AS rank FROM u""")
def unmapped_state_report(spark, d):
    return export.report_lines(metadata.unmapped_states(spark.createDataFrame([(x,) for x in STATES], "raw string"), "raw"))


@query(f"""
WITH f(file) AS (VALUES {values(FILENAMES)})
SELECT regexp_replace(file, '\\.[^.]*$', '') AS title, 'Bio' AS subject, coalesce({_first_sql("lower(file)", [(p.lower(), v) for p, v in metadata.CATALOG_STATES])}, 'Unbekannt') AS state,
       CAST(nullif(regexp_extract(file, '(20[0-9][0-9])', 1), '') AS INTEGER) AS year, '/d/' || file AS path FROM f""")
def document_catalog(spark, d):
    f = spark.createDataFrame([(x, "Bio", "/d/" + x) for x in FILENAMES], "file string, subject string, path string")
    return files.document_catalog(f)


@query(f"""
WITH g(raw) AS (VALUES {values(GRADES)}), t AS (SELECT raw, lower(trim(coalesce(raw, ''))) AS t FROM g), n AS (SELECT raw, t, list_min(list_transform(regexp_extract_all(t, '[0-9]+'), lambda x: x::BIGINT)) AS lo FROM t)
SELECT raw, CASE WHEN lo IS NULL THEN coalesce({_first_sql("t", metadata.GRADE_HINTS)}, 'Unbekannt') WHEN lo BETWEEN 1 AND 4 THEN '1-4' WHEN lo BETWEEN 5 AND 6 THEN '5-6' WHEN lo BETWEEN 7 AND 8 THEN '7-8'
  WHEN lo BETWEEN 9 AND 10 THEN '9-10' WHEN lo BETWEEN 11 AND 13 THEN '11-13' ELSE lo::VARCHAR END AS band, coalesce(nullif(trim(raw), ''), 'Unbekannt') AS cleaned FROM n""")
def grade_bands(spark, d):
    g = spark.createDataFrame([(x,) for x in GRADES], "raw string")
    return g.select("raw", metadata.grade_band(F.col("raw")).alias("band"), metadata.clean_subject(F.col("raw")).alias("cleaned"))


# every run of other characters between two marks, so that a term needs a mark on both sides and no two share one
@query(rf"""
WITH dl AS (SELECT text, lang, replace(regexp_replace(regexp_replace(coalesce(text, ''), '([^\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(1), 'g'), '(?i)(^|\x01)(of\x01 \x01the|the|und)($|\x01)', ' ', 'g'), chr(1), '') AS s FROM documents)
SELECT lang, sum(len({WORDS}))::BIGINT AS raw_words, sum(len({WORDS.replace("text", "s")}))::BIGINT AS kept_words,
       round(100.0 * (sum(len({WORDS})) - sum(len({WORDS.replace("text", "s")}))) / nullif(sum(len({WORDS})), 0), 1) AS percent FROM dl GROUP BY lang""")
def content_focus(spark, d):
    docs = table(spark, d, "documents")
    kept = docs.select("lang", text.word_count(F.col("text")).alias("a"), text.word_count(text.content_focused(F.col("text"), ["the", "und", "of the"])).alias("b"))
    out = kept.groupBy("lang").agg(F.sum("a").alias("raw_words"), F.sum("b").alias("kept_words"))
    return out.withColumn("percent", F.round(100 * F.try_divide(F.col("raw_words") - F.col("kept_words"), F.col("raw_words")), 1))


@query("""
SELECT row_number() OVER (ORDER BY o_orderkey) AS id, coalesce(nullif(o_orderstatus, ''), '—') AS status, './data/txtfiles/' || o_orderstatus || '/LP%20' || o_orderkey || '.txt' AS link
FROM orders""")
def document_rows(spark, d):
    o = table(spark, d, "orders").withColumn("name", F.concat(F.lit("LP "), F.col("o_orderkey").cast("string"), F.lit(".PDF")))
    return export.numbered(o, ["o_orderkey"], scratch(spark)).select(
        "id", F.coalesce(F.nullif("o_orderstatus", F.lit("")), F.lit("—")).alias("status"),
        metadata.text_link(F.col("o_orderstatus"), F.col("name")).alias("link"),
    )


# --- filters, joins, sets --------------------------------------------------------------------------------------------


@query("SELECT doc_id, source, lang, length(text) AS n FROM documents WHERE lang = 'de' AND trim(text) <> ''")
def filtered_documents(spark, d):
    wanted = {"lang": "de", "source": matrix.ALL}
    rows = quality.drop_blank(table(spark, d, "documents"), "text")
    for column, value in wanted.items():
        rows = rows if value == matrix.ALL else rows.where(F.col(column) == value)
    return rows.select("doc_id", "source", "lang", F.length("text").cast("long").alias("n"))


@query("SELECT d.doc_id, d.lang, e.label, e.label = 0 AS is_outlier, d.lang = 'de' AND e.label <> 0 AS highlighted, round(e.embedding[1]::DOUBLE, 4) AS x FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id")
def embedded_documents(spark, d):
    j = _with_topic(spark, d)
    return j.select("doc_id", "lang", F.col("topic").alias("label"), (F.col("topic") == 0).alias("is_outlier"), ((F.col("lang") == "de") & (F.col("topic") != 0)).alias("highlighted"), F.round(F.get("embedding", 0).cast("double"), 4).alias("x"))


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def default_joined(spark, d):
    one = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return table(spark, d, "documents").join(one, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query(f"SELECT w AS word FROM (VALUES {values(quality.EXPECTED_WORDS + ['the', 'und'])}) v(w) WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(text, w))")
def missing_words(spark, d):
    return quality.missing_words(table(spark, d, "documents"), spark, words=quality.EXPECTED_WORDS + ["the", "und"])


@query("SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'Bau' ELSE c_mktsegment END AS segment, count(*) AS n FROM customer GROUP BY 1")
def repaired_terms(spark, d):
    c = quality.repair_terms(table(spark, d, "customer"), "c_mktsegment", {"BUILDING": "Bau"})
    return c.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


@query(f"SELECT concept, word FROM (SELECT DISTINCT lemma AS concept FROM (VALUES {DICT}) v(lemma, a, variant, b)) CROSS JOIN (VALUES {values(stopwords.base_stopwords())}) w(word) UNION SELECT lemma, lower(variant) FROM (VALUES {DICT}) v(lemma, a, variant, b)")
def stopword_tiers(spark, d):
    return stopwords.stopword_table(dictionary(spark))


@query("SELECT s AS lemma, 0 AS lemma_ord, trim(x) AS variant, CAST(row_number() OVER (PARTITION BY s ORDER BY i) - 1 AS INTEGER) AS variant_ord FROM (VALUES ('Gen', ['Gen', 'Gene', 'Gens']), ('Kultur', ['Kultur', 'Kultur'])) v(s, l), unnest(l) WITH ORDINALITY AS t(x, i)")
def dictionary_lines(spark, d):
    lines = spark.createDataFrame([(" Gen, Gene,, Gens ",), ("",), ("  ",), ("Kultur,Kultur",)], "value string")
    return kwic.parse_dictionary(lines)


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def not_done(spark, d):
    return files.not_done(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), ["doc_id"])


# --- counts and matrices ---------------------------------------------------------------------------------------------


def _distribution_sql(row: str, column: str, total: bool) -> str:
    return rf"""
WITH c AS (SELECT e.label::VARCHAR AS topic, d.lang AS lang FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.lang IS NOT NULL),
n AS (SELECT {row}, {column}, count(*) AS n FROM c GROUP BY ALL{f" UNION ALL SELECT 'Total', {column}, count(*) FROM c GROUP BY ALL" if total else ""}),
s AS (SELECT *, sum(n) OVER (PARTITION BY {row}) AS row_total, n / sum(n) OVER (PARTITION BY {row}) AS p FROM n)
SELECT {row}, {column}, n, round(p, 4) AS share, abs(round(sum(-p * log2(p)) OVER (PARTITION BY {row}), 4)) AS entropy, row_total::BIGINT AS row_total, round(row_total / (SELECT count(*) FROM c), 4) AS row_proportion FROM s"""


@query(_distribution_sql("topic", "lang", True))
def topics_over_subjects(spark, d):
    return matrix.distribution(_with_topic(spark, d), "topic", "lang", total_row=True)


@query(_distribution_sql("lang", "topic", True))
def subjects_over_topics(spark, d):
    return matrix.distribution(_with_topic(spark, d), "lang", "topic", total_row=True)


@query(rf"""
WITH c AS (SELECT e.label::VARCHAR AS topic, d.lang AS lang FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.lang IS NOT NULL),
n AS (SELECT lang, topic, count(*) AS n FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, topic) + 2 AS place FROM n), t AS (SELECT lang, sum(n)::BIGINT AS n FROM n GROUP BY lang)
SELECT lang, place::INTEGER AS place, rpad(n::VARCHAR, 8, ' ') || ' | ' || topic AS line FROM r UNION ALL SELECT lang, 0, lang || ' (n=' || n || ')' FROM t UNION ALL SELECT lang, 1, 'count    | topic name' FROM t UNION ALL SELECT lang, 2, repeat('-', 50) FROM t""")
def subject_summary_lines(spark, d):
    return export.subject_topic_summary(_with_topic(spark, d).withColumn("topic", F.col("topic").cast("string")), "lang", "topic")


def _olap_sql(a: str, b: str, relative: bool, where: str = "TRUE") -> str:
    value = "n_matches / greatest(n_words, 1) * 10000" if relative else "n_matches::DOUBLE"
    return rf"""
WITH {MATCHES}, m AS (SELECT nullif({a}, '') AS a, nullif({b}, '') AS b, doc_id FROM matches WHERE {where}), wc AS (SELECT doc_id, len({WORDS}) AS w FROM documents),
g AS (SELECT a, b, doc_id, count(*) AS n FROM m GROUP BY ALL), j AS (SELECT g.*, coalesce(w, 0) AS w FROM g LEFT JOIN wc USING (doc_id)),
cell AS (SELECT a, b, sum(n) AS n_matches, sum(w) AS n_words FROM j WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
ra AS (SELECT a, sum(n) AS n_matches, sum(w) AS n_words FROM (SELECT a, doc_id, sum(n) AS n, max(w) AS w FROM j WHERE a IS NOT NULL GROUP BY ALL) GROUP BY a),
rb AS (SELECT b, sum(n) AS n_matches, sum(w) AS n_words FROM (SELECT b, doc_id, sum(n) AS n, max(w) AS w FROM j WHERE b IS NOT NULL GROUP BY ALL) GROUP BY b),
t AS (SELECT sum(n) AS n_matches, sum(w) AS n_words FROM (SELECT doc_id, sum(n) AS n, max(w) AS w FROM j GROUP BY ALL)),
u AS (SELECT ra.a, rb.b, coalesce(cell.n_matches, 0) AS n_matches, coalesce(cell.n_words, 0) AS n_words FROM ra CROSS JOIN rb LEFT JOIN cell ON cell.a = ra.a AND cell.b = rb.b
  UNION ALL SELECT a, 'Gesamt', n_matches, n_words FROM ra UNION ALL SELECT 'Gesamt', b, n_matches, n_words FROM rb UNION ALL SELECT 'Gesamt', 'Gesamt', n_matches, n_words FROM t)
SELECT a AS {a}, b AS {b}, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(n_words, 0)::BIGINT AS n_words, round(coalesce({value}, 0), 2) AS value FROM u"""


@query(_olap_sql("search_term", "lang", True))
def olap_relative(spark, d):
    return matrix.olap_matrix(_matches(spark, d), doc_word_counts(spark, d), "search_term", "lang", "doc_id")


@query(_olap_sql("source", "lang", False, "search_term = 'Pronomen'"))
def olap_absolute_filtered(spark, d):
    return matrix.olap_matrix(_matches(spark, d), doc_word_counts(spark, d), "source", "lang", "doc_id", {"search_term": "Pronomen", "lang": "Alle"}, relative=False)


@query(rf"""
WITH {MATCHES}, dd AS (SELECT source, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
c AS (SELECT coalesce(source, 'Gesamt') AS source, coalesce(lang, 'Gesamt') AS lang, count(*) AS n FROM dd GROUP BY CUBE (source, lang)),
z AS (SELECT a.source, b.lang, coalesce(n, 0) AS n FROM (SELECT DISTINCT source FROM c) a CROSS JOIN (SELECT DISTINCT lang FROM c) b LEFT JOIN c USING (source, lang)),
mx AS (SELECT max(n) AS m FROM z WHERE source <> 'Gesamt' AND lang <> 'Gesamt')
SELECT source, lang, n, round(greatest(0.14, least(0.9, n / greatest(1.0, max(n) OVER (PARTITION BY lang)))), 6) AS shade, round(least(0.85, 0.12 + n / greatest(m, 1) * 0.6), 6) AS cell, round(least(0.8, 0.15 + n / 30), 6) AS plain FROM z, mx""".replace(f"WITH {MATCHES}, ", "WITH "))
def document_matrix(spark, d):
    cells = matrix.crosstab(table(spark, d, "documents"), "source", "lang", total="Gesamt")
    most = cells.where("source <> 'Gesamt' and lang <> 'Gesamt'").agg(F.max("n")).scalar()
    shaded = matrix.shade(cells, "source", "lang", "n", "column")
    return shaded.select("source", "lang", "n", F.round("shade", 6).alias("shade"), F.round(matrix.document_shade(F.col("n"), most), 6).alias("cell"), F.round(matrix.plain_shade(F.col("n")), 6).alias("plain"))


@query(f"WITH {MATCHES} SELECT (SELECT count(DISTINCT lang) FROM documents) AS n_subjects, (SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM matches) AS n_excerpts")
def home_stats(spark, d):
    docs = table(spark, d, "documents").agg(F.count_distinct("lang").alias("n_subjects"), F.count("*").alias("n_documents"))
    return docs.withColumn("n_excerpts", pipelines.term_counts(_matches(spark, d), dictionary(spark)).agg(F.sum("n")).scalar())


@query("""
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS k FROM c)
SELECT source, n FROM r WHERE k <= 6 UNION ALL SELECT 'Weitere (' || count(*) || ')', sum(n)::BIGINT FROM r WHERE k > 6 HAVING count(*) > 0""")
def capped_legend(spark, d):
    return matrix.capped_legend(table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")), "source", most=6)


_RECORDS_SQL = """
records AS (SELECT d.doc_id AS id, d.source AS state, d.lang AS subject, 'Thema ' || e.label AS topic, e.label = 0 AS is_outlier, list_transform(e.embedding[1:2], lambda x: round(x::DOUBLE, 4)) AS umap_2d, list_transform(e.embedding[1:3], lambda x: round(x::DOUBLE, 4)) AS umap_3d, trim(d.text, ' ') AS excerpt,
  CASE d.lang WHEN 'de' THEN '9-10' WHEN 'en' THEN '5-6' ELSE 'Unbekannt' END AS grade_band FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)"""


def _records(spark, d):
    j = _with_topic(spark, d)
    band = F.when(F.col("lang") == "de", "9-10").when(F.col("lang") == "en", "5-6").otherwise("Unbekannt")
    base = j.select("doc_id", F.col("source").alias("state"), F.col("lang").alias("subject"), band.alias("grade_band"), F.when(F.col("topic") == 0, -1).otherwise(F.col("topic")).alias("topic_id"), F.concat(F.lit("Thema "), F.col("topic").cast("string")).alias("topic_label"), F.slice("embedding", 1, 2).alias("xy"), F.slice("embedding", 1, 3).alias("xyz"), "text")
    return export.concept_records(base)


@query(f"WITH {_RECORDS_SQL} SELECT id, state, subject, grade_band, topic, is_outlier, umap_2d[1] AS x, umap_2d[2] AS y, umap_3d[3] AS z, md5(excerpt) AS h FROM records")
def record_round_trip(spark, d):
    """Records written as JSON and read again."""
    at = scratch(spark)
    files.write_records(_records(spark, d), at)
    r = spark.read.schema(files.RECORD).json(at)
    return r.select("id", "state", "subject", "grade_band", "topic", "is_outlier", F.get("umap_2d", 0).alias("x"), F.get("umap_2d", 1).alias("y"), F.get("umap_3d", 2).alias("z"), F.md5("excerpt").alias("h"))


@query(f"""
WITH {_RECORDS_SQL}, l AS (SELECT unnest(['state', 'subject', 'topic']) AS dimension, unnest([state, subject, topic]) AS label FROM records), n AS (SELECT dimension, label, count(*) AS n FROM l GROUP BY ALL)
SELECT dimension, label, n, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, label)::INTEGER AS rank FROM n""")
def manifest_counters(spark, d):
    return export.counters(_records(spark, d), ["state", "subject", "topic"])


@query(f"""
WITH {_RECORDS_SQL} SELECT i::INTEGER AS dim, round(min(umap_3d[i + 1]), 4) AS low, round(max(umap_3d[i + 1]), 4) AS high, round(min(umap_3d[i + 1]) - 0.05 * (max(umap_3d[i + 1]) - min(umap_3d[i + 1])), 6) AS padded_low, round(max(umap_3d[i + 1]) + 0.05 * (max(umap_3d[i + 1]) - min(umap_3d[i + 1])), 6) AS padded_high FROM records, range(0, 3) AS t(i) GROUP BY i""")
def bounding_boxes(spark, d):
    r = _records(spark, d)
    wide = export.padded_range(r, "umap_3d", 3).select("dim", F.round("low", 6).alias("padded_low"), F.round("high", 6).alias("padded_high"))
    return export.bounding_box(r, "umap_3d", 3).join(wide, "dim")


@query(f"""
WITH {_RECORDS_SQL}, o AS (SELECT subject, count(*) AS n FROM records WHERE NOT is_outlier GROUP BY subject), s AS (SELECT count(*) AS n_docs, count(*) FILTER (WHERE is_outlier) AS n_outliers, count(DISTINCT subject) AS n_subjects FROM records)
SELECT 'Kultur' AS concept, n_docs, n_outliers, n_subjects FROM s""")
def manifest_head(spark, d):
    m = export.manifest_fragment(_records(spark, d), "Kultur")
    return m.select("concept", "n_docs", "n_outliers", F.size("subjects").cast("long").alias("n_subjects"))


@query(f"""
WITH {_RECORDS_SQL}, r AS (SELECT topic AS concept, * FROM records), t AS (SELECT concept, count(DISTINCT subject) AS n_topics FROM r WHERE NOT is_outlier GROUP BY concept)
SELECT concept, count(*) AS n_docs, count(*) FILTER (WHERE is_outlier) AS n_outliers, count(DISTINCT coalesce(subject, '-')) AS n_subjects, 5 AS n_subjects_total, count(DISTINCT coalesce(state, '-')) AS n_states, 16 AS n_states_total, any_value(coalesce(n_topics, 0)) AS n_topics
FROM r LEFT JOIN t USING (concept) GROUP BY concept""")
def concept_coverage(spark, d):
    r = _records(spark, d).withColumn("concept", F.col("topic"))
    return cross.concept_coverage(r, r.where("not is_outlier").select("concept", F.col("subject").alias("topic_name")))


@query(f"""
WITH {_RECORDS_SQL}, c AS (SELECT grade_band, count(*) AS n FROM records WHERE NOT is_outlier GROUP BY 1)
SELECT grade_band, n, row_number() OVER (ORDER BY CASE grade_band WHEN '1-4' THEN 1 WHEN '5-6' THEN 2 WHEN '7-8' THEN 3 WHEN '9-10' THEN 4 WHEN '11-13' THEN 5 ELSE 9 END, grade_band)::INTEGER AS place FROM c""")
def grade_band_counts(spark, d):
    return export.grade_band_counts(_records(spark, d), [b[2] for b in metadata.GRADE_BANDS])


@query(f"WITH {_RECORDS_SQL} SELECT subject, topic, count(*) AS n FROM records WHERE NOT is_outlier GROUP BY ALL")
def legend_counts(spark, d):
    return _records(spark, d).where("not is_outlier").groupBy("subject", "topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("SELECT DISTINCT source AS value FROM documents WHERE source IS NOT NULL AND source <> ''")
def value_set(spark, d):
    return table(spark, d, "documents").where("source <> ''").select(F.col("source").alias("value")).distinct().orderBy("value")


# --- sources ---------------------------------------------------------------------------------------------------------


@query("SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn, coalesce(text, '')) AS text, count(*)::INTEGER AS n_pages FROM conversations GROUP BY conv_id")
def pages_to_documents(spark, d):
    return files.pages_to_documents(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("SELECT doc_id::VARCHAR AS search_term, lang AS match_term, coalesce(text, '') AS text_excerpt, n_chars::INTEGER AS excerpt_length, '2024' AS file, coalesce(source, '') AS state FROM documents")
def csv_round_trip(spark, d):
    """Match rows written as CSV and read again with their schema; texts hold quotes, commas and newlines."""
    at = scratch(spark)
    docs = table(spark, d, "documents")
    full = docs.select(F.col("doc_id").cast("string").alias("search_term"), F.col("lang").alias("match_term"), F.col("text").alias("text_excerpt"), F.col("n_chars").cast("int").alias("excerpt_length"), F.lit("2024").alias("file"), F.col("source").alias("state"), *[F.lit("").alias(c) for c in ("school type", "grade", "year", "subject")])
    files.write_csv(full, at)
    return files.read_csv(spark, at, files.MATCHES, ["search_term"], nullable=("search_term", "match_term"), line_sep="\n").select("search_term", "match_term", "text_excerpt", "excerpt_length", "file", "state")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def cached_table(spark, d):
    return files.cached(spark, scratch(spark), {"table": "documents", "dir": d}, lambda: table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")))


# --- topics ----------------------------------------------------------------------------------------------------------


@query(f"WITH {TOPIC_COUNTS}, o AS (SELECT term FROM tok GROUP BY term HAVING count(DISTINCT doc_id) BETWEEN 5 AND 0.5 * (SELECT count(DISTINCT doc_id) FROM tok)) SELECT doc_id, term, count(*) AS n FROM tok SEMI JOIN o USING (term) GROUP BY ALL")
def pruned_dtm(spark, d):
    t = dtm.document_terms(_topic_tokens(spark, d), "doc_id", "tokens")
    return dtm.prune(t, "doc_id", t.select("doc_id").distinct().count(), 5, 0.5)


@query(f"WITH {TOPIC_COUNTS} SELECT count(DISTINCT doc_id) AS n_documents, count(DISTINCT term) AS n_terms, count(*) AS n_tokens, round(count(*) / count(DISTINCT doc_id), 1) AS avg_doc_length FROM tok")
def corpus_stats(spark, d):
    return dtm.corpus_stats(dtm.document_terms(_topic_tokens(spark, d), "doc_id", "tokens"), "doc_id")


CTFIDF = TOPIC_COUNTS + """,
cls AS (SELECT topic, sum(n) AS t FROM counts GROUP BY topic), f AS (SELECT term, sum(n) AS f FROM counts GROUP BY term),
w AS (SELECT topic, term, n, n / t * ln(1 + (SELECT floor(avg(t)) FROM cls) / f) AS weight FROM counts JOIN cls USING (topic) JOIN f USING (term)),
top AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM w QUALIFY rank <= 20)"""


def _top(spark, d):
    return dtm.top_terms(dtm.class_tfidf(_topic_counts(spark, d), "topic"), "topic")


@query(f"WITH {CTFIDF} SELECT topic, term, n, round(weight, 6) AS weight, rank::INTEGER AS rank FROM top")
def class_tfidf_terms(spark, d):
    return _top(spark, d).withColumn("weight", F.round("weight", 6))


@query(rf"""
WITH {CTFIDF}, l AS (SELECT topic, string_agg(upper(term[1]) || lower(term[2:]), ' · ' ORDER BY rank) AS auto FROM top WHERE rank <= 3 GROUP BY topic)
SELECT topic, CASE topic WHEN 1 THEN 'Eigenes' ELSE auto END AS label FROM l""")
def topic_label_table(spark, d):
    own = spark.createDataFrame([(1, "Eigenes"), (2, "")], "topic int, label string")
    return clusters.topic_labels(_with_topic(spark, d), _top(spark, d), own)


@query(rf"""
WITH {CTFIDF}, l AS (SELECT topic, string_agg(term, '_' ORDER BY rank) FILTER (WHERE rank <= 4) AS four, string_agg(term, ' ' ORDER BY rank) AS representation FROM top GROUP BY topic),
j AS (SELECT e.label AS topic, d.doc_id FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id), c AS (SELECT topic, count(*) AS n, list_sort(list(doc_id))[1:3] AS r FROM j GROUP BY topic)
SELECT topic, n AS count, round(n / (SELECT count(*) FROM j), 6) AS proportion, topic || '_' || four AS name, representation, array_to_string(r, ',') AS representative FROM c LEFT JOIN l USING (topic)""")
def topic_info_table(spark, d):
    info = clusters.topic_info(_with_topic(spark, d).select("topic", "doc_id"), _top(spark, d), "doc_id")
    return info.select("topic", "count", F.round("proportion", 6).alias("proportion"), "name", F.array_join("representation", " ").alias("representation"), F.array_join("representative", ",").alias("representative"))


@query(rf"WITH {CTFIDF} SELECT rank::INTEGER AS rank, max(term) FILTER (WHERE topic = 0) AS Topic_0, max(term) FILTER (WHERE topic = 1) AS Topic_1, max(term) FILTER (WHERE topic = 2) AS Topic_2 FROM top WHERE topic <= 2 GROUP BY rank")
def terms_side_by_side(spark, d):
    return dtm.side_by_side(_top(spark, d).where("topic <= 2"), "topic", [0, 1, 2])


@query(rf"""
WITH {PRUNED}, p AS (SELECT *, weight / sum(weight) OVER (PARTITION BY topic_id) AS p_term, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) AS rank FROM weights)
SELECT topic_id, rank::INTEGER AS rank, term, total, weight, round(p_term, 9) AS p_term FROM p JOIN totals USING (term) WHERE rank <= 20""")
def topic_term_table(spark, d):
    w, t = _weights(spark, d)
    return lda.topic_term_table(w, t).withColumn("p_term", F.round("p_term", 9))


@query(rf"""
WITH {PRUNED}, p AS (SELECT *, weight / sum(weight) OVER (PARTITION BY topic_id) AS p_term, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) AS rank FROM weights)
SELECT term, total, topic_id, round(p_term, 4) AS p_term FROM p JOIN totals USING (term) WHERE term IN (SELECT term FROM p WHERE rank <= 20)""")
def topic_term_matrix(spark, d):
    return lda.term_matrix(*_weights(spark, d))


RELEVANCE = PRUNED + """,
r AS (SELECT topic_id, term, total, weight / sum(weight) OVER (PARTITION BY topic_id) AS p, sum(weight) OVER (PARTITION BY topic_id) AS mass FROM weights JOIN totals USING (term)),
rel AS (SELECT topic_id, term, round(p * mass / (SELECT sum(weight) FROM weights) * (SELECT sum(total) FROM totals), 2) AS freq, total, ln(p) AS logprob, ln(p / (total / (SELECT sum(total) FROM totals))) AS loglift FROM r)"""


@query(f"WITH {RELEVANCE} SELECT topic_id, term, freq, total, round(logprob, 6) AS logprob, round(loglift, 6) AS loglift FROM rel")
def relevance(spark, d):
    return lda.relevance_table(*_weights(spark, d)).withColumns({"logprob": F.round("logprob", 6), "loglift": F.round("loglift", 6)})


@query(f"WITH {RELEVANCE}, s AS (SELECT topic_id, term, round(0.6::DOUBLE * logprob + 0.4::DOUBLE * loglift, 9) AS relevance FROM rel) SELECT topic_id, row_number() OVER (PARTITION BY topic_id ORDER BY relevance DESC, term)::INTEGER AS rank, term, round(relevance, 6) AS relevance FROM s QUALIFY rank <= 30")
def reranked_terms(spark, d):
    rel = lda.relevance_table(*_weights(spark, d))
    whole = rel.withColumns({"logprob": F.round(0.6 * F.col("logprob") + 0.4 * F.col("loglift"), 9), "loglift": F.lit(0.0)})
    return lda.rerank(whole, 1.0).withColumn("relevance", F.round("relevance", 6))


@query(rf"""
WITH {PRUNED}, s AS (SELECT *, sum(weight) OVER (PARTITION BY topic_id) / (SELECT sum(weight) FROM weights) AS pt, weight / sum(weight) OVER (PARTITION BY term) AS pg FROM weights),
k AS (SELECT term, sum(pg * ln(pg / pt)) AS dist FROM s GROUP BY term)
SELECT term, round(total / (SELECT sum(total) FROM totals) * dist, 8) AS saliency, total FROM k JOIN totals USING (term) ORDER BY total / (SELECT sum(total) FROM totals) * dist DESC, term LIMIT 30""")
def salient_terms(spark, d):
    return lda.salient_terms(*_weights(spark, d)).withColumn("saliency", F.round("saliency", 8))


@query(f"WITH {PRUNED}, c AS (SELECT term, sum(total) AS weight FROM totals GROUP BY term) SELECT term, weight::BIGINT AS weight, round(4 + 36 * sqrt(weight::DOUBLE / max(weight) OVER ()), 6) AS size FROM c ORDER BY weight DESC, term LIMIT 50")
def word_cloud(spark, d):
    _, t = _weights(spark, d)
    most = t.agg(F.max("total")).scalar()
    return t.select("term", F.col("total").alias("weight"), F.round(colors.font_size(F.col("total"), most), 6).alias("size")).orderBy(F.desc("weight"), "term").limit(50)


@query(f"WITH {DOC_TOPICS} SELECT doc_id, topic_id::INTEGER AS topic_id, round(p, 9) AS p FROM dominant")
def dominant_topics(spark, d):
    return lda.dominant_topics(_doc_topics(spark, d), "doc_id").withColumn("p", F.round("p", 9))


@query(rf"""
WITH {DOC_TOPICS}, {PRUNED}, pk AS (SELECT topic_id, round(max(weight) / avg(weight), 4) AS peakiness FROM weights GROUP BY topic_id), pr AS (SELECT topic_id, round(avg(p), 4) AS topic_prevalence FROM doc_topics GROUP BY topic_id), dm AS (SELECT topic_id, count(*) AS n FROM dominant GROUP BY topic_id)
SELECT row_number() OVER (ORDER BY topic_prevalence DESC, topic_id)::INTEGER AS topic_rank, topic_id::INTEGER AS topic_id, topic_prevalence, coalesce(n, 0) AS n_docs_where_dominant, peakiness FROM pr LEFT JOIN dm USING (topic_id) LEFT JOIN pk USING (topic_id)""")
def topic_summary(spark, d):
    return lda.topic_summary(_weights(spark, d)[0], _doc_topics(spark, d), "doc_id")


@query(rf"""
WITH {DOC_TOPICS}, j AS (SELECT topic_id, d.lang FROM dominant JOIN documents d USING (doc_id) WHERE d.lang IS NOT NULL), g AS (SELECT topic_id, lang FROM range(1, 8) AS t(topic_id), (SELECT DISTINCT lang FROM j)), c AS (SELECT topic_id, lang, count(*) AS n FROM j GROUP BY ALL)
SELECT topic_id::INTEGER AS topic_id, lang, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY topic_id)::BIGINT AS total FROM g LEFT JOIN c USING (topic_id, lang)""")
def topics_by_subject(spark, d):
    dominant = lda.dominant_topics(_doc_topics(spark, d), "doc_id").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return lda.topics_by_subject(dominant, "lang", 7)


_COOC = CTFIDF + """,
tt AS (SELECT lang AS concept, topic, term FROM (SELECT lang, topic, term, row_number() OVER (PARTITION BY lang, topic ORDER BY count(*) DESC, term) AS r FROM tok GROUP BY lang, topic, term) WHERE r <= 20),
cc AS (SELECT unnest(['de', 'en', 'der', 'of', 'los', 'del', 'ing', 'for']) AS concept),
co AS (SELECT a.concept AS row_concept, b.concept AS col_concept, (SELECT count(DISTINCT topic) FROM tt WHERE tt.concept = a.concept AND term = lower(b.concept)) AS n FROM cc a CROSS JOIN cc b)"""


def _cooccurrence(spark, d):
    from pyspark.sql import Window as W

    t = _topic_tokens(spark, d).select("lang", "topic", F.explode("tokens").alias("term")).groupBy("lang", "topic", "term").agg(F.count("*").alias("n"))
    w = W.partitionBy("lang", "topic").orderBy(F.desc("n"), "term")
    top = t.withColumn("r", F.row_number().over(w)).where("r <= 20").select(F.col("lang").alias("concept"), "topic", "term")
    names = spark.createDataFrame([(x,) for x in ("de", "en", "der", "of", "los", "del", "ing", "for")], "concept string")
    return cross.concept_cooccurrence(top, names)


@query(f"WITH {_COOC} SELECT row_concept, col_concept, n FROM co")
def concept_cooccurrence(spark, d):
    return _cooccurrence(spark, d)


@query(f"WITH {_COOC} SELECT row_concept AS concept, col_concept AS other, n AS score, row_number() OVER (PARTITION BY row_concept ORDER BY n DESC, col_concept)::INTEGER AS rank FROM co WHERE n > 0 AND row_concept <> col_concept QUALIFY rank <= 5")
def related_concepts(spark, d):
    return cross.related_concepts(_cooccurrence(spark, d))


@query(_distribution_sql("topic", "lang", True).replace("WITH c AS", "WITH x AS (WITH c AS").rstrip() + r"""),
y AS (SELECT 'Kultur' AS concept, topic AS topic_name, entropy, row_total AS topic_total, count(*) AS n_subjects FROM x GROUP BY ALL), z AS (SELECT *, CASE WHEN n_subjects >= 2 THEN 'bridge' ELSE 'siloed' END AS kind FROM y WHERE lower(topic_name) NOT IN ('gesamt', 'total'))
SELECT concept, kind, row_number() OVER (PARTITION BY concept, kind ORDER BY CASE kind WHEN 'bridge' THEN entropy ELSE 0 END DESC, topic_total DESC, topic_name)::INTEGER AS rank, topic_name, entropy, topic_total FROM z QUALIFY rank <= 6""")
def bridge_topics(spark, d):
    t = matrix.distribution(_with_topic(spark, d), "topic", "lang", total_row=True)
    one = t.groupBy(F.lit("Kultur").alias("concept"), F.col("topic").alias("topic_name"), "entropy", F.col("row_total").alias("topic_total")).agg(F.count("*").alias("n_subjects"))
    return cross.coherence_topics(one)


@query(rf"""
WITH {CTFIDF}, five AS (SELECT topic, term FROM top WHERE rank <= 5), doc AS (SELECT d.doc_id, {TOKENS.replace('text', 'd.text')} AS t FROM documents d),
total AS (SELECT sum(greatest(len(t) - 109, 1))::DOUBLE AS k FROM doc),
hit AS (SELECT doc_id, greatest(len(t) - 109, 1) AS last, i, t[i] AS term FROM doc, unnest(range(1, len(t) + 1)) AS x(i) WHERE t[i] IN (SELECT term FROM five)),
ss AS MATERIALIZED (SELECT DISTINCT doc_id, s, term FROM hit, unnest(range(greatest(i - 109, 1), least(i, last) + 1)) AS x(s)),
n1 AS (SELECT term, count(*) AS n FROM ss GROUP BY term), n2 AS (SELECT x.term AS a, y.term AS b, count(*) AS n FROM ss x JOIN ss y USING (doc_id, s) GROUP BY ALL),
pr AS (SELECT f.topic, f.term AS a, g.term AS b, na.n AS na, nb.n AS nb, coalesce(n2.n, 0) AS nab FROM five f JOIN five g USING (topic) JOIN n1 na ON na.term = f.term JOIN n1 nb ON nb.term = g.term LEFT JOIN n2 ON n2.a = f.term AND n2.b = g.term),
v AS (SELECT topic, a, b, ln((nab / k + 1e-12) / (na / k * nb / k)) / -ln(nab / k + 1e-12) AS x FROM pr, total), sm AS (SELECT topic, b, sum(x) AS y FROM v GROUP BY ALL),
c AS (SELECT topic, a, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS c FROM v JOIN sm USING (topic, b) GROUP BY ALL)
SELECT topic, round(avg(c), 6) AS coherence FROM c GROUP BY topic""")
def coherence_cv(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.topic_tokens(F.coalesce("text", F.lit("")), STOP).alias("tokens"))
    top = _top(spark, d).where("rank <= 5").select("topic", "term")
    return scores.coherence_cv(docs, "doc_id", "tokens", top).withColumn("coherence", F.round("coherence", 6))


@query(rf"""
WITH {PRUNED}, p AS (SELECT topic_id, term, weight / sum(weight) OVER (PARTITION BY topic_id) AS p FROM weights),
ids AS (SELECT DISTINCT topic_id FROM p), g AS (SELECT a.topic_id AS topic_a, b.topic_id AS topic_b, t.term FROM ids a JOIN ids b ON a.topic_id < b.topic_id CROSS JOIN (SELECT DISTINCT term FROM p) t),
f AS (SELECT topic_a, topic_b, coalesce(x.p, 0) AS a, coalesce(y.p, 0) AS b FROM g LEFT JOIN p x ON x.topic_id = topic_a AND x.term = g.term LEFT JOIN p y ON y.topic_id = topic_b AND y.term = g.term)
SELECT topic_a, topic_b, round(sum(CASE WHEN a > 0 THEN a * ln(2 * a / (a + b)) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(2 * b / (a + b)) ELSE 0 END) / 2, 7) AS distance FROM f GROUP BY ALL""")
def topic_distances(spark, d):
    return lda.topic_distances(_weights(spark, d)[0]).withColumn("distance", F.round("distance", 7))


_CONTEXT_SQL = rf"""
WITH dl AS (SELECT d.lang AS concept, e.label - 1 AS topic, d.text, replace(regexp_replace(regexp_replace(coalesce(d.text, ''), '([^\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(1), 'g'), '(?i)(^|\x01)(of\x01 \x01the|the|und)($|\x01)', ' ', 'g'), chr(1), '') AS s
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),"""


@query(_CONTEXT_SQL + rf"""
w AS (SELECT concept, topic, len({WORDS}) AS a, len({WORDS.replace("text", "s")}) AS b FROM dl)
SELECT concept, count(*) AS n_docs, sum(a)::BIGINT AS raw_words, sum(b)::BIGINT AS kept_words, coalesce(round(100.0 * (sum(a) - sum(b)) / nullif(sum(a), 0), 1), 0) AS percent,
       count(DISTINCT topic) FILTER (WHERE topic <> -1) AS n_topics, round(100.0 * count(*) FILTER (WHERE topic = -1) / count(*), 1) AS outlier_percent FROM w GROUP BY concept""")
def content_context(spark, d):
    docs = _with_topic(spark, d).select(F.col("lang").alias("concept"), "text", (F.col("topic") - 1).alias("topic"))
    return pipelines.content_context(docs, ["the", "und", "of the"])[0]


@query(_CONTEXT_SQL.rstrip(",") + """
SELECT concept, topic, count(*) AS n, row_number() OVER (PARTITION BY concept ORDER BY count(*) DESC, topic)::INTEGER AS rank FROM dl WHERE topic <> -1 GROUP BY concept, topic QUALIFY rank <= 8""")
def largest_context_topics(spark, d):
    docs = _with_topic(spark, d).select(F.col("lang").alias("concept"), "text", (F.col("topic") - 1).alias("topic"))
    return pipelines.content_context(docs, ["the", "und", "of the"])[1]


@query(rf"""
WITH {CTFIDF}, {RELEVANCE.replace(TOPIC_COUNTS + ",", "").lstrip()}, a AS (SELECT topic, term FROM top WHERE rank <= 10), b AS (SELECT topic_id AS topic, term FROM weights QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) <= 10),
n AS (SELECT a.topic AS topic_a, b.topic AS topic_b, count(*) AS n FROM a JOIN b USING (term) GROUP BY ALL)
SELECT topic_a, topic_b, round(n / ((SELECT count(*) FROM a WHERE topic = topic_a) + (SELECT count(*) FROM b WHERE topic = topic_b) - n), 9) AS jaccard FROM n""")
def topic_jaccard(spark, d):
    a = _top(spark, d).where("rank <= 10")
    b = dtm.top_terms(_weights(spark, d)[0].withColumnRenamed("topic_id", "topic"), "topic", 10)
    return scores.topic_jaccard(a, b).withColumn("jaccard", F.round("jaccard", 9))


# --- models, tested by their properties ------------------------------------------------------------------------------


@query()
def method_agreement(spark, d):
    a = _top(spark, d).where("rank <= 10")
    b = dtm.top_terms(_weights(spark, d)[0].withColumnRenamed("topic_id", "topic"), "topic", 10)
    return spark.createDataFrame([(scores.agreement(a, b),)], "agreement double")


@query()
def lda_topics(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.lda_words(F.col("text"), STOP).alias("tokens"))
    fitted = lda.fit_lda(docs, "doc_id", "tokens", 5, vocabulary=5000)  # as many terms as the vectoriser keeps by default
    return lda.topic_summary(fitted.topic_terms(), fitted.doc_topics(), "doc_id")


@query()
def embedding_terms_at_k(spark, d):
    docs = _with_topic(spark, d)
    counts = _topic_counts(spark, d).select("topic", "term", "n")
    return pipelines.embedding_terms_at_k(docs.select("topic"), counts, 5)


@query()
def lda_terms_at_k(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.lda_words(F.col("text"), STOP).alias("tokens"))
    return pipelines.lda_terms_at_k(docs, 5)


@query()
def topic_coordinates(spark, d):
    return lda.topic_coordinates(_weights(spark, d)[0])


@query()
def embedding_clusters(spark, d):
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return clusters.cluster(points, "embedding", 10).select("doc_id", "topic")


@query()
def density_clusters(spark, d):
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return clusters.density_topics(points, "embedding", clusters.min_cluster_size(1 << 10)).select("doc_id", "topic")


@query()
def projected_points(spark, d):
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return clusters.project(points, "embedding", 2, "xy").select("doc_id", "xy")


@query()
def hashed_embeddings(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.topic_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return clusters.embed_texts(docs, "tokens", 256).select("doc_id", "embedding")


@query()
def network_layout(spark, d):
    import numpy as np

    cells = _cooccurrence(spark, d).collect()  # concepts by concepts
    names = sorted({r[0] for r in cells})
    w = np.zeros((len(names), len(names)))
    for r in cells:
        w[names.index(r[0]), names.index(r[1])] = r[2]
    at = cross.force_layout(w)
    return spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in zip(names, at)], "concept string, x double, y double")
