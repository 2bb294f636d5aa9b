"""The registered queries of this subpackage, over the whole of their tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textatlas.llm import chat, decontaminate, language_id, licenses, line_dedup, mixing, pu_quality, quality_rules, simhash, toxicity
from textatlas.llm.common import remainder, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality_rules.trusted_sample(table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 4) == 2)
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), trusted)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("notices", F.array_join("notices", ","))


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations")).drop("part")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_decontaminate,
        op3_simhash,
        op4_quality_rules,
        op5_mixing,
        op6_line_dedup,
        op7_toxicity,
        op8_license_scan,
        op9_chat_rotation,
        op10_quality_classifier,
    )
}


def _license_sql() -> str:
    """DuckDB SQL of op8, with the known texts inlined."""

    def normalised(x: str) -> str:
        x = f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(13), 'abcdefghijklmnopqrstuvwxyz ')"
        x = f"regexp_replace(chr(10) || {x}, '{licenses.BODY_LINE}', chr(10) || '\\1=\\2', 'g')"
        x = f"regexp_replace({x}, '{licenses.LINE_START}{licenses.COPYRIGHT_LINE}', chr(10), 'g')"
        x = f"regexp_replace({x}, '{licenses.LINE_START}{licenses.ITEM}', chr(10), 'g')"
        x = f"' ' || regexp_replace({x}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', '  ', 'g') || ' '"
        for a, b in licenses.SPELLINGS.items():
            x = f"replace({x}, ' {a} ', ' {b} ')"
        x = f"regexp_replace({x}, ' v([0-9])', ' v  \\1', 'g')"
        return f"trim(regexp_replace({x}, ' +', ' ', 'g'), ' ')"

    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in licenses.known_texts())
    return rf"""
WITH k AS (
  SELECT digest, min(license_id) AS license_id
  FROM (SELECT license_id, md5(nullif({normalised("text")}, '')) AS digest FROM (VALUES {values}) AS v(license_id, text)) GROUP BY digest
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, text, md5(nullif({normalised("text")}, '')) AS text_digest FROM documents
), n AS (
  SELECT rid, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS notices, count(*) AS n_notices
  FROM (SELECT rid, md5(nullif({normalised("line")}, '')) AS digest
        FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)) JOIN k USING (digest)
  GROUP BY rid
)
SELECT d.doc_id, d.text_digest, k.license_id, coalesce(n.notices, '') AS notices, coalesce(n.n_notices, 0) AS n_notices
FROM d LEFT JOIN k ON d.text_digest = k.digest LEFT JOIN n USING (rid)
"""


SQL = {
    "op8_license_scan": _license_sql(),
    "op9_chat_rotation": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), safe AS (
  SELECT conv_id, turn, role, regexp_replace(replace(replace(role, '<|', '< |'), '|>', '| >'), '[\x00-\x1F]', ' ', 'g') AS label,
         replace(replace(text, '<|', '< |'), '|>', '| >') AS text, text AS raw FROM t
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, raw) - 1 AS place FROM safe
), people AS (
  SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'
), pieces AS (
  SELECT p.conv_id, q.perspective, p.place, p.role = q.perspective AS own,
         CASE WHEN p.role = q.perspective THEN '<|im_start|>assistant' || chr(10)
              WHEN p.role = 'system' THEN '<|im_start|>system' || chr(10)
              ELSE '<|im_start|>user name=' || p.label || chr(10) END AS head,
         p.text || '<|im_end|>' || chr(10) AS body
  FROM placed p JOIN people q ON p.conv_id IS NOT DISTINCT FROM q.conv_id
), ends AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY place) AS e FROM pieces
)
SELECT conv_id, perspective, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_assistant,
       string_agg(head || body, '' ORDER BY place) AS rendered,
       coalesce(string_agg((e - length(body))::BIGINT || '-' || e::BIGINT, ',' ORDER BY place) FILTER (WHERE own), '') AS mask
FROM ends GROUP BY conv_id, perspective
""",
    "op2_decontaminate": r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS rid
  FROM documents
), item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM item, unnest(range(1, greatest(2, len(w) - 8))) AS t(i)
  WHERE len(w) > 0
), places AS (
  SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM doc, (SELECT DISTINCT k FROM windows) AS ks, unnest(range(1, len(w) - k + 2)) AS t(i)
), hits AS (
  SELECT p.rid, p.k, p.i, x.item_id FROM places p JOIN windows x USING (k, gram)
), words_hit AS (
  SELECT rid, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + k)) AS t(j) GROUP BY rid
), items_hit AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words_hit USING (rid) LEFT JOIN items_hit USING (rid)
""",
    "op6_line_dedup": r"""
WITH doc AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS parts, row_number() OVER () AS rid FROM documents
), lines AS (
  SELECT rid, doc_id, source, text, i - 1 AS pos, regexp_replace(parts[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
  FROM doc, unnest(range(1, len(parts) + 1)) AS t(i)
  WHERE regexp_matches(parts[i], '[^\x20\x09-\x0D]')
), common AS (
  SELECT line, min((doc_id IS NULL, doc_id, pos)) AS first_place FROM lines GROUP BY line HAVING count(DISTINCT source) >= 8
), gone AS (
  SELECT l.rid, l.pos FROM lines l JOIN common c USING (line) WHERE (doc_id IS NULL, doc_id, pos) <> first_place
), kept AS (
  SELECT d.rid, string_agg(parts[i], chr(10) ORDER BY i) AS text
  FROM doc d, unnest(range(1, len(parts) + 1)) AS t(i)
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.rid = d.rid AND g.pos = i - 1)
  GROUP BY d.rid
)
SELECT doc_id, (SELECT count(*) FROM lines l WHERE l.rid = d.rid) AS n_lines, (SELECT count(*) FROM gone g WHERE g.rid = d.rid) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN md5(coalesce(k.text, '')) END AS text_md5
FROM doc d LEFT JOIN kept k USING (rid)
""",
    "op5_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), ':' || coalesce(text, ''))) AS key
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM per
), l AS (
  SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM w
), opened AS (
  SELECT arg_min((total - full_) / rest, cap / weight) AS level FROM l WHERE (total - full_) / rest * weight < cap
), goal AS (
  SELECT l.source, l.source_size, CASE WHEN o.level IS NULL THEN cap ELSE least(cap, o.level * weight) END AS target
  FROM l, opened o
), placed AS (
  SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM sized s
), b AS (
  SELECT p.doc_id, p.size, p.source, g.source_size, g.target, p.place, floor(g.target)::BIGINT AS budget,
         CASE WHEN g.source_size = 0 THEN 0 ELSE floor(g.target)::BIGINT // g.source_size END AS whole
  FROM placed p JOIN goal g ON p.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source, source_size, target,
       CAST(whole * size + greatest(0, least(size, budget - whole * source_size - place)) AS BIGINT) AS taken
FROM b
""",
}
