"""Readers, writers and whole analyses."""

import zipfile

import pytest
from pyspark.sql import functions as F

from textatlas.operators.topics import clusters, lda
from textatlas.plans import pipelines
from textatlas.queries import dictionary
from textatlas.sources import files


def test_tree_and_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("Bio/LP Bayern 2020.txt", "Hallo Welt\n")
        z.writestr("test/x.txt", "no")
        z.writestr("Bio/.hidden.txt", "no")
    root = files.extract_zip(str(tmp_path / "a.zip"), str(tmp_path / "out"))
    rows = files.scan_tree(spark, root).collect()
    assert [(r.file, r.subject, r.text) for r in rows] == [("LP Bayern 2020.txt", "Bio", "Hallo Welt\n")]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../evil.txt", "no")
    with pytest.raises(ValueError):
        files.extract_zip(str(tmp_path / "b.zip"), str(tmp_path / "out2"))


def test_dictionary_file(spark, tmp_path):
    (tmp_path / "k.txt").write_text("Gen, Gene\n\nKultur,Kultur\n", encoding="utf-8")
    rows = files.read_dictionary(spark, str(tmp_path / "k.txt")).orderBy("lemma_ord", "variant_ord").collect()
    assert [(r.lemma, r.variant, r.variant_ord) for r in rows] == [("Gen", "Gen", 0), ("Gen", "Gene", 1), ("Kultur", "Kultur", 0), ("Kultur", "Kultur", 1)]


def test_missing_inputs(spark, tmp_path):
    assert files.read_records(spark, str(tmp_path / "none.json")).count() == 0
    assert files.read_json_map(spark, str(tmp_path / "none.json")) == {}
    (tmp_path / "bad.json").write_text("{")
    assert files.read_json_map(spark, str(tmp_path / "bad.json")) == {}
    assert files.clip_box(800, 600) == (72, 0, 728, 600) and files.clip_box(600, 800) == (0, 72, 600, 728)


def test_cache_depends_on_parameters(spark, tmp_path):
    at, calls = str(tmp_path), []

    def compute(n):
        calls.append(n)
        return spark.range(n)

    assert files.cached(spark, at, {"n": 2}, lambda: compute(2)).count() == 2
    assert files.cached(spark, at, {"n": 2}, lambda: compute(2)).count() == 2
    assert files.cached(spark, at, {"n": 3}, lambda: compute(3)).count() == 3
    assert calls == [2, 3]


def corpus(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    e = spark.read.parquet(f"{small}/embeddings.parquet").withColumnRenamed("vec_id", "doc_id")
    return d.join(e, "doc_id").select("doc_id", "text", "embedding", F.col("source").alias("state"), F.col("lang").alias("subject"), F.lit("5-6").alias("grade_band"), F.lit("Kultur").alias("concept"))


def test_keyword_search(spark, small):
    docs = corpus(spark, small).select(F.col("doc_id").cast("string").alias("file"), "state", "subject", "text")
    out = pipelines.keyword_search(docs, dictionary(spark))
    counts = {r.concept: r.n for r in out.term_counts.collect()}
    assert counts["Leer"] == 0 and sum(counts.values()) == out.matches.count()
    assert out.matches.agg(F.max("excerpt_length")).first()[0] <= 61
    cells = out.state_subject.collect()
    total = next(r.n for r in cells if r.state == r.subject == "Total")
    assert total == sum(r.n for r in cells if "Total" not in (r.state, r.subject)) == out.matches.select("file").distinct().count()


def test_topic_run(spark, small):
    out = pipelines.topic_run(corpus(spark, small), pipelines.RunConfig(concepts=["Kultur", "Unbekannt"], nr_topics=4, n_clusters=8))
    assert set(out) == {"Kultur"}
    r = out["Kultur"]
    assert r["topics"].select("topic").distinct().count() <= 4
    m = r["manifest"].first()
    assert m.n_docs == 200 and sum(x.n for x in m.topics) == 200 and len(m.bbox_3d) == 3
    rows = r["topics_over_subjects"].groupBy("topic").agg(F.sum("share").alias("s")).collect()
    assert all(abs(x.s - 1) < 1e-3 for x in rows)
    assert r["labels"].where("topic = -1").first().label == clusters.OUTLIER_LABEL


def test_lda_run_keeps_its_invariants(spark, small):
    out = pipelines.lda_run(corpus(spark, small), "Kultur", (3,), epochs=1)[3]
    g, s = out["global"].first(), out["summary"].collect()
    assert abs(sum(x.topic_prevalence for x in s) - 1) < 1e-3
    assert sum(x.n_docs_where_dominant for x in s) == g.n_documents == out["dominant"].count()
    assert g.n_topics == 3 and g.avg_doc_length == pytest.approx(g.n_tokens / g.n_documents, abs=0.06)
    by = out["by_subject"].groupBy("topic_id").agg(F.sum("n").alias("n"), F.max("total").alias("t")).collect()
    assert all(x.n == x.t for x in by)


def test_sweep_resumes(spark, small, tmp_path):
    docs, at, seen = corpus(spark, small), str(tmp_path / "sweep"), []

    def terms_at(d, k):
        seen.append(k)
        t = spark.createDataFrame([(0, "the"), (0, "and"), (1, "der"), (1, "die")], "topic int, term string")
        return {"a": t, "b": t}

    first = pipelines.sweep(docs, ["Kultur"], (2,), at, terms_at)
    assert first.count() == 2 and first.first().agreement == 1.0
    assert pipelines.sweep(docs, ["Kultur"], (2,), at, terms_at).count() == 2 and seen == [2]


def test_relevance_at_both_ends(spark):
    t = spark.createDataFrame([(1, "a", 9.0), (1, "b", 1.0), (2, "b", 5.0), (2, "c", 5.0)], "topic_id int, term string, weight double")
    totals = spark.createDataFrame([("a", 9), ("b", 6), ("c", 5)], "term string, total long")
    rel = lda.relevance_table(t, totals)
    assert [r.term for r in lda.rerank(rel, 1.0, 1).orderBy("topic_id").collect()] == ["a", "b"]
    assert [r.term for r in lda.rerank(rel, 0.0, 1).orderBy("topic_id").collect()] == ["a", "c"]


def test_csv_round_trip_keeps_blanks_nulls_and_marks(spark, tmp_path):
    import oracle

    from textatlas import queries

    odd = ["", " lead", "trail ", "\ttab\t", "\rcr", "a\r\nb", "\n", "x\n", "\\N", "\\", '"', 'a"', '",', "  ", "\x00", "\x1f", None]
    rows = [(i, t, None if i % 3 == 0 else "" if i % 3 == 1 else " de", None if i % 2 else " s ", 1) for i, t in enumerate(odd)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    oracle.assert_same(queries.csv_round_trip(spark, str(tmp_path)), queries.SQL["csv_round_trip"], oracle.connect(str(tmp_path)))
