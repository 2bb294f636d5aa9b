"""Windows, distances, numbering, pruning and term lookups against brute force."""

import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textatlas.functions import text
from textatlas.operators import cross, export, kwic, matrix, quality
from textatlas.operators.topics import dtm, lda, scores
from textatlas.plans import pipelines
from textatlas.sources import files


@pytest.mark.parametrize("window, block", [(4, 8), (7, 7), (110, 1024), (3, 1024)])
def test_window_counts(spark, window, block):
    rnd = random.Random(window)
    docs = [(i, [rnd.choice("abcdefghij") for _ in range(n)]) for i, n in enumerate([0, 1, 2, 5, 30, 300])] + [(9, None)]
    topics = [(0, "a"), (0, "b"), (0, "c"), (1, "a"), (1, "z"), (1, "j")]
    want = Counter()
    for _, t in docs:
        for s in range(max(1, len(t or []) - window + 1)):
            own = set((t or [])[s : s + window])
            for k in (0, 1):
                terms = {x for j, x in topics if j == k} & own
                want.update((k, a, b) for a in terms for b in terms)
    got = scores.window_counts(
        spark.createDataFrame(docs, "doc_id int, tokens array<string>"), "doc_id", "tokens", spark.createDataFrame(topics, "topic int, term string"), window, block
    )
    assert {(r.topic, r.a, r.b): r.n for r in got.collect()} == dict(want)


def test_coherence_is_high_for_words_that_stand_together(spark):
    docs = [(i, ["a", "b", "x"] if i % 2 else ["c", "d", "y"]) for i in range(40)]
    topics = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, "c")], "topic int, term string")
    got = {r.topic: r.coherence for r in scores.coherence_cv(spark.createDataFrame(docs, "doc_id int, tokens array<string>"), "doc_id", "tokens", topics).collect()}
    assert got[0] == pytest.approx(1, abs=1e-6) and got[1] < 0.9


def test_topic_distances_and_coordinates(spark):
    rows = [(1, "a", 2.0), (1, "b", 2.0), (2, "b", 1.0), (2, "c", 3.0), (3, "x", 1.0), (4, "a", 1.0), (4, "b", 1.0)]
    got = {(r[0], r[1]): r[2] for r in lda.topic_distances(spark.createDataFrame(rows, "topic_id int, term string, weight double")).collect()}
    p = {t: np.array([sum(w for i, x, w in rows if i == t and x == v) for v in "abcx"]) for t in (1, 2, 3, 4)}
    p = {t: v / v.sum() for t, v in p.items()}
    kl = lambda a, b: sum(x * np.log(x / y) for x, y in zip(a, b) if x)
    for (a, b), d in got.items():
        m = (p[a] + p[b]) / 2
        assert d == pytest.approx((kl(p[a], m) + kl(p[b], m)) / 2, abs=1e-12)
    assert (1, 3) not in got and got[1, 4] == 0
    at = lda.principal_coordinates(np.array([[0, 3, 4], [3, 0, 5], [4, 5, 0]], dtype=float))
    gaps = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
    assert np.allclose(gaps, [[0, 3, 4], [3, 0, 5], [4, 5, 0]])
    assert lda.topic_coordinates(spark.createDataFrame(rows, "topic_id int, term string, weight double")).agg(F.sum("freq")).first()[0] == pytest.approx(100, abs=0.01)


def test_numbered(spark, tmp_path):
    rnd = random.Random(0)
    keys = [rnd.randrange(500) for _ in range(2000)] + [None] * 3
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int").repartition(5)
    got = sorted((r.id, r.k) for r in export.numbered(df, ["k"], f"file://{tmp_path}/n").collect())
    assert [g[0] for g in got] == list(range(1, 2004)) and [g[1] for g in got] == [None] * 3 + sorted(k for k in keys if k is not None)


def test_vectors_keep_their_counts(spark):
    docs = spark.createDataFrame([(0, ["a", "b", "a"]), (1, ["zz"]), (2, []), (3, ["b", "a"])], "doc int, tokens array<string>")
    fitted = lda.fit_lda(docs, "doc", "tokens", 2, min_df=2, max_df=1.0, epochs=1, subsample=0.5)
    assert {r.doc: r.n_tokens for r in fitted.vectors.select("doc", "n_tokens").collect()} == {0: 3.0, 3: 2.0}
    g = fitted.global_summary().first()
    assert (g.n_documents, g.n_terms, g.n_tokens) == (2, 2, 5)
    assert fitted.topic_terms().count() == 4 and fitted.topic_terms().where("weight <= 0").count() == 0
    fitted.release()


def test_prune(spark):
    rows = [(d, t, 1 + (t == "c")) for d in range(10) for t in "abc" if t == "a" or (t == "b" and d < 5) or (t == "c" and d < 2)]
    df = spark.createDataFrame(rows, "doc int, term string, n int")
    terms = lambda **k: sorted(r[0] for r in dtm.prune(df, "doc", 10, **k).select("term").distinct().collect())
    assert terms(max_df=0.8) == ["b", "c"] and terms(min_df=0.5) == ["a", "b"] and terms(min_df=3, max_df=9) == ["b"]
    assert terms(max_features=2) == ["a", "b"] and terms(max_features=1) == ["a"]


def test_dry_run_counts_only(spark):
    rows = [(c, i, "text", [0.0, 1.0], "s", "b", "g") for i, c in enumerate(["A", "A", "B"])]
    excerpts = spark.createDataFrame(rows, "concept string, doc_id int, text string, embedding array<double>, state string, subject string, grade_band string")
    out = pipelines.topic_run(excerpts, pipelines.RunConfig(dry_run=True))
    assert {c: t["n_docs"].first()["count"] for c, t in out.items()} == {"A": 2, "B": 1} and all(set(t) == {"n_docs"} for t in out.values())


@pytest.mark.parametrize("raw", ["ﬁnden", "Ⅷ ½", "é", "…", "ſ", "№5", "plain ä", "a–b", None, "", "ĳ", " x", "ﬀ​"])
def test_nfkc(spark, raw):
    got = spark.createDataFrame([(raw,)], "t string").select(text.normalize_text(F.col("t")).alias("t")).first()[0]
    plain = spark.createDataFrame([(raw,)], "t string").select(text.normalize_text(F.col("t"), nfkc=False).alias("t")).first()[0]
    assert got == (None if raw is None else unicodedata.normalize("NFKC", plain))


def test_ligatures_are_found(spark):
    docs = spark.createDataFrame([(1, "Wir ﬁnden und ﬂiegen"), (2, "finden")], "doc_id int, text string")
    d = kwic.dictionary_from(spark, {"Finden": ["finden"]})
    assert sorted((r.doc_id, r.pos) for r in kwic.find_terms(docs, d).collect()) == [(1, 1), (2, 0)]
    assert [r.doc_id for r in kwic.find_terms(docs, d, nfkc=False).collect()] == [2]


def test_lookup_by_set_and_by_join_give_the_same(spark):
    rnd = random.Random(2)
    words = ["Gen", "gen", "Kultur,", "of", "the", "und-der", "x", "(Mensch)", "der"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 3, 40])))) for i in range(40)] + [(None, "Gen of the"), (7, None)]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    d = kwic.dictionary_from(spark, {"Gen": ["Gen", "Kultur"], "P": ["of the", "der", "Mensch"], "Leer": ["zz"]})
    rows = lambda **k: sorted(map(repr, kwic.find_terms(df, d, **k).collect()))
    assert rows() == rows(most_in_set=0) and len(rows()) > 100


def test_a_category_named_like_the_total(spark):
    rows = [("Gesamt", "x", 1), ("Gesamt", "x", 2), ("b", "Total", 3), ("b", "y", 3)]
    df = spark.createDataFrame(rows, "a string, b string, file int")
    got = Counter((r.a, r.b, r.n) for r in matrix.crosstab(df, "a", "b", total="Gesamt").collect())
    assert got["Gesamt", "x", 2] == 2 and got["Gesamt", "Gesamt", 4] == 1 and got["Gesamt", "Gesamt", 2] == 1 and sum(got.values()) == 12
    words = spark.createDataFrame([(i, 10 * i) for i in (1, 2, 3)], "file int, word_count int")
    out = Counter((r.a, r.b, r.n_matches, r.n_words) for r in matrix.olap_matrix(df, words, "a", "b").collect())
    assert out["Gesamt", "x", 2, 30] == 2 and out["Gesamt", "Gesamt", 2, 30] == 1 and out["Gesamt", "Gesamt", 4, 60] == 1


def test_files_checks(spark, tmp_path):
    import hashlib

    (tmp_path / "good.txt").write_bytes("ä".encode())
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    read = spark.read.format("binaryFile").load(f"file://{tmp_path}/*.txt")
    assert [r.path.rsplit("/", 1)[1] for r in quality.undecodable(read).collect()] == ["bad.txt"]
    got = {r.path.rsplit("/", 1)[1]: r.md5 for r in files.checksums(spark, f"file://{tmp_path}/*.txt").collect()}
    assert got == {n: hashlib.md5((tmp_path / n).read_bytes()).hexdigest() for n in ("good.txt", "bad.txt")}
    docs = spark.createDataFrame([("Bio", "one"), ("Bio", "two"), ("Ethik", "three")], "subject string, text string")
    files.write_text_tree(docs, f"file://{tmp_path}/tree")
    back = spark.read.text(f"file://{tmp_path}/tree").collect()
    assert sorted((r.subject, r.value) for r in back) == [("Bio", "one"), ("Bio", "two"), ("Ethik", "three")]


def test_mirror(spark, tmp_path):
    for name in ("out/a.csv", "out/b.csv", "out/deep/c.csv", "d.json", "two words.txt"):
        (tmp_path / "from" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "from" / name).write_text(name)
    (tmp_path / "to").mkdir()
    (tmp_path / "to/old").write_text("")
    patterns = ["out/*.csv", "out/deep/*", "*.txt", "out/a*", "*.png", "none/*"]
    assert files.mirror(spark, f"file://{tmp_path}/from", f"file://{tmp_path}/to", patterns) == ["*.png", "none/*"]
    got = {str(p.relative_to(tmp_path / "to")): p.read_text() for p in (tmp_path / "to").rglob("*") if p.is_file() and p.suffix != ".crc"}
    assert got == {x: x for x in ("out/a.csv", "out/b.csv", "out/deep/c.csv", "two words.txt")}
    for to in ("from", "from/out", ""):
        with pytest.raises(ValueError):
            files.mirror(spark, f"file://{tmp_path}/from", f"file://{tmp_path}/{to}", patterns)
    assert (tmp_path / "from/d.json").exists()


def test_coverage(spark):
    records = spark.createDataFrame(
        [("A", "Bio", "BY", False), ("A", "Bio", "BY", True), ("A", None, "BW", None), ("B", None, None, False)],
        "concept string, subject string, state string, is_outlier boolean",
    )
    topics = spark.createDataFrame([("A", "x"), ("A", "y"), ("A", " Total "), ("A", "Kein Thema (-1)"), ("C", "z")], "concept string, topic_name string")
    rows = {r.concept: tuple(r)[1:] for r in cross.concept_coverage(records, topics).collect()}
    assert rows == {"A": (3, 1, 2, 5, 2, 16, 2), "B": (1, 0, 1, 5, 1, 16, 0)}
    assert cross.concept_coverage(records.limit(0), topics).count() == 0
