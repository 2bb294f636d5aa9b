import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from textatlas.llm import decontaminate as d

FIELDS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def by_hand(text, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, ids = split(text), set(), set()
    for item_id, item in items:
        w = split(item)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == w[i : i + k]:
                    hit.update(range(j, j + k))
                    ids.add(str(item_id))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def cases():
    rnd = random.Random(0)
    words = [f"w{i}" for i in range(6)] + ["Über", "É"]
    some = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, some(rnd.choice([0, 1, 2, 3, 9, 10, 11, 14, 30]))) for i in range(25)] + [(100, None), (101, "..."), (102, "w1 W1,w1")]
    docs = [(i, some(rnd.choice([0, 3, 40, 120])), "en", "s") for i in range(20)]
    docs += [(50, "x " + items[8][1] + " y", "en", "s"), (51, None, None, None), (52, "", "en", "s")]
    return docs, items


@pytest.mark.parametrize("shard", [16_000_000, 300])
def test_matches_brute_force(spark, make_docs, cases, shard):
    docs, items = cases
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = d.contamination(make_docs(docs, clashing=True), bench, shard_chars=shard)
    for r in out.collect():
        text = next(t for i, t, *_ in docs if i == r.doc_id)
        assert tuple(r[f] for f in FIELDS) == by_hand(text, items), r.doc_id


def test_decontaminate_keeps_columns_and_clean_rows(spark, make_docs, odd_rows):
    bench = spark.createDataFrame([(1, "no id at all")], "item_id long, text string")
    df = make_docs(odd_rows, clashing=True)
    out = d.decontaminate(df, bench)
    assert out.columns == df.columns and out.count() == len(odd_rows) - 1


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(make_docs([]), none).count() == 0
    r = d.contamination(make_docs([(1, "a b")]), none).first()
    assert (r.n_words, r.n_hit, r.contaminated) == (2, 0, False)


def test_shift_table_skips():
    w = d.WuManber({tuple("abcdefghij"): ["x"]})
    assert list(w.places(list("zzabcdefghijzzabcdefghij"))) == [(2, ["x"]), (14, ["x"])]
    assert w.shift[("i", "j")] == 0 and w.shift[("a", "b")] == 8 and w.far == 9


def test_spans(spark, make_docs):
    bench = spark.createDataFrame([(1, " ".join("abcdefghijkl"))], "item_id long, text string")
    r = d.contamination(make_docs([(1, "x " + " ".join("abcdefghijkl") + " y")]), bench).select("spans", F.col("item_ids")).first()
    assert [(s.a, s.b) for s in r.spans] == [(1, 13)] and r.item_ids == ["1"]
