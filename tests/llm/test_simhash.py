import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textatlas.llm import simhash as s
from textatlas.llm.components import connected_components


def fp_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(pairs, radius=3):
    """component_id of (doc_id, fp) rows, by comparing all."""
    root = {f: f for _, f in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(root)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for i, f in pairs:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [(i, least.get(find(f))) for i, f in pairs]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "One two", "A b\x0bc D", "x " * 500, "ÄB c d e f é", "\U0001f600 a b c d"])
def test_fingerprint(spark, make_docs, text):
    assert s.fingerprint(text) % (1 << 64) == fp_by_hand(text)
    assert s.simhash_groups(make_docs([(1, text)])).first().fingerprint == f"{fp_by_hand(text):016x}"


def test_shingle_hash_is_spark_s_xxhash64(spark):
    h = spark.sql("select xxhash64('ä b c') h").first().h
    assert h % (1 << 64) == xxhash.xxh64("ä b c".encode(), seed=42).intdigest()


def near_copies(n=120, seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, base = [], []
    for i in range(n):
        if i % 4 == 0 or not base:
            text = [rnd.choice(words) for _ in range(rnd.choice([5, 80, 300]))]
            base.append(text)
        else:
            text = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 1, 2, 8])):
                text[rnd.randrange(len(text))] = rnd.choice(words)
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("shard_rows", [4096, 3])
def test_groups_match_brute_force(make_docs, odd_rows, shard_rows):
    rows = near_copies() + [(r[0] if r[0] is None else r[0] + 500, r[1]) for r in odd_rows]
    out = s.simhash_groups(make_docs(rows, clashing=True), shard_rows=shard_rows).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or 0)
    want = groups_by_hand([(i, fp_by_hand(t)) for i, t in rows])
    assert sorted(((r.doc_id, r.component_id) for r in out), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("shard_rows", [10_000, 64])
def test_links_of_a_dense_ball(spark, shard_rows):
    """A group whose fingerprints are all near one another, and chains at distance 3."""
    rnd = random.Random(0)
    centre = rnd.getrandbits(64)
    fps = {centre ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(20)}
    at = rnd.getrandbits(64)
    for _ in range(12):
        fps.add(at)
        for b in rnd.sample(range(64), 3):
            at ^= 1 << b
    fps |= {rnd.getrandbits(64) for _ in range(300)}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = s.links(df, shard_rows=shard_rows)
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in links.collect())
    roots = {r.node: r.root for r in connected_components(links).collect()}
    got = {}
    for f in signed:
        got.setdefault(roots.get(f, f), set()).add(f % 2**64)
    want = {}
    for i, c in groups_by_hand([(i, f) for i, f in enumerate(fps)]):
        want.setdefault(c, set()).add(list(fps)[i])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_dense_shards_give_few_links(spark):
    fps = [i for i in range(256)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    assert s.links(df).count() <= 10 * 255


def test_bk_tree_finds_all_within():
    rnd = random.Random(3)
    values = [rnd.getrandbits(10) for _ in range(400)]
    tree = s.BKTree()
    for v in values:
        tree.add(v)
    for probe in (0, 5, 1023):
        assert {tree.values[i] for i in tree.within(probe, 2)} == {v for v in values if (v ^ probe).bit_count() <= 2}
    assert s.BKTree().within(1, 3) == []


def test_dedup_keeps_one_of_a_group(make_docs, odd_rows):
    rows = near_copies(60)
    df = make_docs(rows + [(r[0] if r[0] is None else r[0] + 500, *r[1:]) for r in odd_rows], clashing=True)
    kept, groups = s.dedup(df), s.simhash_groups(df)
    assert kept.columns == df.columns
    want = {r[0] for r in groups.select("component_id").distinct().collect()}
    got = [r[0] for r in kept.select("doc_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_dedup_decides_by_row(make_docs):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(3, a), (7, a), (7, b), (None, a), (None, c), (None, d), (None, d), (9, c), (5, "x y z"), (5, "p q r"), (5, "p q r")]
    got = [(r.doc_id, r.text) for r in s.dedup(make_docs(rows, clashing=True)).collect()]
    assert sorted(got, key=repr) == sorted([(3, a), (7, b), (9, c), (None, d), (5, "x y z"), (5, "p q r")], key=repr)


@pytest.mark.parametrize("in_one_task", [200_000, 70, 0])
@pytest.mark.parametrize("most", [100_000, 5])
def test_components(spark, monkeypatch, in_one_task, most):
    from textatlas.llm import components

    monkeypatch.setattr(components, "MOST", most)
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 100), (7, 7), (None, 3), (200, 201)] + [(500, 500 + i) for i in range(1, 60)] + [(-9, -3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long"), in_one_task).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 103: 100, 200: 200, 201: 200, -9: -9, -3: -9} | {500 + i: 500 for i in range(60)}
    assert connected_components(spark.createDataFrame([], "u long, v long"), in_one_task).count() == 0


def test_empty(make_docs):
    assert s.simhash_groups(make_docs([])).count() == 0 and s.dedup(make_docs([])).count() == 0


def test_many_batches_of_one_shard(spark):
    """A shard that goes on over several Arrow batches is one shard."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(64).select(F.col("id").alias("fp"))
        roots = connected_components(s.links(df)).select("root").distinct().count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert roots == 1
