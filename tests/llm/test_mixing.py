import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from textatlas.llm import mixing as m


def size_of(t):
    return len(re.findall("[^\x20\x09-\x0d]+", t or ""))


def targets_by_hand(sizes):
    """Shares by weight; what is above twice a source's size goes to the others, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(full.values())
        want = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = [s for s in rest if want[s] > 2 * sizes[s]]
        if not above:
            return full | want
        full |= {s: 2.0 * sizes[s] for s in above}


def taken_by_hand(rows, target):
    out = {}
    for s, t in target.items():
        own = sorted((hashlib.md5(f"mix:{i}".encode()).hexdigest(), i, n) for i, n, src in rows if src == s)
        size, left = sum(n for *_, n in own), int(t)
        for _, i, n in own:
            out[i] = (left // size) * n if size else 0
        left -= (left // size) * size if size else 0
        for _, i, n in own:
            out[i] += min(n, left)
            left -= min(n, left)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(make_docs, seed):
    rnd = random.Random(seed)
    rows = [(i, "w " * rnd.choice([0, 1, 5, 40]) or None, "en", rnd.choice(["a", "b", "c", "d", "É", "z", None] if seed else ["a"] * 5 + ["b", None])) for i in range(150)]
    out = m.mix(make_docs(rows, clashing=True), range_digits=1).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size_of(t)
    want = targets_by_hand(sizes)
    taken = taken_by_hand([(i, size_of(t), s) for i, t, _, s in rows], want)
    assert len(out) == len(rows)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == taken[r.doc_id] <= 2 * r.size


def test_sums_reach_targets(make_docs, odd_rows):
    out = m.mix(make_docs(odd_rows)).collect()
    assert len(out) == len(odd_rows)
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        assert sum(r.taken for r in own) == int(own[0].target)
    assert sum({r.source: r.target for r in out}.values()) == pytest.approx(1.5 * sum(r.size for r in out))


def test_empty_and_wordless(make_docs):
    assert m.mix(make_docs([])).count() == 0
    assert [(r.target, r.taken) for r in m.mix(make_docs([(1, None), (2, " ")])).collect()] == [(0.0, 0)] * 2


def test_materialised_mix(make_docs, odd_rows):
    docs = make_docs([(i, " ".join(f"w{j}" for j in range(7 + i)), "en", "ab"[i % 2]) for i in range(40)] + [(i, *r) for i, (_, *r) in enumerate(odd_rows, 100)], clashing=True)
    mixed = m.mix(docs)
    out = m.materialise(docs, mixed)
    assert out.columns == [*docs.columns, "mix_epoch", "mix_words"]
    got = out.groupBy("doc_id").agg(F.sum(m.n_words(F.col("text"))).alias("n"), F.sum("mix_words").alias("k"), F.count("*").alias("c")).collect()
    taken = {r.doc_id: r for r in mixed.where("taken > 0").collect()}
    assert {r.doc_id: r.n for r in got} == {r.doc_id: r.k for r in got} == {i: r.taken for i, r in taken.items()}
    assert all(r.c == -(-taken[r.doc_id].taken // taken[r.doc_id].size) for r in got)


def test_materialised_mix_keeps_null_and_repeated_ids(make_docs):
    rows = [(None, f"n{i} " * (3 + i % 2), "en", "ab"[i % 3 == 0]) for i in range(12)] + [(7, f"r{i} x y", "en", "a") for i in range(3)]
    rows += [(8, "p q r s", "en", None)] * 2 + [(9, "one two", "en", "b"), (None, None, "en", "a"), (None, "", "en", None)]
    docs = make_docs(rows, clashing=True)
    mixed = m.mix(docs)
    out = m.materialise(docs, mixed).collect()
    goal = {r.source: int(r.target) for r in mixed.collect()}
    for s, n in goal.items():
        own = [r for r in out if r.source == s]
        assert sum(r.mix_words for r in own) == sum(size_of(r.text) for r in own) == n
    first = [r for r in out if r.mix_epoch == 0]
    assert len(first) == mixed.where("taken > 0").count()
    assert {r.text for r in first if r.doc_id == 7} <= {f"r{i} x y" for i in range(3)}
