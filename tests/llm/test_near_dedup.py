import random

import pytest

from textatlas.llm import near_dedup as n


def sets_by_hand(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)} - {()}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_by_hand(rows):
    """The first row of each component of pairs at 0.8, by comparing all."""
    sets, root = [sets_by_hand(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        k = find(i)
        if k not in best or (d is None, d or 0) < (rows[best[k]][0] is None, rows[best[k]][0] or 0):
            best[k] = i
    return sorted((rows[i][0] is None, rows[i][0] or 0, rows[i][1] or "") for i in best.values())


def edited(rnd, text, k):
    words = text.split()
    for _ in range(k):
        words[rnd.randrange(len(words))] = f"e{rnd.random()}"
    return " ".join(words)


@pytest.mark.parametrize("shard_rows", [4096, 7])
def test_links_between_members_of_a_large_shard_match_brute_force(spark, make_docs, shard_rows):
    """Many texts of one template, alike at about 0.6 to 0.9, so that no one member is like all others."""
    rnd = random.Random(11)
    base = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rnd.sample(range(200), rnd.choice([1, 3, 5, 6, 8])):
            words[at] = f"v{rnd.randrange(4)}"
        rows.append((i, " ".join(words)))
    # 40 bands of 2 miss no pair at 0.8 with odds of 1 in 10^17
    out = n.dedup(make_docs(rows), bands=40, rows=2, shard_rows=shard_rows)
    assert sorted((False, r.doc_id, r.text) for r in out.collect()) == kept_by_hand(rows)


@pytest.mark.parametrize("large", [False, True])
def test_stage_groups_match_brute_force(spark, make_docs, large):
    from textatlas.llm import pipeline

    rnd = random.Random(5)
    rows = []
    for g in range(1 if large else 12):
        base = " ".join(f"w{g}_{rnd.randrange(5000)}" for _ in range(300))
        # one to six of 300 words changed: Jaccard with the base about 0.97 to 0.82, beyond 3 bits for many
        rows += [(len(rows) + i, edited(rnd, base, 3 if large else i)) for i in range(60 if large else 9)]
    rows += [(None, "one two"), (900, "One  two"), (901, "one three"), (902, None), (903, " "), (904, "a b c d e"), (904, "a b c d f")]
    out = pipeline.near_dedup_stage(spark, make_docs(rows), None)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect())
    assert got == kept_by_hand(rows)


def test_no_similar_pair_stays_where_a_bucket_is_split(spark, make_docs):
    docs = make_docs([(i, " ".join(f"x{j}" for j in range(100)) + f" end{i}") for i in range(90)])
    assert [r.doc_id for r in n.dedup(docs).collect()] == [0]
    assert n.dedup(docs.limit(0)).count() == 0
