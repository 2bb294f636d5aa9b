import random

import pytest
from pyspark.sql import functions as F

from textatlas.llm import line_dedup as l

WS = " \t\n\x0b\x0c\r"


def by_hand(rows, min_sites, keep_first):
    sites, first = {}, {}
    for i, t, _, s in rows:
        for pos, line in enumerate((t or "").split("\n")):
            if line.strip(WS):
                k = line.strip(WS)
                sites.setdefault(k, set()).update([s] if s is not None else [])
                place = (i is None, i or 0, pos)
                first[k] = min(first.get(k, place), place)
    out = []
    for i, t, _, s in rows:
        kept, n, gone = [], 0, 0
        for pos, line in enumerate((t or "").split("\n")):
            k = line.strip(WS)
            n += bool(k)
            if k and len(sites[k]) >= min_sites and not (keep_first and first[k] == (i is None, i or 0, pos)):
                gone += 1
            else:
                kept.append(line)
        out.append((i, None if t is None else "\n".join(kept) if gone else t, n, gone))
    return out


def made(n=80, seed=0):
    rnd = random.Random(seed)
    lines = [f"line {i}" for i in range(30)] + ["", " ", " line 1 ", "é\t"]
    return [(i, "\n".join(rnd.choice(lines[: rnd.choice([3, 34])]) for _ in range(rnd.choice([0, 1, 6]))), "en", f"s{rnd.randrange(14)}") for i in range(n)]


@pytest.mark.parametrize("limits", [{}, {"most_in_set": 0, "most_places": 3}])
@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("min_sites", [2, 8, 13])
def test_matches_brute_force(make_docs, odd_rows, keep_first, min_sites, limits):
    rows = made() + [(i if i is None else 1000 + i, t, g, s) for i, t, g, s in odd_rows]
    df = make_docs(rows, clashing=True)
    out = l.dedup_lines(df, min_sites=min_sites, keep_first=keep_first, **limits)
    assert set(out.columns) == set(df.columns) | {"n_lines", "n_removed"}
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=key)
    assert got == sorted(by_hand(rows, min_sites, keep_first), key=key)


def test_near_threshold_counts_are_exact(make_docs):
    """Far more sites than a sketch counts exactly: 1,000 against a threshold of 1,001 and of 1,000."""
    rows = [(i, "common", "en", f"s{i}") for i in range(1000)]
    for least, n in ((1001, 0), (1000, 999)):
        assert l.dedup_lines(make_docs(rows), min_sites=least).agg(F.sum("n_removed")).first()[0] == n


def test_repeated_rows_are_one_place(make_docs):
    rows = [(0, "x\ny", "en", "a")] * 2 + [(1, "x", "en", "b")]
    out = sorted((r.doc_id, r.text) for r in l.dedup_lines(make_docs(rows), min_sites=2).collect())
    assert out == [(0, "x\ny"), (0, "x\ny"), (1, "")]


def test_empty(make_docs):
    assert l.dedup_lines(make_docs([])).count() == 0


def test_one_copy_of_a_repeated_document_stays_whole(make_docs):
    text = "\n".join(f"paragraph {i} of a passage" for i in range(5))
    out = l.dedup_lines(make_docs([(i, text, "en", f"s{i}") for i in range(12)])).orderBy("doc_id").collect()
    assert out[0].text == text and all(r.text == "" for r in out[1:])
