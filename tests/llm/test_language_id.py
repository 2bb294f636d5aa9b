import zlib

import pytest
from pyspark.sql import functions as F

from textatlas.llm import language_id as l

WORDS = {
    "en": "the of and to in that with this from have which were their".split(),
    "de": "der die und nicht eine werden über zwischen auch für größer schön".split(),
    "fr": "les des une dans pour avec être très où leur après même".split(),
    "es": "los las una para con niño también qué más español años".split(),
}


def made(n, first=0):
    import random

    rnd, rows = random.Random(first), []
    for i in range(n):
        lang = sorted(WORDS)[i % 4]
        rows.append((first + i, " ".join(rnd.choice(WORDS[lang]) for _ in range(12)), lang, "s"))
    return rows


def test_held_out_accuracy(make_docs):
    out = l.language_id(make_docs(made(400))).join(make_docs(made(400)).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_learns_from_allowed_rows_only(make_docs):
    rows = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s) for i, t, lang, s in made(200)]
    assert not l.language_id(make_docs(rows)).where("lang_pred = 'xx'").count()


def test_odd_rows(make_docs, odd_rows):
    out = l.language_id(make_docs(made(80, 100) + odd_rows, clashing=True)).where("doc_id < 100 or doc_id is null").collect()
    assert len(out) == len(odd_rows)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 8)) and by[4].lang_pred != "und"


@pytest.mark.parametrize("rows", [[], [(1, "text", None, "s")], [(1, "a b", "en", "s"), (3, "c d", "en", "s")]])
def test_little_to_learn_from(make_docs, rows):
    out = l.language_id(make_docs(rows))
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and out.count() == len(rows)


def test_chunks_don_t_change_features(monkeypatch):
    text = "Größere Häuser, and then some; où 12 été " * 40
    whole = l.features(text)
    monkeypatch.setattr(l, "_CHUNK", 64)
    assert abs(whole - l.features(text)).max() < 0.05 and whole is not None
    assert l.features("123 !?") is None


def test_three_languages_of_a_family_are_voted_on(make_docs):
    rows = made(200) + [(1000 + i, " ".join(["het", "een", "niet", "zijn", "voor", "ook"][j % 6] for j in range(i, i + 9)), "nl", "s") for i in range(60)]
    df = make_docs(rows)
    out = l.identify(df, l.train(df, F.lit(True))).where("predicted.lang_pred = lang").count()
    assert out / len(rows) > 0.97
