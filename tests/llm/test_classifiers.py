"""Toxicity network and quality classifier: gradients, held-out accuracy, odd inputs."""

import random
import zlib

import numpy as np
import pytest

from textatlas.llm import pu_quality as p
from textatlas.llm import toxicity as x

BAD = ["blarg", "snirkle", "vrump"]


def plain(rnd, n):
    return [rnd.choice("abcdefgh") + rnd.choice(["ou", "est", "ing"]) + rnd.choice(["", "er", "ly"]) for _ in range(n)]


def toxic_docs(n, seed=0):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        words, bad = plain(rnd, rnd.choice([12, 60, 120])), i % 3 == 0
        for _ in range(len(words) // 12 if bad else 0):
            words[rnd.randrange(len(words))] = rnd.choice(BAD) + rnd.choice(["", "s", "er"])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_gradients():
    rng = np.random.default_rng(0)
    q = {k: v.astype(np.float64) for k, v in x.new_parameters().items()}
    vocab = x.Vocabulary.of(["abc", "de", "f", "ghij"])
    at, mask = rng.integers(0, 4, (x.WINDOW, 3)), (np.arange(x.WINDOW)[:, None] < np.array([32, 5, 9])).astype(float)
    y, w = np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def loss():
        z = x.forward(q, x.word_gates(q, vocab.inputs(q)), at, mask)
        return float(((np.logaddexp(0, z) - y * z) * w).sum() / w.sum())

    g = x.gradients(q, vocab, at, mask, y, w)
    for k in q:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = q[k][i]
        q[k][i] = old + 1e-5
        high = loss()
        q[k][i] = old - 1e-5
        low = loss()
        q[k][i] = old
        assert g[k][i] == pytest.approx((high - low) / 2e-5, rel=1e-3, abs=1e-6), k


def test_windows_cover_every_word_twice_inside():
    for n in (0, 1, 16, 32, 33, 48, 49, 200):
        cover = np.zeros(n, dtype=int)
        for s in x.windows_of(n):
            cover[s : s + x.WINDOW] += 1
        assert n == 0 or cover.min() >= 1


@pytest.fixture(scope="module")
def toxicity_result(spark, make_docs, odd_rows):
    rows = toxic_docs(900)
    docs = make_docs([(i, t) for i, t, _ in rows] + [(i if i is None else 5000 + i, *r) for i, *r in odd_rows], clashing=True)
    labels = labels_of(spark, [(i, 1, y) for i, _, y in rows] + [(0, 1, 1), (None, None, None), (7, None, None)])
    return rows, x.toxicity(docs, labels).collect()


def test_toxicity_held_out(toxicity_result):
    rows, out = toxicity_result
    y = {i: v for i, _, v in rows}
    held = [r for r in out if r.held_out and r.doc_id in y]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)


def test_toxicity_odd_rows(toxicity_result, odd_rows):
    _, out = toxicity_result
    odd = [r for r in out if r.doc_id is None or r.doc_id >= 5000]
    assert len(odd) == len(odd_rows)
    assert all(r.score == 0 for r in odd if r.doc_id in (5001, 5002, 5003, 5008))


def test_toxicity_finds_one_word_in_a_long_text(spark, make_docs):
    rows = toxic_docs(600)
    model = x.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    rnd = random.Random(9)
    clean = plain(rnd, 20_000)
    marked = clean[:15_000] + ["snirkle", "blarg"] + clean[15_000:]
    a, b = model.scores([" ".join(clean), " ".join(marked)])
    assert b > 0.7 > a


@pytest.mark.parametrize("rare", [0, 1])
def test_few_of_a_class_at_any_place(rare):
    rnd = random.Random(3)
    texts = [" ".join(plain(rnd, 20)) for _ in range(12)]
    for places in [(i,) for i in range(12)] + [(i, i + 1) for i in range(11)] + [(i, i + 1, i + 2) for i in range(10)]:
        y = np.array([rare if i in places else 1 - rare for i in range(12)])
        z = x.fit(texts, y, epochs=4, per_epoch=8, batch=8).scores(texts)
        assert ((z >= 0) & (z <= 1)).all()


def test_calibration_fold_leaves_some_of_each_class():
    for n in (1, 9, 10, 50):
        y = np.array([1] * n + [0] * 200)
        fold = x.calibration_fold(y, np.random.default_rng(0))
        assert fold[:n].sum() == (n // 5 if n >= 10 else 0) and fold[n:].sum() == 40


def test_extract_covers_long_texts():
    words = [f"w{i}" for i in range(5000)]
    got = x.extract(" ".join(words), 800, 8).split()
    assert len(got) == 800 and got[0] == "w0" and got[-1] == "w4999"
    assert x.extract("A b", 800) == "a b" and x.extract(" ", 8) is None and x.extract(None, 8) is None


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(None, None, None)]])
def test_little_to_learn_from(spark, make_docs, labels):
    docs, marks = make_docs([(1, "a b c"), (2, None)]), labels_of(spark, labels) if labels else spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert x.toxicity(docs, marks).count() == 2 and p.quality(docs, marks).count() == 2
    assert x.toxicity(make_docs([]), marks).count() == 0 and p.quality(make_docs([]), marks).count() == 0


def quality_docs(n, seed=0):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        words, bad = plain(rnd, rnd.choice([30, 80, 200])), i % 5 == 0
        if bad:
            words = [w + "***" for w in words] if i % 2 else [w for w in words[:9] for _ in range(15)]
        rows.append((i, " ".join(words).capitalize() + ".", int(not bad)))
    return rows


def test_quality_held_out(spark, make_docs, odd_rows):
    rows = quality_docs(1500)
    docs = make_docs([(i, t) for i, t, _ in rows] + [(i if i is None else 5000 + i, *r) for i, *r in odd_rows], clashing=True)
    marks = labels_of(spark, [(i, y, 0) for i, _, y in rows if i % 2 == 0])
    out = p.quality(docs, marks).collect()
    y = {i: v for i, _, v in rows}
    held = [r for r in out if r.held_out and r.doc_id in y]
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.95
    odd = {r.doc_id: r for r in out if r.doc_id is not None and r.doc_id >= 5000}
    assert all(odd[i].score == 0 for i in (5001, 5002, 5003)) and len(out) == len(rows) + len(odd_rows)


def test_negative_labels_are_not_used(spark, make_docs):
    rows = quality_docs(400)
    docs = make_docs([(i, t) for i, t, _ in rows])
    marks = [(i, y, 0) for i, _, y in rows]
    a = p.quality(docs, labels_of(spark, marks)).orderBy("doc_id").collect()
    b = p.quality(docs, labels_of(spark, [m for m in marks if m[1]])).orderBy("doc_id").collect()
    assert [r.score for r in a] == [r.score for r in b]


def normal_rows(n_pos=1500, n_unl=2500, bad=750, seed=0):
    rng = np.random.default_rng(seed)
    d = p.DENSE + p.SHAPES
    pos, unl = rng.normal(0, 1, (n_pos, d)), rng.normal(0, 1, (n_unl, d))
    unl[:bad, :5] += 4
    pos[:, 5] = unl[:, 5] = 0.6  # texts of some hundred words
    return pos, unl


def test_prior_is_near_the_truth():
    pos, unl = normal_rows()
    mean, scale = pos.mean(axis=0), pos.std(axis=0) + 0.05
    z = lambda x: p.second_moments(p.inputs(x, mean, scale))
    first = p.Model(mean, scale, p.fit_nnpu(z(pos[::2]), z(unl[::2]), 0.5), 0.5)
    scores, others = first.logits(pos[1::2]), first.logits(unl[1::2])
    at = np.quantile(scores, np.linspace(0.02, 0.7, 35))
    above = np.array([(others >= t).sum() for t in at])
    assert p.prior_of(scores, above, len(others), at) == pytest.approx(0.7, abs=0.06)


@pytest.mark.parametrize("n_pos, n_unl, prior", [(1500, 2500, 0.3), (60, 80, 0.7)])
def test_the_risk_is_least(n_pos, n_unl, prior):
    """Against the risk by its definition, row by row; the few rows make the unbiased estimate of the negative part fall below 0."""
    pos, unl = normal_rows(n_pos, n_unl, n_unl // 3)
    mean, scale = pos.mean(axis=0), pos.std(axis=0) + 0.05
    zp, zu = p.inputs(pos, mean, scale), p.inputs(unl, mean, scale)
    ridge = 1e-2

    def whole(w):
        loss = lambda z, y: np.mean((1 - y * (z @ w)) ** 2) / 4
        return prior * loss(zp, 1) + max(0.0, loss(zu, -1) - prior * loss(zp, -1)) + ridge * w @ w / 4

    w = p.fit_nnpu(p.second_moments(zp), p.second_moments(zu), prior, ridge)
    unbiased = np.linalg.solve(p.second_moments(zu) + ridge * np.eye(len(w)), 2 * prior * zp.mean(axis=0) - zu.mean(axis=0))
    assert whole(w) <= whole(unbiased) + 1e-9
    assert np.allclose(w, unbiased) == (n_pos == 1500)
    rng = np.random.default_rng(1)
    for size in (1e-1, 1e-2, 1e-3):
        assert all(whole(w + size * rng.normal(size=len(w)) / np.sqrt(len(w))) >= whole(w) - 1e-7 for _ in range(50))


def test_moments_are_of_every_unlabelled_row(spark):
    x = np.random.default_rng(0).normal(0, 1, (5000, p.DENSE + p.SHAPES)).astype(np.float32)
    rows = spark.createDataFrame([(i % 2, x[i].tobytes()) for i in range(5000)], "half int, x binary").repartition(7)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.05
    got = p.unlabelled_moments(rows, mean, scale)
    z = p.inputs(x.astype(np.float64), mean, scale)
    assert np.allclose(got[0], z[::2].T @ z[::2]) and np.allclose(got[1], z[1::2].T @ z[1::2])
    model = p.Model(mean, scale, np.ones(len(got[0])), 0.5)
    above, n = p.counts_above(rows, model, np.array([-1e9, 0.0]))
    assert n == 5000 and above.tolist() == [5000, (model.logits(x.astype(np.float64)) >= 0).sum()]
