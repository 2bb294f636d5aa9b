"""Density clustering on blobs with noise, and its parts against brute force."""

import numpy as np
import pytest

from textatlas.operators.topics import clusters, density


def blobs(rng, sizes, noise, dims=3):
    centres = rng.uniform(-20, 20, (len(sizes), dims))
    while min(np.linalg.norm(a - b) for i, a in enumerate(centres) for b in centres[:i]) < 10:
        centres = rng.uniform(-20, 20, (len(sizes), dims))
    x = [rng.normal(c, 0.5, (n, dims)) for c, n in zip(centres, sizes)]
    truth = np.repeat(np.arange(len(sizes)), sizes)
    return np.concatenate([*x, rng.uniform(-40, 40, (noise, dims))]), np.concatenate([truth, np.full(noise, -1)])


def test_core_distances_and_spanning_tree():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = density.core_distances(x, x, 5)
    assert np.allclose(core, np.sort(d, axis=1)[:, 4], atol=1e-6)
    reach = np.maximum(np.maximum(d, core[:, None]), core)
    edges = density.spanning_tree(x, core)
    # Kruskal
    parent, total = list(range(40)), 0.0

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for w, i, j in sorted((reach[i, j], i, j) for i in range(40) for j in range(i)):
        if find(i) != find(j):
            parent[find(i)] = find(j)
            total += w
    assert len(edges) == 39 and sum(e[0] for e in edges) == pytest.approx(total, rel=1e-6)


@pytest.mark.parametrize("seed", range(5))
def test_blobs_are_found(seed):
    rng = np.random.default_rng(seed)
    x, truth = blobs(rng, [80, 50, 30], 15)
    labels, _, held = density.density_labels(x, 15)
    assert len(held) == 3
    for t in range(3):
        own = labels[truth == t]
        best = np.bincount(own[own >= 0]).argmax()
        assert (own == best).mean() > 0.9 and (labels[truth != t] == best).sum() <= 3
    assert (labels[truth == -1] == -1).mean() > 0.7


def test_outliers_follow_density_and_not_a_share():
    rng = np.random.default_rng(1)
    for noise in (0, 40):
        x, _ = blobs(rng, [100, 100], noise)
        labels, *_ = density.density_labels(x, 15)
        assert abs((labels == -1).sum() - noise) <= 22


def test_small_inputs():
    for n in (0, 1, 4):
        labels, core, held = density.density_labels(np.zeros((n, 2)), 5)
        assert (labels == -1).all() and len(held) == 0 and len(core) == n


@pytest.mark.parametrize("most", [5000, 100])
def test_every_point_is_placed(spark, most):
    rng = np.random.default_rng(2)
    x, truth = blobs(rng, [200, 120], 10)
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)] + [(9999, None)]
    df = spark.createDataFrame(rows, "doc_id int, v array<double>").repartition(3)
    got = {r.doc_id: r.topic for r in density.cluster_density(df, "v", 15, most_sample=most).collect()}
    assert len(got) == len(rows) and got[9999] == -1
    for t in (0, 1):  # by falling size
        assert np.mean([got[i] == t for i in np.flatnonzero(truth == t)]) > 0.85
    assert density.cluster_density(df.limit(0), "v", 5).count() == 0


def test_two_step_projection_and_clusters(spark):
    rng = np.random.default_rng(3)
    x, _ = blobs(rng, [90, 60], 0, dims=16)
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "doc_id int, embedding array<double>")
    out = clusters.density_topics(df, "embedding", 15)
    assert out.columns == ["doc_id", "embedding", "topic"] and out.where("topic >= 0").select("topic").distinct().count() == 2


def test_placing_needs_little_memory_and_breaks_ties_by_distance():
    import tracemalloc

    rng = np.random.default_rng(1)
    x, v = np.round(rng.normal(size=(2000, 3)), 1), np.round(rng.normal(size=(512, 3)), 1)
    core, labels, held = density.core_distances(x, x, 5), np.arange(2000) % 4 - 1, np.array([0.2, 0.5, 9.0])
    d = density._distances(v, x)
    reach = np.maximum(np.maximum(d, np.partition(d, 4, axis=1)[:, 4][:, None]), core)
    near = np.lexsort((d, reach), axis=1)[:, 0]
    want = [labels[n] if labels[n] >= 0 and reach[i, n] <= held[labels[n]] * (1 + 1e-9) else -1 for i, n in enumerate(near)]
    tracemalloc.start()
    got = density.placed_among(v, x, labels, core, held, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == want and peak < d.nbytes  # blocks, never all rows by all points
