import numpy as np
import pytest

from busloom.llm import graph, itq


def test_links_match_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base, base[:20] + 0.1 * rng.standard_normal((20, 16)), base[:5] + 0.15 * rng.standard_normal((5, 16)), base[:3]]).astype(np.float32)
    rows = [(i * 2, [float(v) for v in e], 0) for i, e in enumerate(x)]
    odd = [(901, None, 0), (902, [0.0] * 16, 0), (903, [], 0), (904, [float("nan")] * 16, 0), (905, [None] * 16, 0), (906, [1.0, 2.0], 0), (None, rows[0][1], 0), (907, [float("inf")] * 16, 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in itq.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([min([label[i], *label[linked[i]]]) for i in range(len(x))])
    want = {i * 2: (int(linked[i].sum()), int(label[i]) * 2, label[i] == i) for i in range(len(x))}
    assert sum(got[i] == w for i, w in want.items()) >= 0.9 * len(want)
    assert sum(got[i][0] for i in want) <= linked.sum()
    for i in (901, 902, 903, 904, 905, 906, 907):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, True)


def _brute(x):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.arange(len(x))
    while (new := np.array([min([label[i], *label[linked[i]]]) for i in range(len(x))])).tolist() != label.tolist():
        label = new
    return linked, label


@pytest.mark.parametrize("block", [7, 1000])
def test_clusters_in_blocks_and_recall(spark, block):
    """Large clusters, whose links are counted in blocks, beside pairs right at the threshold."""
    rng = np.random.default_rng(2)
    centre, loose = rng.standard_normal((3, 32)), rng.standard_normal((150, 32))
    tight = np.concatenate([c + 0.15 * rng.standard_normal((60, 32)) for c in centre])
    turned = rng.standard_normal((150, 32))
    turned -= (turned * loose).sum(1, keepdims=True) / (loose**2).sum(1, keepdims=True) * loose
    turned *= np.linalg.norm(loose, axis=1, keepdims=True) / np.linalg.norm(turned, axis=1, keepdims=True)
    x = np.concatenate([tight, loose, 0.905 * loose + np.sqrt(1 - 0.905**2) * turned, tight[:4]])
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)]
    got = {r.vec_id: r for r in itq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=block).collect()}
    linked, label = _brute(x)
    for i in [*range(180), *range(480, 484)]:
        assert (got[i].n_links, got[i].component_id) == (linked[i].sum(), label[i])
    assert all(got[i].n_links <= linked[i].sum() for i in got)
    assert sum(got[i].n_links for i in range(180, 480)) >= 0.9 * linked[180:480].sum()  # measured recall at cosine 0.905


def test_empty_table(spark):
    assert itq.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(50)] + [(200 - i, 199 - i) for i in range(20)] + [(300, 300)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 180 for i in range(180, 201)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
