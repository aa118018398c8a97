import numpy as np
import pytest

from marlstone.llm import embedjoin


def test_near_boxes_equal_all_pairs(spark):
    rnd = np.random.default_rng(4)
    for dimensions, eps, spread in ((1, 0.3, 0.2), (3, 0.31, 0.3), (8, 0.05, 0.4), (2, 1e-6, 0.1)):
        low = rnd.uniform(-1, 1, (60, dimensions)).round(2)
        high = np.minimum(1, low + rnd.uniform(0, spread, low.shape).round(2))
        box = spark.createDataFrame([(k << 32, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(low, high))], "block long, low array<double>, high array<double>")
        got = sorted((r["a"] >> 32, r["b"] >> 32) for r in embedjoin.near_boxes(box, dimensions, eps).collect())
        assert got == [(i, j) for i in range(60) for j in range(i, 60) if embedjoin.apart(low[i], high[i], low[j], high[j]) <= eps * (1 + 1e-9)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_many_blocks_equal_brute_force(spark, monkeypatch, kind):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(40, 6))
    rows = (centres[rnd.integers(0, 40, 900)] + 0.12 * rnd.normal(size=(900, 6))).astype(np.float32).astype(np.float64)
    rows[700:720] = rows[3]
    monkeypatch.setattr(embedjoin, "BLOCK", 8)
    monkeypatch.setattr(embedjoin, "TILE", 4)
    assert embedjoin.ranges(881, 6) > 40
    data = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], f"vec_id long, embedding array<{kind}>")
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedjoin.near_duplicates(data, least=0.95).collect()}
    units = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    linked = units @ units.T >= 0.95
    np.fill_diagonal(linked, False)
    root = np.arange(len(rows))
    while True:
        least = np.where(linked, root[None, :], len(rows)).min(axis=1)
        if (least >= root).all():
            break
        root = np.minimum(root, least)
    assert got == {i: (int(linked[i].sum()), int(root[i]), bool(root[i] == i)) for i in range(len(rows))}
