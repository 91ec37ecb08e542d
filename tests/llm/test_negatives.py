"""Hard negatives against brute force over all pairs, in whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.llm import negatives


def cases():
    rng = np.random.default_rng(7)
    middle = rng.standard_normal((6, 12))
    rows = [(i, (middle[i % 6] + 0.4 * rng.standard_normal(12)).tolist(), int(rng.integers(0, 4))) for i in range(420)]
    rows += [(500 + i, rows[3][1], 1) for i in range(60)]  # many copies, of several labels, anchors among them
    rows += [(600 + i, rows[3][1], 2) for i in range(9)]
    rows += [(700 + i, [0.0] * 12, i % 2) for i in range(8)]  # all scores are 0
    rows += [(750, None, 1), (751, [1.0] * 12, None), (None, [1.0] * 12, 1), (753, [math.nan] * 12, 1), (754, [math.inf] + [1.0] * 11, 0), (755, [None] + [1.0] * 11, 0), (756, [], 0), (757, [], 1)]
    rows += [(800, [1.0, 2.0], 0), (801, [2.0, 4.0], 0), (802, [1.5, 1.5], 1), (850, [1.0, 1.9], 0), (803, [1.0, 2.0, 3.0], 0)]
    rows += [(900, [3e6] * 12, 0), (901, [2.9e6] * 12, 0), (902, [1.9e6] * 12, 1), (903, [1e20] * 12, 1), (904, [-3e6] * 12, 0), (950, [2e6] * 11 + [1e6], 0)]
    rows += [rows[5], rows[5], (7, rows[50][1], rows[7][2]), (50, rows[100][1], 3)]  # repeated rows, one id for different vectors
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(cases(), "vec_id long, embedding array<double>, label int").withColumn("v", F.lit(1)).withColumn("item", F.lit("x")).withColumn("place", F.lit(2))


def brute(rows, every, positives, k, low, high):
    ok = set()
    for i, v, label in rows:
        if i is not None and label is not None and v and None not in v and all(map(math.isfinite, v)):
            x = tuple(math.floor(256 * c) for c in v)
            if sum(c * c for c in x) < 1 << 62:
                ok.add((i, label, x))
    out = []
    for a in ok:
        if a[0] % every:
            continue
        score = {b: sum(x * y for x, y in zip(a[2], b[2], strict=True)) for b in ok if b != a and len(b[2]) == len(a[2])}
        order = sorted(score, key=lambda b: (-score[b], b[0]))
        for p in [b for b in order if b[1] == a[1]][:positives]:
            fit = [b for b in order if b[1] != a[1] and low * score[p] <= 100 * score[b] <= high * score[p]][:k]
            out += [(a[0], p[0], r + 1, n[0], score[p], score[n]) for r, n in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block, leaves, how", [(2048, 1024, (5, 3, 50, 95)), (16, 64, (5, 3, 50, 95)), (40, 4, (2, 7, 20, 120))])
def test_rows(table, block, leaves, how, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 12 if block < 2048 else 128)
    positives, k, low, high = how
    got = negatives.mine(table, table.filter("vec_id % 25 = 0"), positives, k, low, high, block=block, leaves=leaves)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(cases(), 25, positives, k, low, high)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_nothing(spark, table):
    empty = spark.createDataFrame([], table.schema)
    assert negatives.mine(empty, empty).count() == 0
    assert negatives.mine(table, empty).count() == 0
    assert negatives.mine(empty, table).count() == 0


def test_bounds():
    """No row is nearer or further than the bounds of its leaf say, and nearest-first order needs few leaves where rows lie in groups."""
    rng = np.random.default_rng(2)
    x = np.floor(256 * np.concatenate([c + 0.1 * rng.standard_normal((300, 16)) for c in rng.standard_normal((12, 16))]))
    x = x[rng.permutation(len(x))]
    top = float((x * x).sum(1).max())
    tree = negatives.Tree(negatives.augmented(x[:600], top), 5)
    leaf, path = tree.descend(negatives.augmented(x, top))
    q = x[:50] * 1.5 + 3
    least, most = tree.bounds(q, top, *tree.spans(leaf, path))
    far = np.sqrt((q * q).sum(1)[:, None] + top - 2 * q @ x.T)
    assert (least[:, leaf] <= far + 1e-6).all() and (most[:, leaf] >= far - 1e-6).all()
    kth = np.sort(far, 1)[:, 5]
    assert (least <= kth[:, None]).mean() < 0.5
