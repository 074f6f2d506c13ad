"""Hard negatives against all pairs, with ties, repeated rows, hot vectors and rows that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from agestack.llm import negatives


def brute(rows, is_anchor):
    x = np.floor(np.array([v for _, _, v in rows]) * 256).astype(np.int64)
    rank = lambda c: (-c[0], c[1] is None, c[1] or 0)
    out = []
    for a, (anchor, label, _) in enumerate(rows):
        if anchor is None or not is_anchor(anchor):
            continue
        scores = [(int(x[a] @ x[b]), rows[b][0], rows[b][1]) for b in range(len(rows)) if b != a]
        for p, positive, _ in sorted((s for s in scores if s[2] == label), key=rank)[:5]:
            fit = sorted((s for s in scores if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p), key=rank)[:3]
            out += [(anchor, positive, i + 1, n, p, s) for i, (s, n, _) in enumerate(fit)]
    return sorted(out, key=repr)


def run(spark, rows, every=5):
    full = [(i, lab, v, "x", 1, 2) for i, lab, v in rows]
    frame = spark.createDataFrame(full, "vec_id long, label int, embedding array<double>, block string, row long, rank int")
    out = negatives.hard_negatives(frame.repartition(3), F.col("vec_id") % every == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()), key=repr)


def made(n, dims=8, labels=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0.6, 1, (n, dims)).round(2)
    return [(i, int(rng.integers(0, labels)), x[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("block,lane", [(1024, 64), (16, 2), (7, 64)])
def test_against_all_pairs(spark, monkeypatch, block, lane):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "LANE_BLOCKS", lane)
    rows = made(230)
    want = brute(rows, lambda i: i % 5 == 0)
    assert len(want) > 300 and run(spark, rows) == want


def test_ties_repeats_and_no_ids(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 16)
    rows = made(60, dims=3, labels=2)
    rows = [(i, lab, [round(c * 2) / 2 for c in v]) for i, lab, v in rows]  # many equal scores
    rows += [rows[10]] * 2 + [(None, 0, rows[3][2]), (None, 1, rows[4][2])] + [(100 + i, 1, [1.0, 1.0, 0.5]) for i in range(30)]
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_rows_that_take_no_part(spark):
    rows = made(80, dims=4)
    odd = [(200, None, [1.0] * 4), (205, 1, None), (210, 1, [1.0, None, 1.0, 1.0]), (215, 1, [float("nan")] * 4), (220, 2, [float("inf")] * 4),
           (225, 2, []), (230, 2, [1.0] * 5), (235, 3, [1e30] * 4)]
    assert run(spark, rows + odd) == brute(rows, lambda i: i % 5 == 0)


def test_nothing_to_find(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []  # no anchor
    assert run(spark, [(0, 1, [1.0]), (1, 2, [0.8])]) == []  # no positive
    assert run(spark, [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-0.8])]) == []  # a negative score
    assert run(spark, [(0, 1, [1.0]), (1, 1, [0.0]), (2, 2, [0.0])]) == [(0, 1, 1, 2, 0, 0)]
    assert run(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == []  # no other label
