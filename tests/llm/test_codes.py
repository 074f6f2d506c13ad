"""Vector codes: the pivot search against all distances, edge cases, and tables of many labels."""

import hashlib

import numpy as np
import pytest

from agestack.llm import codes


def brute(rows):
    """``(vec_id, code, error, label_error)`` sorted, and the digest; rows in the order of their seeds."""
    x = np.floor(np.array([v for _, _, v in rows]) * 256).astype(np.int64).reshape(len(rows), 16, -1)
    books = x[:64].swapaxes(0, 1).copy()

    def assign():
        far = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return far.argmin(axis=2), far.min(axis=2)

    for _ in range(2):
        number, _ = assign()
        for p in range(16):
            for e in range(books.shape[1]):
                own = x[number[:, p] == e, p]
                if len(own):
                    books[p, e] = np.floor_divide(own.sum(axis=0), len(own))
    number, far = assign()
    error = far.sum(axis=1).tolist()
    labels = [lab for _, lab, _ in rows]
    sums = {lab: sum(e for e, x in zip(error, labels) if x == lab) for lab in set(labels)}
    out = [(i, bytes(n.astype(np.uint8)).hex(), e, sums[lab]) for (i, lab, _), n, e in zip(rows, number, error)]
    return sorted(out, key=repr), hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def frame(spark, rows):
    full = [(i, lab, v, "x", 1, "y") for i, lab, v in rows]
    return spark.createDataFrame(full, "vec_id long, label int, embedding array<float>, code string, error long, part string")


def made(n, dims=32, seed=0, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    x = ((centres[rng.integers(0, 12, n)] + 0.2 * rng.normal(size=(n, dims))) * scale).astype(np.float32)
    return [(i, None if i % 9 == 0 else i % 4, [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("n,dims,scale", [(700, 32, 1.0), (65, 16, 100.0), (40, 64, 0.01), (1, 16, 1.0), (300, 48, 200_000.0)])
def test_against_all_distances(spark, n, dims, scale):
    rows = made(n, dims, scale=scale / 4)
    got = codes.compress(frame(spark, rows[::-1]).repartition(5)).collect()
    want, digest = brute(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_rows_left_out_ties_and_repeats(spark):
    rows = made(100)
    odd = [(-5, 1, None), (-4, 1, []), (-3, 1, [1.0] * 31 + [None]), (-2, 1, [float("nan")] + [1.0] * 31), (-1, 2, [float("inf")] * 32),
           (-6, 1, [1.0] * 16), (-7, 1, [3e38] * 32)]
    again = [(7, 3, rows[0][2])] * 3 + [(None, None, rows[5][2]), (200, 1, rows[5][2])]
    got = codes.compress(frame(spark, odd + rows + again)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    want, digest = brute(sorted(rows + again, key=key))
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_equal_vectors_take_the_first_entry(spark):
    rows = [(i, 1, [0.5] * 16) for i in range(70)]
    got = codes.compress(frame(spark, rows)).collect()
    assert {(r.code, r.error, r.label_error) for r in got} == {("00" * 16, 0, 0)}


def test_no_rows_and_refused_length(spark):
    none = codes.compress(frame(spark, []))
    assert none.collect() == [] and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codes.compress(frame(spark, [(1, 1, None)])).collect() == []
    with pytest.raises(ValueError):
        codes.compress(frame(spark, [(1, 1, [1.0] * 17)]))


def test_many_labels(spark, monkeypatch):
    monkeypatch.setattr(codes, "small", lambda df: df)
    rows = made(200)
    want, _ = brute(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in codes.compress(frame(spark, rows)).collect()), key=repr) == want


def test_pivots_prune():
    rng = np.random.default_rng(4)
    entries = rng.integers(-300, 300, (64, 4))
    x = entries[rng.integers(0, 64, 4000)] + rng.integers(-30, 30, (4000, 4))
    pivots = codes.choose_pivots(entries)
    number, best, looked = codes.nearest(x, codes.distances(x, pivots), entries, pivots)
    every = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert looked < 0.2 * every.size
