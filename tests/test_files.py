"""Hash trees of files against hashlib, and a file beyond the size Spark reads whole."""

import hashlib

import pytest

from agestack.sources.files import RANGE_BYTES, file_trees


def _tree(data: bytes, size: int, fan: int) -> str:
    nodes = [hashlib.sha256(data[i:i + size]).hexdigest() for i in range(0, max(len(data), 1), size)]
    while len(nodes) > 1:
        nodes = [hashlib.sha256("".join(nodes[i:i + fan]).encode()).hexdigest() for i in range(0, len(nodes), fan)]
    return nodes[0]


@pytest.mark.parametrize(("size", "fan"), [(3, 2), (10, 3), (1000, 4)])
def test_trees(spark, tmp_path, size, fan):
    (tmp_path / "below").mkdir()
    want = {}
    for i, n in enumerate([0, 1, 2, 3, 4, 9, 30, 31, 100]):
        data = bytes((7 * i + j) % 256 for j in range(n))
        (tmp_path / "below" / f"f {i}.bin").write_bytes(data)
        if n:  # Spark's scan passes over empty files
            want[f"f {i}.bin"] = (n, _tree(data, size, fan))
        if 0 < n <= size:
            assert want[f"f {i}.bin"][1] == hashlib.sha256(data).hexdigest()
    got = {r["file"]: (r["length"], r["digest"]) for r in file_trees(spark, str(tmp_path), "*.bin", size, fan).collect()}
    assert got == want


def test_file_of_three_gigabytes(spark, tmp_path):
    with open(tmp_path / "sparse.bin", "wb") as file:
        file.truncate(48 * RANGE_BYTES + 5)
    row = file_trees(spark, str(tmp_path)).first()
    zeros = hashlib.sha256(bytes(RANGE_BYTES)).hexdigest()
    assert (row["length"], row["n_ranges"]) == (48 * RANGE_BYTES + 5, 49)
    assert row["digest"] == hashlib.sha256((zeros * 48 + hashlib.sha256(bytes(5)).hexdigest()).encode()).hexdigest()
