"""Wide files by tiles: equal to the route over cells, plans that do not grow, and refused inputs."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from agestack.operators import align
from agestack.plans.assembly import assemble, assemble_files
from agestack.session import settle
from agestack.sources import wide
from agestack.sources.tables import load_table


def _write(path, n, p, seed=0, first=0, group=7, extra=None):
    """A file of ``p`` feature columns with gaps, metadata and a text column between them."""
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(n, p)).astype(np.float64)
    gaps = rng.random((n, p)) < 0.1
    columns = {"Sample_ID": pa.array([f"s{first + i}" for i in range(n)]), "Age": pa.array(np.arange(n, dtype=np.float64)),
               "note": pa.array(["x"] * n), "tissue": pa.array(np.arange(n))}
    for j in range(p):
        columns[f"cg{j:06d}"] = pa.array(values[:, j], mask=gaps[:, j])
    columns.update(extra or {})
    pq.write_table(pa.table(columns), path, row_group_size=group)
    return np.where(gaps, np.nan, values).astype(np.float32)


def _rows(packed):
    return {r["sample_id"]: np.array([np.nan if v is None else v for v in r["values"]], dtype=np.float32) for r in packed.collect()}


@pytest.mark.parametrize("tile", [1, 50, 1 << 22])
def test_tiles_give_the_same_rows(spark, tmp_path, tile):
    want = _write(f"{tmp_path}/a.parquet", 23, 31)
    layouts = settle(wide.file_layouts(spark, f"{tmp_path}/a.parquet"))
    found = wide.feature_names(layouts, "beta")
    assert sorted(found) == [f"cg{j:06d}_beta" for j in range(31)]
    columns = [found[f] for f in sorted(found)]
    packed = wide.gather(wide.file_pieces(layouts, columns, 0, tile), [list(range(31))], 31)
    got = _rows(packed)
    assert len(got) == 23
    for i in range(23):
        np.testing.assert_array_equal(got[f"s{i}"], want[i])


def test_wide_file_has_a_plan_of_constant_size(spark, tmp_path):
    sizes = []
    for p in (30, 3000):
        want = _write(f"{tmp_path}/{p}.parquet", 12, p)
        made = wide.read_packed(spark, f"{tmp_path}/{p}.parquet", "chalm")
        sizes.append(len(made.packed._jdf.queryExecution().toString()))
        got = _rows(made.packed)
        np.testing.assert_array_equal(np.stack([got[f"s{i}"] for i in range(12)]), want)
    assert sizes[1] < 1.1 * sizes[0]


def test_equal_to_the_route_over_cells(spark, tmp_path):
    """Files of a folder with other columns, ids in some tables only, a component table, an order with unknown features."""
    (tmp_path / "beta").mkdir()
    _write(f"{tmp_path}/beta/x.parquet", 9, 12, 1)
    _write(f"{tmp_path}/camda.parquet", 14, 8, 3, first=5, extra={"cg9": pa.array([None, float("inf"), -float("inf"), float("nan")] * 3 + [1.0, 2.0])})
    paths = {"beta": f"{tmp_path}/beta", "camda": f"{tmp_path}/camda.parquet"}
    tables = {m: load_table(spark, p, fmt="parquet").withColumnsRenamed({"Sample_ID": "sample_id", "tissue": "Tissue"}) for m, p in paths.items()}
    ids = spark.createDataFrame([(f"s{i}", None if i == 3 else 1.0) for i in range(2, 25)], "sample_id string, Age double")
    context = spark.createDataFrame([(f"s{i}", i / 3, None if i % 2 else 1.0) for i in range(0, 22)], "sample_id string, RF_PC1 double, RF_PC2 double")
    known = spark.createDataFrame([(0, "RF_PC2"), (1, "cg000003_beta"), (2, "none"), (3, "cg9_camda"), (4, "cg000000_camda")], "idx int, feature string")
    for order in (None, known):
        a = assemble(ids, tables, context, order, ids)
        b = assemble_files(ids, paths, context, order, ids)
        assert a.names() == b.names()
        assert sorted(map(tuple, a.excluded.collect())) == sorted(map(tuple, b.excluded.collect()))
        left, right = _rows(a.packed), _rows(b.packed)
        assert set(left) == set(right) and len(left) > 15
        for k in left:
            np.testing.assert_array_equal(left[k], right[k])


def test_files_of_other_columns_are_joined_by_name(spark, tmp_path):
    one = _write(f"{tmp_path}/a.parquet", 4, 3, 1)
    two = _write(f"{tmp_path}/b.parquet", 4, 5, 2, first=4)
    got = _rows(wide.read_packed(spark, str(tmp_path), "beta").packed)
    np.testing.assert_array_equal(got["s1"], np.concatenate([one[1], [np.nan, np.nan]]).astype(np.float32))
    np.testing.assert_array_equal(got["s6"], two[2])


def test_edges(spark, tmp_path):
    pq.write_table(pa.table({"sample_id": pa.array([], pa.string()), "cg1": pa.array([], pa.float64())}), f"{tmp_path}/empty.parquet")
    assert wide.read_packed(spark, f"{tmp_path}/empty.parquet", "beta").packed.count() == 0
    pq.write_table(pa.table({"sample_id": pa.array([7, None, 8]), "cg1": pa.array([1, 2, 3])}), f"{tmp_path}/ids.parquet")
    assert {k: list(v) for k, v in _rows(wide.read_packed(spark, f"{tmp_path}/ids.parquet", "beta").packed).items()} == {"7": [1.0], "8": [3.0]}
    none = wide.read_packed(spark, f"{tmp_path}/ids.parquet", "beta", ["other"])
    assert [r["values"] for r in none.packed.collect()] == [[None], [None]]
    pq.write_table(pa.table({"sample_id": pa.array(["a"]), "note": pa.array(["x"])}), f"{tmp_path}/bare.parquet")
    assert [r["values"] for r in wide.read_packed(spark, f"{tmp_path}/bare.parquet", "beta").packed.collect()] == [[]]
    pq.write_table(pa.table({"sample_id": pa.array(["a", "a"]), "cg1": pa.array([1.0, 2.0])}), f"{tmp_path}/twice.parquet")
    with pytest.raises(Exception, match="two rows"):
        wide.read_packed(spark, f"{tmp_path}/twice.parquet", "beta").packed.collect()
    pq.write_table(pa.table({"sample_id": pa.array(["a"]), "cg1": pa.array([1.0]), "cg1_beta": pa.array([1.0])}), f"{tmp_path}/clash.parquet")
    with pytest.raises(ValueError, match="one feature"):
        wide.read_packed(spark, f"{tmp_path}/clash.parquet", "beta")


def test_unpack_names(spark, tmp_path):
    want = _write(f"{tmp_path}/a.parquet", 5, 4)
    made = wide.read_packed(spark, f"{tmp_path}/a.parquet", "beta", ["cg000002_beta", "cg000000_beta"])
    cells = {(r["sample_id"], r["feature"]): r["value"] for r in align.unpack(made.packed, ["cg000002_beta", "cg000000_beta"]).collect()}
    assert len(cells) == 10 and cells["s3", "cg000000_beta"] == (None if np.isnan(want[3, 0]) else want[3, 0])
