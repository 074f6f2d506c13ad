"""Reports of the training jobs against numpy and plain Python."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from agestack.functions.scalar import AGE_TARGET, PLAIN_TARGET
from agestack.operators import reports
from agestack.operators.search import candidate_cells, fold_errors


@pytest.fixture(scope="module")
def rows(spark):
    """A third of all rows in one project; null projects and tissues are names of their own."""
    rng = np.random.default_rng(3)
    out = []
    for i in range(600):
        project = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"P{i % 11}"
        tissue = None if i % 17 == 2 else f"T{i % 4}"
        out.append((i % 3, project, tissue, [float(v) for v in rng.normal(size=2)], None if i % 97 == 5 else float(rng.normal())))
    return out


def _frame(spark, rows):
    return spark.createDataFrame(rows, "fold int, project_id string, Tissue string, values array<double>, y double")


MODELS = {0: ([4, 7], np.array([0.1, -0.2]), np.array([[1.0, 0.5], [0.0, 2.0]])), 2: ([4], np.array([0.3]), np.array([[0.2], [-1.0]]))}


def _brute(rows, inverse, offsets=None):
    out = defaultdict(lambda: [0.0, 0])
    for fold, project, tissue, values, y in rows:
        if fold not in MODELS or y is None:
            continue
        for k, job in enumerate(MODELS[fold][0]):
            score = MODELS[fold][1][k] + np.dot(values, MODELS[fold][2][:, k])
            score += 0.0 if offsets is None else offsets.get(fold, {}).get(tissue, np.zeros(2))[k]
            cell = out[(fold, job, project, tissue)]
            cell[0] += abs(float(inverse(np.array(score)) - inverse(np.array(y))))
            cell[1] += 1
    return out


@pytest.mark.parametrize("target", [PLAIN_TARGET, AGE_TARGET])
@pytest.mark.parametrize("offsets", [None, {0: {"T1": np.array([0.5, -3.0]), None: np.array([1.0, 1.0])}, 2: {}}])
def test_cells_match_a_plain_loop(spark, rows, target, offsets):
    cells = candidate_cells(_frame(spark, rows).repartition(5), MODELS, 2, "y", None, target, offsets=offsets)
    got = {(r["fold"], r["job"], r["project_id"], r["Tissue"]): (r["abs_error"], r["n"]) for r in cells.collect()}
    want = _brute(rows, target.inverse_array, offsets)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k][0], want[k][0], rel_tol=1e-9) and got[k][1] == want[k][1] for k in want)


def test_cells_without_names_and_rows(spark, rows):
    frame = _frame(spark, rows)
    plain = fold_errors(candidate_cells(frame.drop("project_id", "Tissue"), MODELS, 2, "y", None, PLAIN_TARGET))
    named = fold_errors(candidate_cells(frame, MODELS, 2, "y", None, PLAIN_TARGET))
    a, b = ({(r["fold"], r["job"]): (round(r["mae"], 9), r["n"]) for r in t.collect()} for t in (plain, named))
    assert a == b and len(a) == 3
    assert candidate_cells(frame.limit(0), MODELS, 2, "y", None, PLAIN_TARGET).collect() == []


def test_cube_and_report(spark, rows):
    cells = candidate_cells(_frame(spark, rows), MODELS, 2, "y", None, PLAIN_TARGET).withColumnRenamed("job", "trial")
    cube = reports.error_cube(cells, ["trial"]).cache()
    want = _brute(rows, PLAIN_TARGET.inverse_array)
    sums = defaultdict(lambda: [0.0, 0])
    for (fold, job, project, tissue), (s, n) in want.items():
        for key in ((job, "all", None), (job, "fold", fold), (job, "project_id", project), (job, "Tissue", tissue)):
            sums[key][0] += s
            sums[key][1] += n
    got = {(r["trial"], r["level"], None if r["level"] == "all" else r[r["level"]]): (r["mae"], r["n"]) for r in cube.collect()}
    assert len(got) == cube.count() and got.keys() == sums.keys()
    assert all(math.isclose(got[k][0], s / n, rel_tol=1e-9) and got[k][1] == n for k, (s, n) in sums.items())
    for r in reports.trial_report(cube, ["trial"]).collect():
        of = {level: {k[2]: s / n for k, (s, n) in sums.items() if k[:2] == (r["trial"], level)} for level in ("all", "fold", "project_id", "Tissue")}
        assert math.isclose(r["micro_mae"], of["all"][None], rel_tol=1e-9)
        for name, level in (("macro_mae", "project_id"), ("tissue_mae", "Tissue"), ("fold_mae", "fold")):
            assert math.isclose(r[name], float(np.mean(list(of[level].values()))), rel_tol=1e-9)
        assert (r["n_folds"], r["n_projects"], r["n_tissues"]) == tuple(len(of[level]) for level in ("fold", "project_id", "Tissue"))
        assert r["worst_tissue"] == max(of["Tissue"], key=of["Tissue"].get)
    assert reports.trial_report(reports.error_cube(cells.limit(0), ["trial"]), ["trial"]).collect() == []


def test_worst_tissue_on_a_tie(spark):
    cells = spark.createDataFrame([(1, 0, "p", t, 6.0, 2) for t in ("b", "a", "c")], "trial int, fold int, project_id string, Tissue string, abs_error double, n long")
    row = reports.trial_report(reports.error_cube(cells, ["trial"]), ["trial"]).first()
    assert (row["worst_tissue"], row["worst_mae"], row["micro_mae"], row["n"]) == ("a", 3.0, 3.0, 6)


def test_performance(spark):
    rows = [("p", 10.0, 12.0, None), ("p", 20.0, 20.0, None), ("q", 30.0, 36.0, 30.0), (None, None, 1.0, 1.0), (None, 5.0, 5.0, 9.0)]
    frame = spark.createDataFrame(rows, "project_id string, age double, a double, b double")
    got = {r["model_key"]: r for r in reports.performance(frame, F.col("age"), {"A": "a", "B": "b"}).collect()}
    assert (got["A"]["n"], got["A"]["MAE"], got["A"]["MacroMAE"], got["A"]["n_projects"]) == (4, 2.0, round(7 / 3, 4), 3)
    assert (got["B"]["n"], got["B"]["MAE"], got["B"]["MacroMAE"], got["B"]["n_projects"]) == (2, 2.0, 2.0, 2)
    assert got["A"]["MedianAE"] == 1.0
    assert reports.performance(frame.limit(0), F.col("age"), {"A": "a"}).collect() == []


def test_importance(spark):
    weights = [("g", 0, 1.0), ("g", 1, -2.0), ("g", 2, 0.0), ("g", 3, 4.0), ("g", 4, 5.0), ("h", 1, 0.5), ("none", 0, 0.0)]
    table = spark.createDataFrame([(k, i, f"f{i}", w) for k, i, w in weights], "model_key string, idx int, feature string, weight double")
    spread = spark.createDataFrame([(0, 4.0), (1, 2.0), (2, 9.0), (3, 1.0), (4, 0.0)], "idx int, sd double")
    got = {(r["model_key"], r["rank"]): (r["feature"], r["importance"], round(r["share"], 9)) for r in reports.importance(table, spread).collect()}
    third = round(1 / 3, 9)
    assert got == {("g", 1): ("f0", 4.0, third), ("g", 2): ("f1", 4.0, third), ("g", 3): ("f3", 4.0, third), ("h", 1): ("f1", 1.0, 1.0)}
