"""Hyper-parameter search: candidates are rows, all of them are fitted and scored together."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.scalar import AGE_TARGET, PLAIN_TARGET, Target, hash_fraction
from ..session import local_table, settle
from .align import pick_features
from .arrowhead import fit_arrowhead
from .folds import fold_samples, set_sizes, size_targets
from .impute import impute_packed
from .linear import fit_paths, ridge_weights, scale_table, solve_per_key
from .score import MODEL_NUMBERS, model_arrays
from .stats import brought_together, fewer_tasks, gram, matrix

# The default search ranges of the three stages.
ELASTIC_NET_SPACE = {
    "alpha": ("log", 1e-4, 1.0), "l1": ("uniform", 0.1, 1.0),
    "min_cap": ("int", 10, 60), "max_cap": ("int", 200, 1000), "mult": ("uniform", 0.5, 2.5),
}
RIDGE_SPACE = {"alpha": ("log", 0.1, 1000.0), "use_pcs": ("flag", 0, 1), "use_tissue_dummies": ("flag", 0, 1)}


def draw(kind: str, low: float, high: float, u: Column) -> Column:
    """Map a uniform number in [0, 1) onto a parameter range."""
    if kind == "log":
        return F.exp(F.lit(float(np.log(low))) + u * float(np.log(high) - np.log(low)))
    if kind == "int":
        return (F.lit(low) + F.floor(u * (high - low + 1))).cast("int")
    if kind == "flag":
        return u < 0.5
    return F.lit(float(low)) + u * float(high - low)


def random_candidates(spark: SparkSession, n_trials: int, space: dict, seed: int = 42) -> DataFrame:
    """Seeded draws; the same trial always gets the same parameters, however many trials there are."""
    trials = spark.range(n_trials).select(F.col("id").cast("int").alias("trial"))
    return trials.select("trial", *[
        draw(kind, low, high, hash_fraction(F.concat(F.lit(f"{name}:"), F.col("trial").cast("string")), seed)).alias(name)
        for name, (kind, low, high) in space.items()
    ])


def grid_candidates(spark: SparkSession, **lists: list) -> DataFrame:
    """All combinations of the given lists, numbered in order."""
    grid = spark.range(1).select()
    for name, values in lists.items():
        grid = grid.select("*", F.explode(F.lit(values)).alias(name))
    names = list(lists)
    return grid.select((F.row_number().over(W.orderBy(*names)) - 1).cast("int").alias("trial"), *names)


def best_trial(scores: DataFrame, params: list[str], score: str = "score", keys: list[str] | None = None) -> DataFrame:
    """The trial with the lowest score, the first one on a tie."""
    best = F.min(F.struct(F.col(score).alias("s"), F.col("trial").alias("t"), *[F.col(c) for c in params]))
    return scores.groupBy(*(keys or [])).agg(best.alias("b")).select(
        *(keys or []), F.col("b.t").alias("trial"), F.col("b.s").alias("score"), *[F.col(f"b.{c}").alias(c) for c in params]
    )


def candidate_cells(data: DataFrame, models: dict, p: int, y: str, fills: list[float] | None,
                    target: Target, fold: str = "fold", offsets: dict | None = None) -> DataFrame:
    """Absolute error sums of all candidates on their held-out rows, per project and tissue, in one pass without moving rows:
    ``fold, job, project_id, Tissue, abs_error, n``.

    ``models`` maps fold -> (job numbers, intercepts, weight matrix); ``offsets`` maps fold -> tissue -> what to add for each job.
    """
    vector = np.zeros(p) if fills is None else np.asarray(fills, dtype=np.float64)
    inverse = target.inverse_array

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            x = matrix(batch.column("values"), p, vector)
            truth = np.asarray(batch.column("__y").to_numpy(zero_copy_only=False), dtype=np.float64)
            folds = batch.column("__f").to_numpy(zero_copy_only=False)
            groups = [batch.column(c).dictionary_encode(null_encoding="encode") for c in ("project_id", "Tissue")]
            projects, tissues = (g.dictionary.to_pylist() for g in groups)
            codes = groups[0].indices.to_numpy().astype(np.int64) * max(1, len(tissues)) + groups[1].indices.to_numpy()
            for f in {int(f) for f in np.unique(folds)} & set(models):
                _, bases, weights = models[f]
                rows = np.flatnonzero(folds == f)
                rows = rows[np.argsort(codes[rows], kind="stable")]
                scores = x[rows] @ weights + bases
                here, starts, counts = np.unique(codes[rows], return_index=True, return_counts=True)
                cells = [(f, projects[c // max(1, len(tissues))], tissues[c % max(1, len(tissues))]) for c in here.tolist()]
                if offsets is not None:
                    none = np.zeros(len(bases))
                    moved = np.array([offsets.get(f, {}).get(t, none) for _, _, t in cells])
                    scores = scores + np.repeat(moved, counts, axis=0)
                errors = np.add.reduceat(np.abs(inverse(scores) - inverse(truth[rows])[:, None]), starts, axis=0)
                for cell, total, n in zip(cells, errors, counts.tolist()):
                    held = sums.get(cell)
                    if held is None:
                        sums[cell] = [total, n]
                    else:
                        held[0] += total
                        held[1] += n
        for (f, project, tissue), (total, n) in sums.items():
            jobs = models[f][0]
            yield pa.RecordBatch.from_arrays([
                pa.array([f] * len(jobs), pa.int32()), pa.array(jobs, pa.int32()), pa.array([project] * len(jobs), pa.string()),
                pa.array([tissue] * len(jobs), pa.string()), pa.array(total), pa.array([n] * len(jobs), pa.int64()),
            ], ["fold", "job", "project_id", "Tissue", "abs_error", "n"])

    names = [F.col(c).cast("string").alias(c) if c in data.columns else F.lit(None).cast("string").alias(c) for c in ("project_id", "Tissue")]
    rows = data.select(F.col(fold).cast("int").alias("__f"), "values", F.col(y).cast("double").alias("__y"), *names)
    partial = fewer_tasks(rows.filter("__y is not null")).mapInArrow(
        run, "fold int, job int, project_id string, Tissue string, abs_error double, n long")
    return partial.groupBy("fold", "job", "project_id", "Tissue").agg(F.sum("abs_error").alias("abs_error"), F.sum("n").alias("n"))


def fold_errors(cells: DataFrame) -> DataFrame:
    """``fold, job, mae, n`` of the cells of candidates."""
    return cells.groupBy("fold", "job").agg((F.sum("abs_error") / F.sum("n")).alias("mae"), F.sum("n").alias("n"))


def stacked(models: list[dict], fold: str, p: int) -> dict:
    """Fitted models -> fold -> (job numbers, intercepts, weight matrix)."""
    names = sorted({m["trial"] for m in models})
    by_fold: dict[int, list] = {}
    for m in models:
        by_fold.setdefault(int(m[fold]), []).append(m)
    out = {}
    for f, ms in by_fold.items():
        jobs = [j for j in names if any(m["trial"] == j for m in ms)]
        bases, weights = model_arrays(ms, [], p, "trial", jobs)[()]
        out[f] = (jobs, bases, weights)
    return out


@dataclass
class SampledStats:
    """Sampled training rows of every training set, and the band each trial uses in each set.

    The ``solver`` is the caller's choice, not that of the width.  ``gram``: one set of Gram statistics of all features
    serves every job.  ``working_set``: for matrices too wide for that; statistics of the features that matter, found by
    gradients of all features.  Both solve the same problem to the same tolerance.
    """

    rows: DataFrame
    uses: list[dict]
    n_splits: int
    p: int
    y: str
    fills: list[float] | None
    solver: str = "gram"
    standardize: bool = False
    triangles: dict = field(default_factory=dict)

    def stats(self, use: tuple[int, ...] | None) -> DataFrame:
        """Gram statistics per (training set, band), bands added up; ``use`` picks features."""
        if use not in self.triangles:
            rows, fills, p = self.rows, self.fills, self.p
            if use is not None:
                rows, p = pick_features(rows, use), len(use)
                fills = None if fills is None else [fills[i] for i in use]
            parts = gram(rows, ["held_out", "band"], p, self.y, fills)
            upto = W.partitionBy("held_out", "i", "j").orderBy("band").rowsBetween(W.unboundedPreceding, 0)
            self.triangles[use] = settle(parts.withColumn("v", F.sum("v").over(upto)), "gram")
        return self.triangles[use]


def sampled_fold_stats(data: DataFrame, p: int, y: str, caps: DataFrame, n_splits: int = 5, min_cohorts: int = 2,
                       seed: int = 42, fills: list[float] | None = None, solver: str = "gram",
                       standardize: bool = False, set_fills: np.ndarray | None = None) -> SampledStats:
    """The balanced sample of every training set and every sampler setting, in one pass.

    ``set_fills`` has a line of fill values for every training set, in place of ``fills`` for all.  ``standardize``: penalties are on
    features of unit scale in their own training set.

    Balanced samples are nested, so each sampled row enters one band, the smallest size that includes it;
    adding up the bands gives the statistics of every size without sampling or summing twice.
    """
    meta = data.select("sample_id", "project_id", "Tissue", "fold")
    counted = settle(set_sizes(meta, n_splits, min_cohorts, with_full=True), "set-sizes")
    targets = settle(size_targets(counted, caps.select("trial", "min_cap", "max_cap", "mult")), "targets")
    wanted = [r.asDict() for r in targets.select("trial", "held_out", "target_n").collect()]
    sizes: dict[int, set] = {}
    for w in wanted:
        sizes.setdefault(w["held_out"], set()).add(w["target_n"])
    if not sizes:
        raise ValueError("no tissue is seen in enough projects")
    lists = F.create_map(*[part for h, s in sizes.items() for part in (F.lit(h), F.lit(sorted(s)))])
    band = F.array_min(F.filter(F.element_at(lists, F.col("held_out")), lambda t: t >= F.col("rn")))
    sampled = fold_samples(meta, counted, targets, n_splits, seed)
    banded = settle(sampled.select("sample_id", "held_out", band.cast("int").alias("band")), "sample")
    filled: dict[int, list] = {}
    for r in banded.select("held_out", "band").distinct().collect():
        filled.setdefault(r["held_out"], []).append(r["band"])
    uses = []
    for w in wanted:
        usable = [b for b in filled.get(w["held_out"], []) if b <= w["target_n"]]
        if usable:
            uses.append({**w, "band": max(usable)})
    matrix_rows = data.select("sample_id", "values", y)
    if solver not in ("gram", "working_set"):
        raise ValueError(f"no solver {solver!r}")
    if solver == "working_set" and standardize:
        raise ValueError("features of unit scale need the solver 'gram'")
    # read for counts and sums, by the working set in every round, so keep only the sampled rows
    matrix_rows = settle(matrix_rows.join(banded.select("sample_id").distinct(), "sample_id", "left_semi"), "rows")
    rows = matrix_rows.join(banded, "sample_id")
    if set_fills is not None:
        rows, fills = impute_packed(rows, set_fills, "held_out"), None
    return SampledStats(rows, uses, n_splits, p, y, fills, solver, standardize)


def fit_jobs(sampled: SampledStats, jobs: list[dict], max_iter: int = 2000) -> list[dict]:
    """Fit jobs (``trial`` = job number, ``held_out, band, alpha, l1, use``).

    A result carries the weights of the features its job uses, with their positions in ``use``.
    """
    keys, by_number = ["held_out", "band"], {c["trial"]: c["use"] for c in jobs}

    def solved(stats: DataFrame, p: int, some: list[dict]) -> list[dict]:
        rows = fit_paths(stats, keys, p, some, max_iter, sampled.standardize).collect()
        return [{**r.asDict(), "use": by_number[r["trial"]]} for r in rows]

    if sampled.solver == "gram":
        return solved(sampled.stats(None), sampled.p, jobs)
    return fit_working_sets(sampled, jobs, max_iter)


def scales_of(sampled: SampledStats, models: list[dict]) -> list[dict]:
    """The models with ``mean`` and ``scale`` of their features in their own training set."""
    wanted = {(m["held_out"], m["band"]) for m in models}
    found: dict[tuple, dict] = {k: {} for k in wanted}
    stats = sampled.stats(None)
    some = functools.reduce(Column.__or__, [(F.col("held_out") == h) & (F.col("band") == b) for h, b in wanted])
    for r in scale_table(stats.filter(some), ["held_out", "band"]).collect():
        found[(r["held_out"], r["band"])][r["idx"]] = (r["mean"], r["scale"])
    out = []
    for m in models:
        at = range(sampled.p) if m["use"] is None else m["use"]
        pairs = np.array([found[(m["held_out"], m["band"])][i] for i in at]).reshape(-1, 2)
        out.append({**m, "mean": pairs[:, 0], "scale": pairs[:, 1]})
    return out


def violators(sampled: SampledStats, models: list[dict], grow: int) -> DataFrame:
    """``job, idx, gradient`` of features without weight whose gradient exceeds the model's L1 bound, the ``grow`` steepest
    of each piece of features.

    All models share one pass: a batch gives the gradients of all features and models by one matrix product.
    """
    p, fills = sampled.p, None if sampled.fills is None else np.asarray(sampled.fills, dtype=np.float64)
    by_set: dict[int, list[dict]] = {}
    for m in models:
        by_set.setdefault(m["held_out"], []).append(m)
    bounds = {m["job"]: (m["l1_bound"], m["n"], np.asarray(m["at"]), None if m["use"] is None else np.asarray(m["use"])) for m in models}
    step = 4096

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            x = matrix(batch.column("values"), p, fills)
            y = batch.column("__y").to_numpy(zero_copy_only=False)
            held, band = batch.column("held_out").to_numpy(), batch.column("band").to_numpy()
            for h in np.unique(held):
                rows = np.flatnonzero(held == h)
                own = by_set.get(int(h), [])
                rest = np.zeros((len(rows), len(own)))
                for k, m in enumerate(own):
                    rest[:, k] = np.where(band[rows] <= m["band"], y[rows] - x[np.ix_(rows, m["at"])] @ m["weights"] - m["intercept"], 0.0)
                here = x[rows].T @ rest
                totals[int(h)] = totals[int(h)] + here if int(h) in totals else here
        for h, total in totals.items():
            for k, m in enumerate(by_set.get(h, [])):
                pieces = [np.ascontiguousarray(total[a:a + step, k]).tobytes() for a in range(0, p, step)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([m["job"]] * len(pieces), type=pa.int32()), pa.array(range(len(pieces)), type=pa.int32()), pa.array(pieces)],
                    ["job", "piece", "sums"])

    def steep(table: pa.Table) -> pa.Table:
        job, piece = table.column("job")[0].as_py(), table.column("piece")[0].as_py()
        bound, n, at, use = bounds[job]
        gradient = sum(np.frombuffer(x.as_py()) for x in table.column("sums")) / n
        idx = np.arange(len(gradient)) + piece * step
        free = ~np.isin(idx, at) & (True if use is None else np.isin(idx, use)) & (np.abs(gradient) > bound * (1 + 1e-9) + 1e-12)
        idx, gradient = idx[free], gradient[free]
        top = np.argsort(-np.abs(gradient), kind="stable")[:grow]
        return pa.table({"job": pa.array([job] * len(top), type=pa.int32()), "idx": pa.array(idx[top].astype(np.int32)),
                         "gradient": pa.array(gradient[top])})

    rows = sampled.rows.select("held_out", "band", "values", F.col(sampled.y).cast("double").alias("__y")).filter("__y is not null")
    parts = brought_together(rows, ["held_out"], 16_384).mapInArrow(partial, "job int, piece int, sums binary")
    return parts.groupBy("job", "piece").applyInArrow(steep, "job int, idx int, gradient double")


def fit_working_sets(sampled: SampledStats, jobs: list[dict], max_iter: int, grow: int = 200, rounds: int = 200) -> list[dict]:
    """All jobs together: each is solved exactly on its working set of features, from Gram statistics of the union of all
    sets, and its set grows by the features whose gradient breaks the optimality condition, until none does."""
    sums = sampled.rows.filter(F.col(sampled.y).isNotNull()).groupBy("held_out", "band").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(sampled.y).cast("double")).alias("s")).collect()
    live = []
    for job, c in enumerate(jobs):
        mine = [r for r in sums if r["held_out"] == c["held_out"] and r["band"] <= c["band"]]
        n = sum(r["n"] for r in mine)
        if n:
            live.append({**c, "job": job, "n": n, "at": [], "weights": np.zeros(0), "intercept": sum(r["s"] for r in mine) / n,
                         "l1_bound": c["alpha"] * c["l1"]})
    done = []
    for _ in range(rounds):
        found: dict[int, list] = {}
        width = max(1, MODEL_NUMBERS // max(1, sampled.p))
        for start in range(0, len(live), width):
            for r in violators(sampled, live[start:start + width], grow).collect():
                found.setdefault(r["job"], []).append((-abs(r["gradient"]), r["idx"]))
        done += [m for m in live if m["job"] not in found]
        live = [m for m in live if m["job"] in found]
        if not live:
            break
        for m in live:
            m["at"] = sorted([*m["at"], *(i for _, i in sorted(found[m["job"]])[:grow])])
        union = tuple(sorted({i for m in live for i in m["at"]}))
        place = {f: i for i, f in enumerate(union)}
        stats = sampled.stats(union)
        tasks = [{"trial": m["job"], "held_out": m["held_out"], "band": m["band"], "alpha": m["alpha"], "l1": m["l1"],
                  "use": [place[f] for f in m["at"]]} for m in live]
        fitted = {r["trial"]: r for r in fit_paths(stats, ["held_out", "band"], len(union), tasks, max_iter).collect()}
        sampled.triangles.pop(union)
        for m in live:
            m["weights"], m["intercept"] = np.asarray(fitted[m["job"]]["weights"]), fitted[m["job"]]["intercept"]
    else:
        raise RuntimeError(f"{len(live)} models did not settle in {rounds} rounds")
    return [{"held_out": m["held_out"], "band": m["band"], "trial": m["trial"], "n": m["n"], "use": m["at"],
             "intercept": m["intercept"], "weights": m["weights"]} for m in done]


def jobs_for(sampled: SampledStats, chosen: dict[str, dict], subsets: dict[str, list[int] | None],
             sets: list[int]) -> list[dict]:
    """One job per model key and training set, with the parameters chosen for the key."""
    used = {(u["trial"], u["held_out"]): u for u in sampled.uses}
    names = list(subsets)
    return [
        {"trial": names.index(name), "model_key": name, "held_out": h, "band": used[(c["trial"], h)]["band"], "alpha": c["alpha"],
         "l1": c["l1"], "use": _key_of(subsets[name])}
        for name, c in chosen.items() for h in sets if (c["trial"], h) in used
    ]


def _key_of(use: list[int] | None) -> tuple[int, ...] | None:
    return None if use is None else tuple(use)


def search_elastic_net(data: DataFrame, candidates: list[dict], sampled: SampledStats,
                       target: Target = AGE_TARGET, max_iter: int = 2000, halving: bool = False, subsets: dict[str, list[int] | None] | None = None) -> DataFrame:
    """The report of ``search_with_cells`` alone."""
    return search_with_cells(data, candidates, sampled, target, max_iter, halving, subsets)[0]


def search_with_cells(data: DataFrame, candidates: list[dict], sampled: SampledStats, target: Target = AGE_TARGET, max_iter: int = 2000,
                      halving: bool = False, subsets: dict[str, list[int] | None] | None = None) -> tuple[DataFrame, DataFrame]:
    """Score every candidate for every model key: fit on the balanced sample, held-out MAE in years per fold.  The second table
    has the error sums behind it, ``model_key, trial, fold, project_id, Tissue, abs_error, n``.

    ``subsets`` maps model keys (hallmarks) to feature positions; all keys share one set of statistics and
    each fold's held-out rows are read once for all of them.  With ``halving`` the folds are scored one
    after the other and only the better half of a key's trials goes on to the next.
    """
    subsets = subsets or {"Global": None}
    names, params = list(subsets), {c["trial"]: c for c in candidates}
    pairs = [(name, t) for name in names for t in sorted(params)]
    used = {(u["trial"], u["held_out"]): u for u in sampled.uses}
    width = max(1, MODEL_NUMBERS // max(1, sampled.p))
    cells: list[DataFrame] = []

    def score(chosen: list[tuple], folds: list[int]) -> list:
        jobs = [
            {"trial": pairs.index(pair), "held_out": f, "band": used[(pair[1], f)]["band"], "use": _key_of(subsets[pair[0]]),
             "alpha": params[pair[1]]["alpha"], "l1": params[pair[1]]["l1"]}
            for pair in chosen for f in folds if (pair[1], f) in used
        ]
        held_out = data.filter(F.col("fold").isin(folds)) if len(folds) < sampled.n_splits else data
        out: list = []
        for start in range(0, len(jobs), width):
            fitted = fit_jobs(sampled, jobs[start:start + width], max_iter)
            cells.append(settle(candidate_cells(held_out, stacked(fitted, "held_out", sampled.p), sampled.p, sampled.y, sampled.fills, target), "cells"))
            out += fold_errors(cells[-1]).collect()
        return out

    if not halving:
        rows = score(pairs, list(range(sampled.n_splits)))
    else:
        rows, totals = [], dict.fromkeys(pairs, 0.0)
        alive = {name: sorted(params) for name in names}
        for f in range(sampled.n_splits):
            scored = score([(name, t) for name in names for t in alive[name]], [f])
            rows += scored
            for r in scored:
                totals[pairs[r["job"]]] += r["mae"]
            for name in names if f < sampled.n_splits - 1 else []:
                alive[name] = sorted(alive[name], key=lambda t: (totals[(name, t)], t))[: (len(alive[name]) + 1) // 2]
    report = []
    for r in rows:
        name, t = pairs[r["job"]]
        c = params[t]
        report.append((name, t, r["fold"], float(c["alpha"]), float(c["l1"]), int(c["min_cap"]), int(c["max_cap"]),
                       float(c["mult"]), int(used[(t, r["fold"])]["target_n"]), float(r["mae"])))
    spark = data.sparkSession
    names_of = local_table(spark, [(i, *pair) for i, pair in enumerate(pairs)], "job int, model_key string, trial int")
    every = functools.reduce(DataFrame.unionByName, cells).join(names_of, "job")
    return local_table(
        spark, report, "model_key string, trial int, fold int, alpha double, l1 double, min_cap int, max_cap int, "
                "mult double, target_n int, mae double"
    ), every.select("model_key", "trial", "fold", "project_id", "Tissue", "abs_error", "n")


PARAMS = ["alpha", "l1", "min_cap", "max_cap", "mult"]


def trial_scores(report: DataFrame, params: list[str]) -> DataFrame:
    """Parameters, mean MAE and number of folds scored per model key and trial."""
    return report.groupBy("model_key", "trial", *params).agg(
        F.avg("mae").alias("score"), F.count(F.lit(1)).alias("n_folds")
    )


def best_params(report: DataFrame) -> dict[str, dict]:
    """Per model key the best of the trials that went through most folds (the first one on a tie)."""
    scores = trial_scores(report, PARAMS)
    most = F.max("n_folds").over(W.partitionBy("model_key"))
    full = scores.withColumn("__most", most).filter("n_folds = __most").drop("__most")
    return {r["model_key"]: r.asDict() for r in best_trial(full, PARAMS, keys=["model_key"]).collect()}


def training_triangles(per_fold: DataFrame, keys: list[str], n_splits: int) -> DataFrame:
    """Gram statistics of all rows outside each fold (``held_out``): each fold's own enter all other sets."""
    others = F.array_remove(F.sequence(F.lit(0), F.lit(n_splits - 1)), F.col("fold"))
    copies = per_fold.withColumn("held_out", F.explode(others))
    return copies.groupBy("held_out", *keys, "i", "j").agg(F.sum("v").alias("v"))


def search_ridge(data: DataFrame, per_fold: DataFrame, p: int, candidates: list[dict], y: str, n_splits: int,
                 target: Target = PLAIN_TARGET, per_fold_tissue: DataFrame | None = None) -> DataFrame:
    """MAE per fold (``fold, job, mae, n``; the job is the trial) of ridge candidates, see ``ridge_cells``."""
    return fold_errors(ridge_cells(data, per_fold, p, candidates, y, n_splits, target, per_fold_tissue))


def ridge_cells(data: DataFrame, per_fold: DataFrame, p: int, candidates: list[dict], y: str, n_splits: int,
                target: Target = PLAIN_TARGET, per_fold_tissue: DataFrame | None = None) -> DataFrame:
    """Held-out errors per project and tissue (the job is the trial) of ridge candidates ``trial, alpha, use``.

    All candidates are solved from the same fold statistics and scored in one pass.  Those with ``offsets`` have an indicator
    per tissue besides, from ``per_fold_tissue``.
    """
    stats = settle(training_triangles(per_fold, [], n_splits), "gram")
    plain = [c for c in candidates if not c.get("offsets")]
    moved = [c for c in candidates if c.get("offsets")]

    def solve(total: np.ndarray, c: dict) -> tuple[float, np.ndarray]:
        return ridge_weights(total, c["alpha"], np.asarray(c["use"], dtype=int))

    uses = {c["trial"]: c["use"] for c in candidates}
    found = solve_per_key(stats, ["held_out"], p, plain, solve).collect() if plain else []
    offsets: dict | None = None
    if moved:
        whole = fit_arrowhead(training_triangles(per_fold_tissue, ["Tissue"], n_splits), ["held_out"], p, moved).collect()
        found += whole
    fitted = [{**r.asDict(), "use": uses[r["trial"]]} for r in found]
    models = stacked(fitted, "held_out", p)
    if moved:
        offsets = {}
        for r in whole:
            jobs = models[r["held_out"]][0]
            for name, d in zip(r["tissues"], r["offsets"]):
                offsets.setdefault(r["held_out"], {}).setdefault(name, np.zeros(len(jobs)))[jobs.index(r["trial"])] = d
    return candidate_cells(data, models, p, y, None, target, offsets=offsets)
