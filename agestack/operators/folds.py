"""Project-grouped folds and the tissue-balanced sampler."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalar import clip, seeded_hash
from ..session import settle
from .ranking import bucket_rank, hash_head, hash_rank


def healthy_filter(samples: DataFrame, on: bool = True) -> DataFrame:
    return samples.filter("Is_Healthy") if on else samples


def projects_per_tissue(samples: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return samples.groupBy(*(keys or []), "Tissue").agg(F.count_distinct("project_id").alias("n_projects"))


def valid_tissues(samples: DataFrame, min_cohorts: int, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    if "project_id" not in samples.columns:
        return samples.select(*keys, "Tissue").distinct()
    seen = projects_per_tissue(samples, keys)
    return seen.filter(F.col("n_projects") >= min_cohorts).select(*keys, "Tissue")


def keep_valid_tissues(samples: DataFrame, min_cohorts: int) -> DataFrame:
    return samples.join(settle(valid_tissues(samples, min_cohorts), "tissues"), "Tissue", "left_semi")


def target_sizes(samples: DataFrame, min_cap: int, max_cap: int, mult: float, keys: list[str] | None = None,
                 ) -> DataFrame:
    """Rows to keep per tissue: the clipped median of the tissue counts, truncated."""
    keys = keys or []
    counts = samples.groupBy(*keys, "Tissue").agg(F.count(F.lit(1)).alias("n"))
    size = clip(F.median("n") * mult, float(min_cap), float(max_cap)).cast("int")
    return counts.groupBy(*keys).agg(size.alias("target_n"), F.count(F.lit(1)).alias("n_tissues"))


def balanced_sample(samples: DataFrame, min_cohorts: int = 2, min_cap: int = 30, max_cap: int = 500,
                    mult: float = 1.0, seed: int = 42) -> tuple[DataFrame, int]:
    """Keep at most ``target_n`` rows of every tissue seen in enough projects, in seeded random order."""
    valid = keep_valid_tissues(samples, min_cohorts)
    sizes = target_sizes(valid, min_cap, max_cap, mult).first()
    target = sizes["target_n"] if sizes["n_tissues"] else 0
    return hash_rank(valid, ["Tissue"], "sample_id", seed, at_most=target), target


def mode_tissue(samples: DataFrame) -> DataFrame:
    """The most frequent tissue of each project (the smallest name on a tie) and the project's size."""
    counts = samples.groupBy("project_id", "Tissue").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("Tissue").alias("t")))
    return counts.groupBy("project_id").agg(best.alias("b"), F.sum("n").alias("n_samples")).select(
        "project_id", F.col("b.t").alias("mode_tissue"), "n_samples"
    )


def round_robin_folds(samples: DataFrame, n_splits: int, seed: int) -> DataFrame:
    """``project_id, mode_tissue, fold``: shuffle the projects of each tissue and deal them out."""
    dealt = hash_rank(settle(mode_tissue(samples), "projects"), ["mode_tissue"], "project_id", seed)
    return dealt.select("project_id", "mode_tissue", ((F.col("rn") - 1) % n_splits).cast("int").alias("fold"))


def balanced_folds(samples: DataFrame, n_splits: int, seed: int) -> DataFrame:
    """Deal projects from large to small in serpentine order, so that folds get even shares of each tissue.

    Projects are ordered by size class (power of two) and then at random.
    """
    projects = settle(mode_tissue(samples), "projects").withColumn("__h", seeded_hash(F.col("project_id"), seed))
    small = 62 - F.floor(F.log2("n_samples"))
    ranked = bucket_rank(
        projects, ["mode_tissue"], [small, F.substring("__h", 1, 2)], [F.col("__h"), F.col("project_id")]
    )
    turn = (F.col("rn") - 1) % (2 * n_splits)
    fold = F.when(turn < n_splits, turn).otherwise(2 * n_splits - 1 - turn)
    return ranked.select("project_id", "mode_tissue", "n_samples", fold.cast("int").alias("fold"))


def deal(members: list[tuple[np.ndarray, np.ndarray]], sizes: np.ndarray, shares: np.ndarray, rows: np.ndarray, sweeps: int) -> np.ndarray:
    """The fold of each member, given in the order of dealing as (tissue positions, shares of these tissues).

    ``shares`` (folds x tissues) and ``rows`` (folds) are what the folds hold before.  A member goes where it raises the variance
    of the tissue shares over the folds least: the shares of a tissue add up to the same in every assignment, so that is the fold
    with the smallest inner product of its shares and the member's.  Ties go to the fold with fewest rows, then to the first.
    Each sweep takes every member out again and deals it once more.
    """
    shares, rows, numbers = shares.copy(), rows.astype(float), np.arange(len(rows))
    out = np.full(len(members), -1)
    for turn in range(sweeps + 1):
        moved = False
        for i, (at, share) in enumerate(members):
            if turn:
                shares[out[i], at] -= share
                rows[out[i]] -= sizes[i]
            pull = np.round((shares[:, at] * share).sum(1), 12)
            best = int(np.lexsort((numbers, rows, pull))[0])
            moved |= best != out[i]
            out[i] = best
            shares[best, at] += share
            rows[best] += sizes[i]
        if not moved:
            break
    return out


def stratified_folds(samples: DataFrame, n_splits: int, seed: int, sweeps: int = 2, part_projects: int = 1024) -> DataFrame:
    """``project_id, n_samples, fold``: whole projects, and folds with even shares of every tissue, whatever mix of tissues a
    project has.

    Projects are dealt by falling spread (the sum of squares of their shares of the tissues), then in seeded order, see ``deal``.
    The ``part_projects`` of widest spread are dealt by one task.  The others follow in parts of about as many, split by hash, one
    task each: a part starts from an equal portion of what the first ones left uneven, so that all parts together even it out, but for about
    one of its smallest projects per part.
    A task holds that many projects times their tissues, nothing of the samples but counts.

    A null project or tissue is one of its own, though ``with_folds`` matches no null project.  Fewer projects than folds
    leave folds empty; no rows give no rows.
    """
    named = samples.select("project_id", F.coalesce(F.concat(F.lit("="), "project_id"), F.lit("")).alias("item"),
                           F.coalesce(F.concat(F.lit("="), "Tissue"), F.lit("")).alias("tissue"))
    counts = settle(named.groupBy("project_id", "item", "tissue").agg(F.count(F.lit(1)).alias("n")), "fold-counts")
    totals = settle(counts.groupBy("tissue").agg(F.sum("n").alias("total")), "fold-totals")
    cells = counts.join(totals, "tissue").select("item", "tissue", F.col("n").cast("double").alias("n"), (F.col("n") / F.col("total")).alias("share"))
    cells = settle(cells, "fold-shares")
    spread = F.round(F.sum(F.col("share") * F.col("share")), 12)
    projects = cells.groupBy("item").agg((-spread).alias("narrow")).withColumn("order", seeded_hash(F.col("item"), seed))
    widest = settle(projects.orderBy("narrow", "order", "item").limit(part_projects), "fold-widest")
    rest = settle(projects.join(widest, "item", "left_anti"), "fold-rest")

    def dealt(table: pa.Table) -> pa.Table:
        tissue = table.column("tissue").combine_chunks().dictionary_encode()
        frame = table.select(["item", "narrow", "order", "n", "share", "held"]).to_pandas().assign(at=tissue.indices.to_numpy())
        before, free = frame[frame["held"] >= 0], frame[frame["held"] < 0].sort_values(["narrow", "order", "item", "at"], kind="stable")
        shares, rows = np.zeros((n_splits, len(tissue.dictionary))), np.zeros(n_splits)
        np.add.at(shares, (before["held"], before["at"]), before["share"])
        np.add.at(rows, before["held"], before["n"])
        items = free["item"].to_numpy()
        cuts = np.flatnonzero(items[1:] != items[:-1]) + 1
        each = list(zip(np.split(free["at"].to_numpy(), cuts), np.split(free["share"].to_numpy(), cuts)))
        each, sizes = each if len(items) else [], np.add.reduceat(free["n"].to_numpy(), [0, *cuts]) if len(items) else np.zeros(0)
        return pa.table({"item": pa.array(items[[0, *cuts]] if len(items) else [], pa.string()),
                         "fold": pa.array(deal(each, sizes, shares, rows, sweeps), pa.int32())})

    columns, free = ["item", "narrow", "order", "tissue", "n", "share"], F.lit(-1).alias("held")
    first = settle(cells.join(widest, "item").select(*columns, free).groupBy().applyInArrow(dealt, "item string, fold int"), "fold-first")
    parts = max(1, -(-rest.count() // part_projects))
    held = cells.join(first, "item").groupBy("tissue", "fold").agg(F.sum("n").alias("n"), F.sum("share").alias("share"))
    portions = held.select(
        F.lit(None).cast("string").alias("item"), F.lit(0.0).alias("narrow"), F.lit("").alias("order"), "tissue", (F.col("n") / parts).alias("n"),
        (F.col("share") / parts).alias("share"), F.col("fold").alias("held"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    part = F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(parts)).cast("int").alias("part")
    others = cells.join(rest, "item").select(*columns, free, part).unionByName(portions)
    later = settle(others.groupBy("part").applyInArrow(dealt, "item string, fold int"), "fold-later")
    members = counts.groupBy("project_id", "item").agg(F.sum("n").alias("n_samples"))
    return members.join(first.unionByName(later), "item").select("project_id", "n_samples", "fold")


def fold_shares(folded: DataFrame, n_splits: int) -> DataFrame:
    """``Tissue, fold, n, share`` of every tissue and fold, those without rows included: the share of the tissue's rows the fold holds."""
    counts = folded.groupBy("Tissue").pivot("fold", list(range(n_splits))).count().fillna(0, [str(f) for f in range(n_splits)])
    cells = F.array(*[F.struct(F.lit(f).alias("fold"), F.col(f"`{f}`").alias("n")) for f in range(n_splits)])
    total = sum((F.col(f"`{f}`") for f in range(n_splits)), F.lit(0))
    return counts.select("Tissue", total.alias("total"), F.explode(cells).alias("c")).select(
        "Tissue", "c.fold", "c.n", (F.col("c.n") / F.col("total")).alias("share"))


def with_folds(samples: DataFrame, folds: DataFrame) -> DataFrame:
    return samples.join(settle(folds.select("project_id", "fold"), "folds"), "project_id")


def held_out_copies(samples: DataFrame, n_splits: int, with_full: bool = False) -> DataFrame:
    """Each sample once per training set it belongs to: every held-out fold but its own.

    With ``with_full`` also once under the number ``n_splits``, the set that holds nothing out.
    """
    sets = F.sequence(F.lit(0), F.lit(n_splits if with_full else n_splits - 1))
    return samples.withColumn("held_out", F.explode(F.array_remove(sets, F.col("fold"))))


def set_seed(n_splits: int, seed: int) -> Column:
    """Every held-out fold samples with its own seed; the full set uses the plain one."""
    return F.when(F.col("held_out") == n_splits, F.lit(seed)).otherwise(F.col("held_out") + seed)


def set_sizes(samples: DataFrame, n_splits: int, min_cohorts: int, with_full: bool = False) -> DataFrame:
    """``held_out, Tissue, n``: the rows of every tissue that is seen in enough projects of the training set.

    Rows are counted per fold, project and tissue; only the counts are copied to the training sets.
    """
    cells = samples.groupBy("fold", "project_id", "Tissue").agg(F.count(F.lit(1)).alias("n"))
    sizes = held_out_copies(cells, n_splits, with_full).groupBy("held_out", "Tissue").agg(
        F.count_distinct("project_id").alias("n_projects"), F.sum("n").alias("n"))
    return sizes.filter((F.col("n_projects") >= min_cohorts) & F.col("Tissue").isNotNull()).drop("n_projects")


def fold_samples(samples: DataFrame, sizes: DataFrame, targets: DataFrame, n_splits: int, seed: int) -> DataFrame:
    """Balanced training rows of every training set with their rank ``rn``; ``sizes`` as by ``set_sizes``.

    Samples are nested, so with several targets per set the largest is ranked and each smaller sample is
    the prefix ``rn <= target_n``.
    """
    largest = targets.groupBy("held_out").agg(F.max("target_n").alias("most"))
    limits = sizes.join(largest, "held_out").withColumn("seed", set_seed(n_splits, seed).cast("string"))
    return hash_head(held_out_copies(samples, n_splits, with_full=True), ["held_out", "Tissue"], "sample_id", limits)


def fold_targets(copies: DataFrame, caps: DataFrame) -> DataFrame:
    """``target_n`` of every sampler setting (``min_cap, max_cap, mult``) in every training set."""
    return size_targets(copies.groupBy("held_out", "Tissue").agg(F.count(F.lit(1)).alias("n")), caps)


def size_targets(sizes: DataFrame, caps: DataFrame) -> DataFrame:
    """The same from the rows ``n`` of every training set and tissue."""
    medians = sizes.groupBy("held_out").agg(F.median("n").alias("m"))
    size = F.least(F.greatest(F.col("m") * F.col("mult"), F.col("min_cap").cast("double")),
                   F.col("max_cap").cast("double")).cast("int")
    sets = medians.collect()
    if not sets:
        return caps.withColumns({"held_out": F.lit(0), "target_n": F.lit(0)}).limit(0)
    listed = F.array(*[F.struct(F.lit(s["held_out"]).alias("held_out"), F.lit(s["m"]).alias("m")) for s in sets])
    return caps.withColumn("__s", F.explode(listed)).select(
        *caps.columns, F.col("__s.held_out").alias("held_out"), F.col("__s.m").alias("m")
    ).withColumn("target_n", size).drop("m")


def tissues_with_own_model(samples: DataFrame, min_samples: int = 50) -> DataFrame:
    counts = samples.groupBy("Tissue").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= min_samples)


def training_rows(samples: DataFrame, fold: int) -> DataFrame:
    return samples.filter(F.col("fold") != fold)


def validation_rows(samples: DataFrame, fold: int) -> DataFrame:
    return samples.filter(F.col("fold") == fold)
