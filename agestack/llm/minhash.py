"""MinHash near-duplicates with sequential Bayesian verification.

Signatures find candidate pairs by bands.  A candidate's signatures are compared a batch at a time; after each batch the
pair is given up if the posterior probability that its similarity reaches the threshold is below ``MISS``.  Survivors
are decided on their whole shingle sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import settle, small, text_of
from .graph import components
from .hashing import chunks, encode, hashed_words, mixed, sequence_hash, window_hashes

#: 24 bands of 4 rows: a pair of similarity 0.8 shares no band with probability 3e-6.
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Signature values compared between two looks at the posterior.
BATCH = 16
#: A pair is given up when similarity >= threshold has a lower posterior probability than this.
MISS = 1e-7
#: Rounds in which one member of a band meets the others, before those that are still apart are joined by prefixes.
MEETINGS = 2
#: Bits of a shingle by which its rarity is counted; the table of counts goes to every task.
RARITY_BITS = 20
NUMER, DENOM = 80, 100

_rng = np.random.Generator(np.random.PCG64(7919))
_MULTIPLY = _rng.integers(0, 1 << 63, size=HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 64, size=HASHES, dtype=np.uint64)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingle hashes, in order; a shorter text is one shingle, one without words has none."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    if len(words) < size:
        return np.array([sequence_hash(words)], dtype=np.uint64)
    return np.unique(window_hashes(words, size))


def signature(shingles: np.ndarray) -> np.ndarray:
    best = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        hashes = (shingles[at:at + 1024, None] * _MULTIPLY + _ADD) >> np.uint64(32)
        np.minimum(best, hashes.min(axis=0), out=best)
    return best.astype(np.uint32)


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, a, b, sig``: the size of the shingle set, two hashes of all of it, its signature."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_shingles", "a", "b")),
                           T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (encode(t.as_py()).lower() for t in batch.column("text"))
            for first, part in chunks(texts):
                words, at = hashed_words(part)
                sets = [shingle_set(words[at[i]:at[i + 1]], size) for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, len(part)), pa.array([len(s) for s in sets], type=pa.int64()),
                    pa.array(np.array([mixed(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)),
                    pa.array(np.array([mixed(~s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], type=pa.binary()),
                ], schema.names)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def band_keys(classes: DataFrame) -> DataFrame:
    """``key, rep``: one row per band of each signature."""
    odd = _MULTIPLY[:ROWS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, BANDS, ROWS)
            keys = mixed((sig.astype(np.uint64) * odd).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column("rep").to_numpy(), BANDS))], ["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "key long, rep long")


def least_matches(threshold: float, miss: float) -> dict[int, int]:
    """For each number of values compared, the fewest equal ones with which a pair goes on.

    With every similarity as likely at first, m equal of n leave a Beta(m + 1, n - m + 1) distribution, whose mass from t
    on is the chance of at most m successes in n + 1 trials of probability t.
    """
    out = {}
    for n in range(BATCH, HASHES + 1, BATCH):
        mass, m = 0.0, -1
        while mass < miss:
            m += 1
            mass += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``x, y`` that no batch of their signatures rules out."""
    needed = least_matches(threshold, MISS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s, t = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(-1, HASHES) for c in ("s", "t"))
            live, equal = np.arange(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64)
            for n, m in needed.items():
                part = slice(n - BATCH, n)
                equal[live] += (s[live, part] == t[live, part]).sum(axis=1)
                live = live[equal[live] >= m]
            yield batch.select(["x", "y"]).take(pa.array(live))

    sigs = classes.select("rep", "sig")
    both = pairs.join(sigs.select(F.col("rep").alias("x"), F.col("sig").alias("s")), "x").join(
        sigs.select(F.col("rep").alias("y"), F.col("sig").alias("t")), "y")
    return both.select("x", "y", "s", "t").mapInArrow(run, "x long, y long")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, numer: int, denom: int) -> DataFrame:
    """The pairs whose shingle sets have denom * intersection >= numer * union, from their whole texts."""
    ends = settle(pairs.select(F.col("x").alias("rep")).unionByName(pairs.select(F.col("y").alias("rep"))).distinct(), "near-ends")
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").alias("rep"), text_of().alias("text")).join(small(ends), "rep", "left_semi")
    texts = settle(texts, "near-texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for batch in batches:
            keep = []
            for s, t in zip(batch.column("s"), batch.column("t")):  # one text after the other, for the memory
                s = s.as_py()
                if last[0] != s:
                    last = (s, shingle_set(hashed_words([encode(s).lower()])[0], size))
                other = shingle_set(hashed_words([encode(t.as_py()).lower()])[0], size)
                common = len(np.intersect1d(last[1], other, assume_unique=True))
                keep.append(common > 0 and common * denom >= (len(last[1]) + len(other) - common) * numer)
            yield batch.select(["x", "y"]).filter(pa.array(keep, type=pa.bool_()))

    both = pairs.join(texts.select(F.col("rep").alias("y"), F.col("text").alias("t")), "y").join(
        texts.select(F.col("rep").alias("x"), F.col("text").alias("s")), "x")
    return both.select("x", "y", "s", "t").mapInArrow(run, "x long, y long")


def shingle_rarity(texts: DataFrame, size: int) -> np.ndarray:
    """Shingles of the texts by hash bucket: as many numbers as buckets, whatever the size of the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RARITY_BITS, dtype=np.int64)
        for batch in batches:
            for _, part in chunks(encode(t.as_py()).lower() for t in batch.column("text")):
                words, at = hashed_words(part)
                for i in range(len(part)):
                    np.add.at(total, (shingle_set(words[at[i]:at[i + 1]], size) >> np.uint64(64 - RARITY_BITS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    counted = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counted = settle(counted, "near-rarity").toArrow()
    rarity = np.zeros(1 << RARITY_BITS, dtype=np.int64)
    rarity[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return np.minimum(rarity, np.iinfo(np.int32).max).astype(np.int32)


def prefix_pairs(docs: DataFrame, nodes: DataFrame, size: int, numer: int, denom: int) -> DataFrame:
    """``x, y`` of all documents of ``nodes`` (``rep, component``) that may be linked across components, exactly.

    Two sets of the similarity asked for share one of the first n - ceil(t n) + 1 shingles of each, rare ones first.  In a
    large group of texts that differ from each other a little too much, those are shingles that no other text has.
    """
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("rep"), text_of().alias("text")).join(small(nodes), "rep")
    texts = settle(texts.select("rep", "component", "text"), "near-texts")
    rarity = shingle_rarity(texts, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in chunks(encode(t.as_py()).lower() for t in batch.column("text")):
                words, at = hashed_words(part)
                keys, sizes = [], []
                for i in range(len(part)):
                    found = shingle_set(words[at[i]:at[i + 1]], size)
                    order = np.lexsort((found, rarity[(found >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]))
                    n = len(found)
                    keys.append(found[order[:n - -(-numer * n // denom) + 1]] if n else found)
                    sizes.append(n)
                lengths = [len(k) for k in keys]
                owner = np.repeat(np.arange(len(part)), lengths)
                start = np.cumsum(lengths) - lengths
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(keys).view(np.int64)), batch.column("rep").take(pa.array(owner + first)),
                    batch.column("component").take(pa.array(owner + first)), pa.array(np.asarray(sizes, dtype=np.int32)[owner]),
                    pa.array((np.arange(len(owner)) - start[owner]).astype(np.int32))], ["key", "rep", "component", "n", "p"])

    index = texts.mapInArrow(run, "key long, rep long, component long, n int, p int")
    left, right = index.alias("l"), index.alias("r")
    n, m = F.col("l.n"), F.col("r.n")
    room = F.least(n - F.col("l.p"), m - F.col("r.p")) * (numer + denom) >= (n + m) * numer
    alike = F.greatest(n, m) * numer <= F.least(n, m) * denom
    return left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.rep") < F.col("r.rep"))
                     & (F.col("l.component") != F.col("r.component")) & alike & room).select(
        F.col("l.rep").alias("x"), F.col("r.rep").alias("y")).distinct()


def linked(docs: DataFrame, classes: DataFrame, size: int, numer: int, denom: int) -> DataFrame:
    """``x, y``: enough links between the classes to connect all that links connect.

    All pairs of a band are candidates, but few are needed once every member has met some others.  So rounds of meetings
    come first: in each, one member of a band meets those that are not yet connected with it.  Members of bands that are
    then still in several components are joined by their rarest shingles.
    """
    threshold = numer / denom

    def test(pairs: DataFrame) -> DataFrame:
        return settle(confirmed(settle(likely(pairs, classes, threshold), "near-likely"), docs, size, numer, denom), "near-links")

    bands = band_keys(classes)
    shared = bands.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("key")
    left = settle(bands.join(shared, "key"), "near-members").withColumn("component", F.col("rep"))
    found: list[DataFrame] = []
    for meeting in range(MEETINGS + 1):
        apart = left.groupBy("key").agg(
            F.min("component").alias("low"), F.max("component").alias("high"),
            F.min(F.struct(F.xxhash64("rep", F.lit(meeting)).alias("h"), F.col("rep").alias("x"), F.col("component").alias("c"))).alias("m")
        ).filter("low < high").select("key", "m.x", "m.c")
        left = settle(left.join(apart, "key"), "near-left")
        if meeting == MEETINGS or left.isEmpty():
            break
        pairs = left.filter("component <> c").select(F.least("x", "rep").alias("x"), F.greatest("x", "rep").alias("y")).distinct()
        found.append(test(pairs))
        labels = components(functools.reduce(DataFrame.unionByName, found))
        left = left.select("key", "rep").join(labels.select(F.col("v").alias("rep"), "component"), "rep", "left").select(
            "key", "rep", F.coalesce("component", "rep").alias("component"))
    if not left.isEmpty():
        nodes = settle(left.select("rep", "component").distinct(), "near-nodes")
        found.append(test(prefix_pairs(docs, nodes, size, numer, denom)))
    none = classes.select(F.col("rep").alias("x"), F.col("rep").alias("y")).limit(0)
    return functools.reduce(DataFrame.unionByName, found, none)


def near_duplicates(docs: DataFrame, size: int = 5, numer: int = NUMER, denom: int = DENOM) -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when denom * intersection >= numer * union of their sets of ``size``-word shingles (words split
    at white space, A-Z in lower case; fewer words are one shingle).  ``component_id`` is the smallest doc_id that links
    reach, the document itself included; ``kept`` says that it is the document's own.

    Texts without words, and nulls, are linked with nothing.  Rows that repeat a doc_id are one document: what any of
    them is linked with, all are.  Rows without a doc_id are compared with nothing, have no component and are kept.  No
    rows give no rows.  Other columns are ignored.
    """
    prints = settle(fingerprints(docs, size), "near-prints")
    sets = prints.filter("doc_id is not null and n_shingles > 0")
    classes = settle(
        sets.groupBy("n_shingles", "a", "b").agg(F.min(F.struct(F.col("doc_id").cast("long").alias("rep"), "sig")).alias("x"))
        .select("n_shingles", "a", "b", "x.rep", "x.sig"), "near-classes")
    links = linked(docs, classes, size, numer, denom)
    copies = sets.select("doc_id", "n_shingles", "a", "b").join(classes.drop("sig"), ["n_shingles", "a", "b"]).select(
        F.col("doc_id").cast("long").alias("x"), F.col("rep").alias("y")).filter("x <> y")
    whole = components(links.unionByName(copies)).select(F.col("v").alias("__id"), "component")
    rows = prints.select("doc_id", "n_shingles").join(whole, F.col("doc_id") == F.col("__id"), "left")
    component = F.coalesce("component", F.col("doc_id").cast("long"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"),
                       F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def first_of_each(docs: DataFrame, size: int = 5) -> DataFrame:
    """The documents, all columns, less those that are near-duplicates of one with a smaller doc_id."""
    gone = near_duplicates(docs, size).filter("not kept").select(F.col("doc_id").alias("__id"))
    return docs.join(small(settle(gone.distinct(), "near-gone")), F.col("doc_id") == F.col("__id"), "left_anti")
