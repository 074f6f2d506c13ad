"""Katz backoff language model, and the scores it gives to texts.

Texts are kept in blocks.  A block asks once for each of its distinct n-grams, whatever their order, so a frequent word
or pair is one entry per block and no key is hot.  The questions go to buckets by the leading bits of the n-gram's hash; a bucket
adds up the training counts and answers with one count per question.  From the counts come the Good-Turing discounts, and
each block then evaluates its tokens from the longest n-gram down: a seen n-gram gives discounted count / history
count; an unseen one the backoff weight of its history, if that was seen, times the estimate one word shorter.

A backoff weight is (1 - mass of the history's seen words) / (1 - mass that the shorter model gives the same words), so
each history's distribution adds up to one exactly.  Of all blocks that hold an n-gram one is told that it is the first; only
that one adds it to the masses.  Counts, masses and needs are tables in the shared folder, split by hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import discard, release, settle, text_of
from .hashing import encode, hashed_words, mixed

#: Bytes of text in a block, and of text to a bucket of n-gram counts.
BLOCK_BYTES, BUCKET_BYTES = 4_500_000, 12_000_000
#: Counts beyond this share one entry of the counts of counts.
TOP = 1000
#: Up to this count the discount is Turing's own, where that is sound; above, and else, it follows the fitted line.
TURING = 5
_BEGIN, _END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
_LONGER = np.uint64(0x9DDFEA08EB382D69)
_SIZE = mixed(np.arange(16, dtype=np.uint64))  # apart by the length of an n-gram


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def pack(values: np.ndarray) -> bytes:
    """The numbers byte by byte, all first bytes before all second ones, which lets slowly growing numbers compress."""
    return zlib.compress(np.ascontiguousarray(values.reshape(-1, 1).view(np.uint8).T).tobytes(), 1)


def unpack(data: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def blocks(docs: DataFrame, train: Column) -> DataFrame:
    """``block, ids, train, sizes, vocabulary, codes``: the texts as places in the block's list of word hashes."""
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType)),
        *(T.StructField(n, T.BinaryType()) for n in ("train", "sizes", "vocabulary", "codes"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, flags, texts, held, number = [], [], [], 0, TaskContext.get().partitionId() << 24

        def block() -> pa.RecordBatch:
            words, at = hashed_words(texts)
            vocabulary, inverse, counts = np.unique(words, return_inverse=True, return_counts=True)
            place = np.empty(len(vocabulary), dtype=np.uint32)  # frequent words get small numbers
            order = np.argsort(-counts, kind="stable")
            place[order] = np.arange(len(vocabulary), dtype=np.uint32)
            row = [number, ids, pack(np.array(flags, dtype=np.uint8)), pack(np.diff(at).astype(np.uint32)),
                   vocabulary[order].tobytes(), pack(place[inverse])]
            return pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(row, kinds)], schema.names)

        for batch in batches:
            kinds = [pa.int64(), pa.list_(batch.schema.field("doc_id").type), *[pa.binary()] * 4]
            for i, text in enumerate(batch.column("text")):
                texts.append(encode(text.as_py()).lower())
                ids.append(batch.column("doc_id")[i].as_py())
                flags.append(batch.column("train")[i].as_py())
                held += len(texts[-1])
                if held > BLOCK_BYTES:
                    yield block()
                    ids, flags, texts, held, number = [], [], [], 0, number + 1
        if texts:
            yield block()

    return docs.select("doc_id", train.alias("train"), text_of().alias("text")).mapInArrow(run, schema)


class Block:
    """The n-grams of a block's texts.

    ``x`` holds every text's words between a begin and an end mark.  ``grams[k]`` are the hashes of the k + 1 symbols
    that end at each place, ``valid[k]`` says where the text has so many.  ``keys`` are the distinct hashes in order, and
    ``at[k]`` the place of each n-gram in them.
    """

    def __init__(self, row: dict, order: int):
        vocabulary, codes = np.frombuffer(row["vocabulary"], dtype=np.uint64), unpack(row["codes"], np.uint32)
        self.ids, self.train = row["ids"], unpack(row["train"], np.uint8).astype(bool)
        sizes = unpack(row["sizes"], np.uint32).astype(np.int64) + 2
        first = np.cumsum(sizes) - sizes
        self.x = np.full(int(sizes.sum()), _BEGIN)
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(len(self.x)) - first[self.row]
        inner = (self.place > 0) & (self.place < sizes[self.row] - 1)
        self.x[inner] = vocabulary[codes]
        self.x[first + sizes - 1] = _END
        self.token = self.place > 0
        self.grams, self.valid = [mixed(self.x)], [np.ones(len(self.x), dtype=bool)]
        for k in range(1, order):
            longer = np.zeros_like(self.x)
            longer[k:] = mixed(self.grams[-1][k - 1:-1] * _LONGER + self.x[k:] + _SIZE[k])
            self.grams.append(longer)
            self.valid.append(self.place >= k)
        every = np.concatenate([g[v] for g, v in zip(self.grams, self.valid)])
        self.keys, self.example, inverse = np.unique(every, return_index=True, return_inverse=True)
        self.at, begin = [], 0
        where = []
        for v in self.valid:
            full = np.zeros(len(self.x), dtype=np.int64)
            n = int(v.sum())
            full[v] = inverse[begin:begin + n]
            self.at.append(full)
            where.append(np.flatnonzero(v))
            begin += n
        self.order_of = np.searchsorted(np.cumsum([len(w) for w in where]), self.example, side="right").astype(np.uint8)
        self.example = np.concatenate(where)[self.example]  # a place of x where the n-gram ends

    def train_counts(self) -> np.ndarray:
        total = np.zeros(len(self.keys), dtype=np.int64)
        known = self.train[self.row]
        for a, v in zip(self.at, self.valid):
            total += np.bincount(a[v & known], minlength=len(self.keys))
        return total


def questions(stored: DataFrame, order: int, bits: int) -> DataFrame:
    """``bucket, block, keys, counts, orders``: a block's distinct n-grams with their counts in its training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, order)
                counts = block.train_counts().astype(np.uint32)
                bounds = np.searchsorted(block.keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
                bounds = np.append(bounds, len(block.keys))
                for bucket in np.flatnonzero(np.diff(bounds)):
                    part = slice(bounds[bucket], bounds[bucket + 1])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(bucket)], type=pa.int32()), pa.array([row["block"]], type=pa.int64()),
                        pa.array([pack(block.keys[part])]), pa.array([pack(counts[part])]), pa.array([pack(block.order_of[part])]),
                    ], ["bucket", "block", "keys", "counts", "orders"])

    return stored.mapInArrow(run, "bucket int, block long, keys binary, counts binary, orders binary")


def answers(asked: DataFrame) -> DataFrame:
    """Per question ``block, bucket, counts``: 0 if no other block's training texts hold the n-gram, which most do not; else the
    counts of the others, doubled, plus one for the block that counts as first.

    Rows without a block are counts of counts: ``size`` (0 for single words), ``r`` (capped), ``n`` n-grams, ``total``.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        keys = [unpack(x.as_py(), np.uint64) for x in table.column("keys")]
        own = np.concatenate([unpack(x.as_py(), np.uint32) for x in table.column("counts")]).astype(np.int64)
        sizes = np.concatenate([unpack(x.as_py(), np.uint8) for x in table.column("orders")])
        distinct, example, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=own, minlength=len(distinct)).astype(np.int64)
        holders = np.flatnonzero(own)
        first = np.zeros(len(own), dtype=np.int64)
        _, lead = np.unique(inverse[holders], return_index=True)
        first[holders[lead]] = 1
        others = total[inverse] - own
        reply = np.where(others > 0, 2 * others + first, 0).astype(np.uint64)
        ends = np.cumsum([len(k) for k in keys])
        replies = [pack(reply[e - len(k):e]) for k, e in zip(keys, ends)]
        begin = mixed(np.array([_BEGIN]))[0]
        live = np.flatnonzero((total > 0) & (distinct != begin))
        cell = sizes[example][live].astype(np.int64) * (TOP + 2) + np.minimum(total[live], TOP + 1)
        kinds, which, n = np.unique(cell, return_inverse=True, return_counts=True)
        sums = np.bincount(which, weights=total[live], minlength=len(kinds)).astype(np.int64)
        blank = [None] * len(kinds)
        return pa.table({
            "block": pa.array(table.column("block").to_pylist() + blank, type=pa.int64()),
            "bucket": pa.array(table.column("bucket").to_pylist() + blank, type=pa.int32()),
            "counts": pa.array(replies + blank, type=pa.binary()),
            "size": pa.array([None] * len(replies) + (kinds // (TOP + 2)).tolist(), type=pa.int32()),
            "r": pa.array([None] * len(replies) + (kinds % (TOP + 2)).tolist(), type=pa.int32()),
            "n": pa.array([None] * len(replies) + n.tolist(), type=pa.int64()),
            "total": pa.array([None] * len(replies) + sums.tolist(), type=pa.int64()),
        })

    return asked.groupBy("bucket").applyInArrow(
        run, "block long, bucket int, counts binary, size int, r int, n long, total long")


def discounts(counts: dict[int, int]) -> tuple[float, dict[int, float]]:
    """Good-Turing: the slope of log(count of counts) against log(count), and Turing's discounts for small counts.

    On the line r* = r (1 + 1/r) ** (slope + 1), below r for every r as the slope is held under -1.
    """
    seen = sorted(r for r in counts if 0 < r <= TOP)
    x, y = [], []
    for i, r in enumerate(seen):  # n_r spread over the gap to its neighbours, as large counts are sparse
        low, high = (seen[i - 1] if i else 0), (seen[i + 1] if i + 1 < len(seen) else 2 * r - (seen[i - 1] if i else 0))
        x.append(log(r))
        y.append(log(counts[r] / max(0.5 * (high - low), 0.5)))
    slope = float(np.polyfit(x, y, 1)[0]) if len(x) > 1 else -2.0
    slope = min(slope, -1.1)
    small = {}
    for r in range(1, TURING + 1):
        if counts.get(r) and counts.get(r + 1):
            d = (r + 1) * counts[r + 1] / (r * counts[r])
            if 0.05 < d < 0.999:
                small[r] = d
    return slope, small


def discounted(c: np.ndarray, rule: tuple[float, dict[int, float]]) -> np.ndarray:
    """The discounted counts; all counts must be positive."""
    slope, small = rule
    d = (1 + 1 / c) ** (slope + 1)
    for r, value in small.items():
        d[c == r] = value
    return c * d


_EVALUATED = ("kind string, block long, row int, n_tokens long, n_known long, base double, seen double, "
              "key long, mass double, lower double, times long")  # and the doc_id


def evaluate(stored: DataFrame, replies: DataFrame, order: int, words: int, kinds: int, rules: list) -> DataFrame:
    """Three kinds of rows: ``doc`` (sums per text), ``mass`` (per seen n-gram's history) and ``need`` (weights to apply).

    ``words`` and ``kinds`` are the training tokens and the distinct ones.
    """
    id_type = stored.schema["ids"].dataType.elementType
    schema = T.StructType([*T.StructType.fromDDL(_EVALUATED).fields, T.StructField("doc_id", id_type)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        id_kind = left.schema.field("ids").type.value_type
        (row,) = left.to_pylist()
        b = Block(row, order)
        right = right.sort_by("bucket")
        reply = np.concatenate([unpack(x.as_py(), np.uint64) for x in right.column("counts")]).astype(np.int64)
        own = b.train_counts()
        count, first = own + (reply >> 1), np.where(reply > 0, reply & 1, own > 0).astype(bool)
        n_docs, tokens = len(b.ids), b.token

        def estimate(k: int, place: np.ndarray) -> np.ndarray:
            """Discounted probability of the seen n-gram of k + 1 symbols that ends at each place."""
            c = count[b.at[k][place]].astype(float)
            return discounted(c, rules[k]) / (count[b.at[k - 1][place - 1]] if k else float(words))

        def per_doc(place: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
            return np.bincount(b.row[place], weights=weights, minlength=n_docs)

        seen, open_ = np.zeros(n_docs), np.flatnonzero(tokens)
        one = np.where(tokens, count[b.at[0]], 0)
        base = per_doc(open_, np.log10((one[open_] + 1) / (words + kinds + 1)))
        need_key, need_row = [], []
        for k in range(order - 1, -1, -1):
            able = b.valid[k][open_]
            hit = able & (count[b.at[k][open_]] > 0)
            found = open_[hit]
            seen += per_doc(found, np.log10(estimate(k, found)))
            if k:
                missed = open_[able & ~hit]
                history = b.at[k - 1][missed - 1]
                back = count[history] > 0
                need_key.append(history[back])
                need_row.append(b.row[missed[back]])
            open_ = open_[~hit]
        pairs, times = np.unique(np.concatenate([*need_key, []]).astype(np.int64) * n_docs + np.concatenate([*need_row, []]).astype(np.int64),
                                 return_counts=True)
        owned = np.flatnonzero(first & (b.order_of > 0))
        key, mass, lower = [], [], []
        for k in range(1, order):
            place = b.example[owned[b.order_of[owned] == k]]
            key.append(b.at[k - 1][place - 1])
            mass.append(estimate(k, place))
            lower.append(estimate(k - 1, place))
        key, mass, lower = (np.concatenate([*x, []]) for x in (key, mass, lower))
        histories, which = np.unique(key.astype(np.int64), return_inverse=True)
        single = np.flatnonzero(first & (b.order_of == 0) & tokens[b.example])
        single_mass = estimate(0, b.example[single]).sum() if len(single) else 0.0
        parts = {
            "doc": {"row": np.arange(n_docs), "n_tokens": per_doc(np.flatnonzero(tokens)), "n_known": per_doc(np.flatnonzero(one)),
                    "base": base, "seen": seen},
            "mass": {"key": b.keys[histories].view(np.int64), "mass": np.bincount(which, weights=mass, minlength=len(histories)),
                     "lower": np.bincount(which, weights=lower, minlength=len(histories))},
            "words": {"mass": np.array([single_mass])},
            "need": {"row": pairs % max(n_docs, 1), "key": b.keys[pairs // max(n_docs, 1)].view(np.int64), "times": times},
        }
        tables = []
        for kind, columns in parts.items():
            n = len(next(iter(columns.values())))
            arrays = [pa.array([kind] * n, type=pa.string()), pa.array(np.full(n, row["block"]))]
            for field in schema.fields[2:-1]:
                t = {"integer": pa.int32(), "long": pa.int64(), "double": pa.float64()}[field.dataType.typeName()]
                arrays.append(pa.array(columns[field.name]).cast(t) if field.name in columns else pa.nulls(n, t))
            arrays.append(pa.array(b.ids, type=id_kind) if kind == "doc" else pa.nulls(n, id_kind))
            tables.append(pa.Table.from_arrays(arrays, schema.names))
        return pa.concat_tables(tables)

    return stored.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def score(docs: DataFrame, order: int = 2, train: Column | None = None) -> DataFrame:
    """Per row ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model is learnt from the rows where ``train`` holds (by default those not ``held_out``); all rows are scored.  Words
    are split at white space, A-Z in lower case; every text ends with an end token.  ``score`` is the log10 probability of
    the text's tokens.  A word that training never saw has the mass that the discounts take from single words.
    ``base_score`` is that of single words with one added to every count.

    Null texts are empty: an end token alone.  Without training rows every token is unknown.  A null doc_id counts as an
    empty text for the choice of rows.  Repeated rows are texts of their own.  No rows give no rows.  Other columns are
    ignored.
    """
    held = held_out(F.col("doc_id"))
    train = ~held if train is None else train
    total = docs.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
    bits = max(1, int(np.ceil(np.log2(max(total / BUCKET_BYTES, 1)))))
    stored = settle(blocks(docs, train), "lm-blocks")
    replies = settle(answers(questions(stored, order, bits)), "lm-counts")
    release(docs.sparkSession)
    rows = replies.filter("block is null").groupBy("size", "r").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    words = sum(r.total for r in rows if r["size"] == 0)
    kinds = sum(r.n for r in rows if r["size"] == 0)
    rules = [discounts({r.r: r.n for r in rows if r["size"] == k}) for k in range(order)]
    parts = settle(evaluate(stored, replies.filter("block is not null").select("block", "bucket", "counts"),
                            order, words, kinds, rules), "lm-parts")
    discard(stored, replies)
    release(docs.sparkSession)
    unknown = 1 - (parts.filter("kind = 'words'").agg(F.sum("mass")).first()[0] or 0.0)
    weights = parts.filter("kind = 'mass'").groupBy("key").agg(F.sum("mass").alias("mass"), F.sum("lower").alias("lower"))
    weights = weights.select("key", F.log10((1 - F.col("mass")) / (1 - F.col("lower"))).alias("weight"))
    backed = parts.filter("kind = 'need'").select("key", "block", "row", "times").join(weights, "key").groupBy("block", "row").agg(
        F.sum(F.col("times") * F.col("weight")).alias("backed"))
    sums = parts.filter("kind = 'doc'").select("block", "row", "doc_id", "n_tokens", "n_known", "base", "seen")
    log_unknown = float(np.log10(max(unknown, 1e-300)))
    return sums.join(backed, ["block", "row"], "left").select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(words).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        (F.col("seen") + F.coalesce("backed", F.lit(0.0)) + (F.col("n_tokens") - F.col("n_known")) * log_unknown).alias("score"))
