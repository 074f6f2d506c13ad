"""Substring dedup: long word sequences that stand earlier in the corpus are removed.

Recompression names runs of symbols round by round: a symbol's class is one bit of its name, a symbol of the left class
followed by one of the right class becomes one symbol, and the pair's name is a hash of both, so equal pairs get equal
names in every task without a table of names.  (Equal neighbours have one class and never pair: a run of one word keeps
all its places as symbol starts, and how far it reaches changes no name.)  Which places start a symbol after ``ROUNDS``
rounds depends on two words before and three after them only, so equal passages have the same interior symbols.

Every window picks one of its interior symbol starts, the one whose symbol has the smallest hash.  Equal windows pick
the same place, so only windows whose place has a neighbourhood that stands somewhere else too can repeat.  Of these few
the whole windows are compared, and each keeps its first place in the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import BROADCAST_ROWS, settle, small, text_of
from .hashing import chunks, encode, hashed_words, mixed, window_hashes

ROUNDS = 2
#: Words on either side of a picked place that its key covers; a symbol start depends on fewer.
REACH = 5
_LEFT, _RIGHT, _CLASS, _RANK = (np.uint64(x) for x in (
    0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def symbols(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and first words of the symbols after all rounds; none crosses from one document to the next."""
    name, start = words.copy(), np.arange(len(words))
    for r in range(ROUNDS):
        left = (mixed(name ^ (_CLASS + np.uint64(r))) & np.uint64(1)) == 0
        first = np.flatnonzero(left[:-1] & ~left[1:] & (doc[start[:-1]] == doc[start[1:]]))
        name[first] = mixed(name[first] * _LEFT + name[first + 1] * _RIGHT + np.uint64(r))
        stays = np.ones(len(name), dtype=bool)
        stays[first + 1] = False
        name, start = name[stays], start[stays]
    return name, start


def picked_places(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(key, first, last)``: per picked place the hash of the words around it and the windows that pick it."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    name, start = symbols(words, doc)
    rank = np.full(len(words), _MOST)
    rank[start] = mixed(name ^ _RANK) >> np.uint64(1)
    best, place = rank[REACH:n + REACH].copy(), np.full(n, REACH)
    for k in range(REACH + 1, size - REACH + 1):
        lower = rank[k:n + k] < best
        best[lower], place[lower] = rank[k:n + k][lower], k
    window = np.flatnonzero(doc[:n] == doc[size - 1:])
    place = (place + np.arange(n))[window]
    if not len(window):
        return np.zeros(0, dtype=np.uint64), window, window
    new = np.flatnonzero(np.diff(place, prepend=-1))
    around = window_hashes(words, 2 * REACH)
    return around[place[new] - REACH], window[new], window[np.append(new[1:], len(window)) - 1]


def _split(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
    for first, part in chunks(encode(t.as_py()) for t in batch.column("text")):
        words, at = hashed_words(part)
        yield first, part, words, at


def places(docs: DataFrame, size: int) -> DataFrame:
    """``key, doc_id, __th, first, last`` of every place that windows of the documents pick (window numbers, from 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, part, words, at in _split(batch):
                doc = np.repeat(np.arange(len(part)), np.diff(at))
                key, first, last = picked_places(words, doc, size)
                owner = doc[first]
                yield pa.RecordBatch.from_arrays([
                    pa.array(key.view(np.int64)), batch.column("doc_id").take(pa.array(owner + begin)),
                    batch.column("__th").take(pa.array(owner + begin)),
                    pa.array((first - at[owner]).astype(np.int32)), pa.array((last - at[owner]).astype(np.int32)),
                ], ["key", "doc_id", "__th", "first", "last"])

    schema = T.StructType([T.StructField("key", T.LongType()), docs.schema["doc_id"], docs.schema["__th"],
                           T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
    return docs.select("doc_id", "__th", "text").mapInArrow(run, schema)


def _runs(flags: np.ndarray) -> list[dict]:
    """The stretches of true places."""
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def _marked(ranges: list[dict] | None) -> np.ndarray:
    flags = np.zeros(max((x["last"] for x in ranges or ()), default=-1) + 1, dtype=bool)
    for x in ranges or ():
        flags[x["first"]:x["last"] + 1] = True
    return flags


def joined_ranges(ranges: DataFrame) -> DataFrame:
    """``__id, __h, ranges`` with neighbouring ranges made one."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_runs(_marked(x.as_py())) for x in batch.column("ranges")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("__h"), pa.array(out, type=kind)], ["__id", "__h", "ranges"])

    schema = T.StructType([ranges.schema[name] for name in ("__id", "__h", "ranges")])
    return ranges.select("__id", "__h", "ranges").mapInArrow(run, schema)


def repeated_ranges(ranges: DataFrame) -> DataFrame:
    """``__id, __h, hits``: the windows of ``ranges`` without those in the list ``firsts``, for documents that have any."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for marks, firsts in zip(batch.column("ranges"), batch.column("firsts")):
                flags = _marked(marks.as_py())
                if firsts.is_valid:
                    at = firsts.values.to_numpy(zero_copy_only=False)
                    flags[at[at < len(flags)]] = False
                out.append(_runs(flags))
            table = pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("__h"), pa.array(out, type=kind)], ["__id", "__h", "hits"])
            yield table.filter(pa.array([bool(x) for x in out], type=pa.bool_()))

    schema = T.StructType([ranges.schema["__id"], ranges.schema["__h"], T.StructField("hits", ranges.schema["ranges"].dataType)])
    return ranges.select("__id", "__h", "ranges", "firsts").mapInArrow(run, schema)


def listed_windows(docs: DataFrame, size: int) -> DataFrame:
    """``w, doc_id, __th, at``: hash and number of every window in the documents' ``ranges``.

    Of equal windows a task met together only the first is given, which is all that counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, part, words, at in _split(batch):
                whole = window_hashes(words, size)
                wanted = np.zeros(len(whole), dtype=bool)
                for i in range(len(part)):
                    end = max(at[i + 1] - size + 1, at[i])  # windows beyond it reach into the next text
                    for x in batch.column("ranges")[begin + i].as_py() or ():
                        wanted[at[i] + x["first"]:min(at[i] + x["last"] + 1, end)] = True
                place = np.flatnonzero(wanted)
                doc = np.searchsorted(at, place, side="right") - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(whole[place].view(np.int64)), batch.column("doc_id").take(pa.array(doc + begin)),
                    batch.column("__th").take(pa.array(doc + begin)), pa.array((place - at[doc]).astype(np.int32))],
                    ["w", "doc_id", "__th", "at"])

    schema = T.StructType([T.StructField("w", T.LongType()), docs.schema["doc_id"], docs.schema["__th"],
                           T.StructField("at", T.IntegerType())])
    return docs.select("doc_id", "__th", "text", "ranges").mapInArrow(run, schema)


def cut(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_words, n_removed, text`` without the words of the windows in ``hits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in chunks(encode(t.as_py()) for t in batch.column("text")):
                total, gone, texts = [], [], []
                for text, hits in zip(part, batch.column("hits").slice(first, len(part))):
                    words = text.split()
                    kept, begin = [], 0
                    for x in hits.as_py() or ():
                        kept += words[begin:x["first"]] if x["first"] > begin else []
                        begin = x["last"] + size
                    kept += words[begin:]
                    total.append(len(words))
                    gone.append(len(words) - len(kept))
                    texts.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, len(part)), pa.array(total, type=pa.int64()), pa.array(gone, type=pa.int64()),
                    pa.array(texts, type=pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("text", T.StringType())])
    return docs.select("doc_id", "text", "hits").mapInArrow(run, schema)


def few(ranges: DataFrame, column: str) -> DataFrame:
    """Marked for broadcast if rows and ranges are few; else the texts are shuffled to where their ranges are."""
    total = ranges.agg(F.sum(F.size(column))).first()[0] or 0
    return small(ranges) if total <= 4 * BROADCAST_ROWS else ranges


def dedup_substrings(docs: DataFrame, size: int = 20) -> DataFrame:
    """Per row ``doc_id, n_words, n_removed, text``: the words left, joined by one space.

    A word goes if a window of ``size`` words over it has its word sequence at an earlier place too: in a document of
    smaller doc_id, or earlier in its own.  All windows are judged on the input.  Words are split at white space and
    compared as they are.

    Null texts, and those of fewer words than a window, lose nothing.  Rows without a doc_id stand before all others.  Rows
    that agree in doc_id (or have none) and text are one document: the same window at the same place of both is no
    repeat.  Those that agree in doc_id alone are documents of their own, in the order of a hash of their texts.  No rows
    give no rows.  Other columns are ignored.
    """
    if size < 2 * REACH + 2 ** ROUNDS - 1:
        raise ValueError("a window must be long enough to hold a symbol start in its middle")
    texts = docs.select("doc_id", F.xxhash64(text_of()).alias("__th"), text_of().alias("text"))
    picked = places(texts, size)
    repeated = settle(picked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "sub-keys")
    ranges = picked.join(repeated, "key").groupBy(F.col("doc_id").alias("__id"), F.col("__th").alias("__h")).agg(
        F.collect_list(F.struct("first", "last")).alias("ranges"))
    ranges = settle(joined_ranges(ranges), "sub-ranges")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__h"))
    windows = listed_windows(texts.join(few(ranges, "ranges"), same), size)
    firsts = windows.groupBy("w").agg(F.min(F.struct("doc_id", "__th", "at")).alias("x")).select("x.doc_id", "x.__th", "x.at")
    firsts = firsts.groupBy("doc_id", "__th").agg(F.collect_list("at").alias("firsts"))
    both = ranges.join(firsts, same, "left")
    hits = settle(repeated_ranges(both.select("__id", "__h", "ranges", "firsts")), "sub-hits")
    return cut(texts.join(few(hits, "hits"), same, "left").select("doc_id", "text", "hits"), size)
