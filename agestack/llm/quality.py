"""Quality rules: fixed rules on words and lines, then a likelihood ratio between good texts and all texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import WORD, settle, text_of

#: Hash buckets of the two multinomials.
BUCKETS = 1 << 16
#: Bytes in an n-gram.
GRAM = 4
#: At most so many documents labelled good stand for good text: the first by a hash of doc_id.
LABELLED = 200_000
#: A document whose n-grams are, in the geometric mean, less likely in good text than this many nats below all text, goes.
THRESHOLD = -0.5
#: Texts are worked on together until they hold so many characters.
CHUNK_CHARS = 4_000_000
MIN_WORDS, MAX_REPEATED = 50, 0.5
SYMBOLS = "#*$%&|<>"


def grams(text: str) -> np.ndarray:
    """The hash buckets of the text's n-grams of UTF-8 bytes."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + raw[k:n + k] + np.uint64(1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64)


def gram_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``bucket, every, good``: n-grams of all documents, and of those whose doc_id is in ``trusted``.

    Each task adds up what it reads, so the shuffle has one number per task and bucket.
    """
    marked = docs.select("doc_id", text_of().alias("text")).join(
        F.broadcast(trusted.select("doc_id", F.lit(True).alias("good"))), "doc_id", "left").select("text", "good")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, good = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for text, is_good in zip(batch.column("text"), batch.column("good")):
                g = grams(text.as_py())
                if len(g) * 8 < BUCKETS:
                    np.add.at(every, g, 1)
                    if is_good.as_py():
                        np.add.at(good, g, 1)
                    continue
                here = np.bincount(g, minlength=BUCKETS)
                every += here
                if is_good.as_py():
                    good += here
        used = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(every[used]), pa.array(good[used])], ["bucket", "every", "good"])

    return marked.mapInArrow(count, "bucket long, every long, good long").groupBy("bucket").agg(
        F.sum("every").alias("every"), F.sum("good").alias("good"))


def trusted_documents(labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """``doc_id`` of documents all of whose labels say good quality; beyond ``limit``, the first by a hash."""
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"))
    return good.filter("q = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Per bucket log p(bucket | good text) - log p(bucket | all text), each count plus one.

    All zero if no text is labelled good.  The result has ``BUCKETS`` numbers, whatever the size of the corpus.
    """
    trusted = settle(trusted_documents(labels), "quality-trusted")
    every, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in gram_counts(docs, trusted).collect():  # one row per bucket
        every[row.bucket], good[row.bucket] = row.every, row.good
    if not good.any():
        return np.zeros(BUCKETS)
    return np.log((good + 1) / (good.sum() + BUCKETS)) - np.log((every + 1) / (every.sum() + BUCKETS))


def repeated_words(words: list[list[str]]) -> np.ndarray:
    """Per text, the words in 3-word windows that the text has twice or more."""
    sizes = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))
    if not sizes.sum():
        return np.zeros(len(words), dtype=np.int64)
    code = pd.factorize(np.array([x for w in words for x in w], dtype=object))[0].astype(np.int64)
    text = np.repeat(np.arange(len(words)), sizes)
    inside = np.flatnonzero(text[:-2] == text[2:]) if len(text) > 2 else np.zeros(0, dtype=np.int64)
    kinds = int(code.max()) + 1
    pair = pd.factorize(code[inside] * kinds + code[inside + 1])[0]
    three = pd.factorize(pair * kinds + code[inside + 2])[0]
    which = three * len(words) + text[inside]  # a window within a text
    number, counts = pd.factorize(which)[0], None
    counts = np.bincount(number, minlength=1)
    again = inside[counts[number] > 1] if len(inside) else inside
    hit = np.zeros(len(code), dtype=bool)
    for k in range(3):
        hit[again + k] = True
    return np.bincount(text[hit], minlength=len(words))


def measure(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Per row ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_ratio, kept``."""
    schema = T.StructType([
        docs.schema["doc_id"],
        *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        T.StructField("base_failed", T.BooleanType()), T.StructField("log_ratio", T.DoubleType()),
        T.StructField("kept", T.BooleanType()),
    ])
    word = re.compile(WORD)
    blank = " \t\n\v\f\r"

    def judge(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        words = [word.findall(t) for t in texts]
        n = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))
        chars = [sum(map(len, w)) for w in words]
        symbols = [sum(map(t.count, SYMBOLS)) for t in texts]
        lines = [[x for x in t.split("\n") if x.strip(blank)] for t in texts]
        doubles = [len(x) - len(set(x)) for x in lines]
        repeats = repeated_words(words)
        found = [grams(t) for t in texts]
        score = np.array([ratios[g].mean() if len(g) else 0.0 for g in found])
        failed = (n < MIN_WORDS) | (repeats > MAX_REPEATED * n)
        columns = [ids, *map(pa.array, (n, chars, symbols, doubles, repeats, failed, score, ~failed & (score >= threshold)))]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            first, held = 0, 0
            for i, text in enumerate(texts):
                held += len(text)
                if held > CHUNK_CHARS or i + 1 == len(texts):
                    yield judge(batch.column("doc_id").slice(first, i + 1 - first), texts[first:i + 1])
                    first, held = i + 1, 0

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every document measured and judged; see ``measure`` for the columns.

    ``kept`` is false for fewer than 50 words or when over half the words are in repeated 3-word windows, else the
    verdict of the ratio: the mean over the text's n-grams of log p(good) - log p(all), against a fixed threshold.
    Texts shorter than one n-gram and corpora without good labels score 0.  Null texts are empty.  Repeated rows are
    judged alike, each with a row of its own; a null doc_id is never trusted.  Other columns are ignored.
    """
    return measure(docs, log_ratios(docs, labels), threshold)


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``doc_id, text, lang, source, n_chars`` that are kept."""
    ratios = log_ratios(docs, labels)
    columns = docs.columns
    schema = docs.schema
    word = re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            at = columns.index("text")
            texts = [t or "" for t in batch.column(at).to_pylist()]
            first, held = 0, 0
            for i, text in enumerate(texts):
                held += len(text)
                if held > CHUNK_CHARS or i + 1 == len(texts):
                    part = texts[first:i + 1]
                    words = [word.findall(t) for t in part]
                    n = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))
                    score = np.array([ratios[g].mean() if len(g) else 0.0 for g in map(grams, part)])
                    keep[first:i + 1] = (n >= MIN_WORDS) & (repeated_words(words) <= MAX_REPEATED * n) & (score >= threshold)
                    first, held = i + 1, 0
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
