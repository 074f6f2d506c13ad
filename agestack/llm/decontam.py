"""Benchmark decontamination: documents are scanned for word n-grams of the benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import settle, small, text_of

#: What is no letter, no digit and not beyond ASCII stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _plain(words: Column) -> Column:
    """One text of the words, A-Z in lower case.  The words themselves hold no space."""
    return F.translate(F.array_join(words, " "), UPPER, LOWER)


def benchmark_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Distinct ``(item_id, len, h, plain)``: each window, and the hash by which documents find it.

    A shorter item is one window.  The hash is over the hashes of words in Unicode lower case, which cost far less to make
    for every word of the corpus; ``plain``, with A-Z alone in lower case, decides.
    """
    items = benchmark.select("item_id", _words(text_of()).alias("raw")).withColumn("n", F.size("raw")).filter("n > 0")
    items = items.withColumn("len", F.least(F.lit(size), F.col("n")))
    items = items.select("item_id", "len", "raw", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("len") + 1)).alias("pos"))
    window = items.select("item_id", "len", F.slice("raw", F.col("pos"), F.col("len")).alias("w"))
    return window.select(
        "item_id", "len", F.xxhash64(_hashes(F.col("w"))).alias("h"), _plain(F.col("w")).alias("plain"),
    ).distinct()


def find_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``doc_id, __th, pos, len, plain`` of every document window (first word ``pos``, from 1) that is in ``windows``.

    ``__th`` is a hash of the text: with doc_id it names a document, so rows repeating both are one document.
    """
    keys = settle(windows.select("len", "h").distinct(), "bench-keys")
    lengths = [r[0] for r in keys.select("len").distinct().orderBy("len").collect()]  # at most the window size many
    if not lengths:
        lengths = [1]
    text = text_of()
    rows = docs.select("doc_id", F.xxhash64(text).alias("__th"), _words(text).alias("__w"))
    rows = rows.select("*", _hashes(F.col("__w")).alias("__h"))
    found = None
    for length in lengths:
        at = rows.filter(F.size("__w") >= length).select(
            "*", F.explode(F.sequence(F.lit(0), F.size("__w") - length)).alias("pos"))
        key = F.xxhash64(*[F.get(F.col("__h"), F.col("pos") + k) for k in range(length)])
        hit = at.withColumn("h", key).join(small(keys.filter(F.col("len") == length).select("h")), "h").select(
            "doc_id", "__th", (F.col("pos") + 1).alias("pos"), F.lit(length).alias("len"),
            _plain(F.slice("__w", F.col("pos") + 1, F.lit(length))).alias("plain"))
        found = hit if found is None else found.unionByName(hit)
    exact = windows.select("len", "plain").distinct()
    return found.join(exact, ["len", "plain"], "left_semi")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Per document ``doc_id, text_hash, n_words, n_hit, items, spans``: hit words, item ids as sorted texts, hit ranges.

    A window is ``size`` consecutive words of an item, or the whole of a shorter one.  A document word inside any
    occurrence of a window is hit; ``spans`` has the ranges (first word from 0, end exclusive) that these form.

    Null and empty texts have no words.  Items without words match nothing.  Rows that repeat a doc_id with another text
    are judged apart; with the same text they get the same result.  Extra columns are ignored.
    """
    windows = settle(benchmark_windows(benchmark, size), "bench-windows")
    hits = settle(find_hits(docs, windows), "bench-hits")
    key = ["doc_id", "__th"]
    spans = hits.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct(
        (F.col("pos") - 1).alias("first"), (F.col("pos") - 1 + F.col("len")).alias("end")))).alias("each"))
    # ranges in order; one that begins within or right after the last of the list lengthens it
    merged = """aggregate(each, cast(array() as array<struct<first:int,end:int>>), (a, x) ->
        if(size(a) > 0 and x.first <= element_at(a, -1).end,
           concat(slice(a, 1, size(a) - 1),
                  array(named_struct('first', element_at(a, -1).first, 'end', greatest(element_at(a, -1).end, x.end)))),
           concat(a, array(named_struct('first', x.first, 'end', x.end)))))"""
    spans = spans.select(*key, F.expr(merged).alias("spans"))
    items = (
        hits.select(*key, "len", "plain").distinct()
        .join(windows.select("len", "plain", "item_id").distinct(), ["len", "plain"])
        .groupBy(*key).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    items = items.select(F.col("doc_id").alias("__id"), F.col("__th").alias("__h"), "items")
    per_doc = spans.join(items, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__h"))).select(
        "__id", "__h", "spans", "items")
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("__th"), F.size(_words(text_of())).cast("long").alias("n_words"))
    return (
        rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__h")), "left")
        .select(
            "doc_id", F.col("__th").alias("text_hash"), "n_words",
            F.expr("coalesce(aggregate(spans, 0L, (s, x) -> s + x.end - x.first), 0L)").alias("n_hit"),
            F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
            F.coalesce("spans", F.expr("cast(array() as array<struct<first:int,end:int>>)")).alias("spans"),
        )
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents, all columns, in which no benchmark window occurs."""
    windows = settle(benchmark_windows(benchmark, size), "bench-windows")
    bad = settle(find_hits(docs, windows).select(F.col("doc_id").alias("__id"), "__th").distinct(), "bench-docs")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(text_of()) == F.col("__th"))
    return docs.join(small(bad), same, "left_anti")


def cut_spans(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``doc_id, text`` with the hit words taken out; the words that stay are joined by one space where any was hit."""
    hit = contamination(docs, benchmark, size).filter("n_hit > 0").select(
        F.col("doc_id").alias("__id"), "text_hash", "spans").dropDuplicates(["__id", "text_hash"])
    rows = docs.select("doc_id", text_of().alias("__text"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("__text") == F.col("text_hash"))
    keep = F.filter(_words(F.col("__text")), lambda w, i: ~F.exists("spans", lambda s: (s["first"] <= i) & (i < s["end"])))
    return rows.join(hit, same, "left").select(
        "doc_id", F.when(F.col("spans").isNull(), F.col("__text")).otherwise(F.array_join(keep, " ")).alias("text"))
