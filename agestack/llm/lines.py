"""Line dedup: lines whose word sets are alike, found by an exact set-similarity join.

A line's words are put in one order for all lines, rare words first.  Two sets of similarity t or more must share a word
among the first few of each (the prefix), at places that leave room for the overlap they need, and must not differ much
in size.  A 64-bit parity map of each set bounds their difference from below, before any pair leaves the join.  Rarity comes
from word counts by hash bucket, so its table has a fixed size; where it is off the join gets slower, never different,
since any one order serves.

Many versions of one line would pair each with each.  So lines are first paired with one line that shares their rarest
words or extreme hashes; those that look settled by that are joined no further, and return to the join if they fail.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, release, settle, small, text_of

#: Buckets of the word counts by hash; they travel with every task.
RARITY_BITS = 20
#: Bits of a word's key that are its hash; above them stands its rarity, in steps of 1/64 of an octave.
HASH_BITS = 52
#: Rarest words of a line by which it meets one other line before the full join.
HEADS = 2
#: Rounds of such meetings; in each, lines not yet settled meet the earliest of those that share the word.
MEETINGS = 3
#: Index entries (five numbers each) that may go to every task.
INDEX_ROWS = 1_000_000
#: Similarity as a fraction of whole numbers, so that no rounding decides.
NUMER, DENOM = 8, 10


def _words(line: Column) -> Column:
    """The words of a line in lower case: what stands between spaces, tabs and carriage returns."""
    plain = F.replace(F.replace(F.lower(line), F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def _identity(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(text_of()).alias("__th"), text_of().alias("__text"), *more)


def word_rarity(docs: DataFrame) -> DataFrame:
    """One row with one array: the rarity (0 to 2047, rarest first) of the words of each hash bucket."""
    words = docs.select(F.explode(_words(F.replace(text_of(), F.lit("\n"), F.lit(" ")))).alias("w"))
    bucket = F.shiftrightunsigned(F.xxhash64("w"), 64 - RARITY_BITS)
    counts = words.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    every = docs.sparkSession.range(1 << RARITY_BITS).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("n"))
    full = counts.unionByName(every).groupBy("b").agg(F.sum("n").alias("n"))
    rarity = F.least(F.lit(2047), F.floor(F.log2(F.col("n") + 1) * 64)).cast("long")
    packed = F.sort_array(F.collect_list(F.shiftleft("b", 11).bitwiseOR(rarity)))
    return full.agg(F.transform(packed, lambda x: x.bitwiseAND(F.lit(2047))).alias("rarity"))


def line_sets(docs: DataFrame, rarity: DataFrame) -> DataFrame:
    """``doc_id, __th, line, a, b, n, sig, ends, prefix`` for every line with a word.

    ``a`` and ``b`` are hashes of its word set, ``n`` the number of words in it, ``sig`` its parity map (each word flips one of
    64 bits), ``ends`` the hash of its least and greatest word hash, ``prefix`` the keys of the rarest words.  Lines of up to three words have no prefix: no other set is similar
    enough to theirs.
    """
    lines = _identity(docs).select("doc_id", "__th", F.posexplode(F.split("__text", "\n")).alias("line", "content"))
    lines = lines.filter(F.btrim("content", F.lit(" \t\r")) != "")
    key = lambda h: F.shiftleft(
        F.get(F.col("__rarity"), F.shiftrightunsigned(h, 64 - RARITY_BITS).cast("int")), HASH_BITS
    ).bitwiseOR(h.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))
    hashes = F.array_distinct(F.transform(_words(F.col("content")), lambda w: F.xxhash64(w)))
    # the table joins in the very projection that uses it, once, so that no row carries it
    keyed = lines.withColumn("__rarity", rarity.scalar()).select(
        "doc_id", "__th", "line", F.sort_array(F.transform(hashes, key)).alias("keys"))
    n = F.size("keys")
    prefix = F.when(n > 3, F.slice("keys", 1, n - F.ceil(n * NUMER / DENOM).cast("int") + 1)).otherwise(
        F.expr("cast(array() as array<bigint>)"))
    sig = F.expr("aggregate(keys, 0L, (s, k) -> s ^ shiftleft(1L, cast(k & 63 as int)))")
    low = F.transform("keys", lambda k: k.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))
    ends = F.when(n > 3, F.xxhash64(F.array_min(low), F.array_max(low)))
    return keyed.select("doc_id", "__th", "line", F.xxhash64("keys").alias("a"), F.hash("keys").alias("b"), n.alias("n"), sig.alias("sig"),
                        ends.alias("ends"), prefix.alias("prefix"))


def line_classes(sets: DataFrame) -> DataFrame:
    """Lines of one word set: ``id, n, sig, ends, prefix`` and ``at``, the first such line.

    Written before use, the ids are fixed; they are small next to hashes, and there is one for each entry of the index.
    """
    each = sets.select("a", "b", F.struct(F.struct("doc_id", "__th", "line").alias("at"), "n", "sig", "ends", "prefix").alias("x"))
    firsts = each.groupBy("a", "b").agg(F.min("x").alias("x"))
    return firsts.select(F.monotonically_increasing_id().alias("id"), "x.at", "x.n", "x.sig", "x.ends", "x.prefix")


def _difference(x: str, y: str) -> Column:
    """At least so many words are in one of the sets only: each flips one bit."""
    return F.bit_count(F.col(f"{x}.sig").bitwiseXOR(F.col(f"{y}.sig")))


def _size(side: str) -> Column:
    return F.col(f"{side}.n")


def _possible(x: str, y: str, size=_size) -> Column:
    """Sizes and parity maps allow the similarity: the difference is at most (1 - t) / (1 + t) of the sum of sizes."""
    n, m = size(x), size(y)
    return (F.greatest(n, m) * NUMER <= F.least(n, m) * DENOM) & (
        _difference(x, y) * (NUMER + DENOM) <= (n + m) * (DENOM - NUMER))


def _clear(x: str, y: str, size=_size) -> Column:
    """The difference that the parity maps let expect is in bounds (d flips leave 32 (1 - exp(-d / 32)) of 64 bits set)."""
    flips = -32 * F.log(F.greatest(1 - _difference(x, y) / 32, F.lit(1e-9)))
    return flips * (NUMER + DENOM) <= (size(x) + size(y)) * (DENOM - NUMER)


def settled_by_one(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``x, y`` of the earliest line of a head word, or of a pair of extreme hashes, with others of it, and the ``id`` of lines they seem to settle.

    """
    keys = F.concat(F.slice("prefix", 1, HEADS), F.array("ends"))
    heads = classes.filter("n > 3").select("id", F.explode(keys).alias("key"))
    shared = heads.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("key")
    rows = settle(heads.join(shared, "key").join(classes.select("id", "at", "n", "sig"), "id"), "line-heads")
    pairs, done, written = [], [], [rows]
    for _ in range(MEETINGS):
        centres = rows.groupBy("key").agg(F.min(F.struct("at", "id", "n", "sig")).alias("c"), F.count(F.lit(1)).alias("k"))
        met = rows.alias("y").join(centres.filter("k > 1").select("key", "c.*").alias("x"), "key").filter("x.id <> y.id")
        met = settle(met.select("key", F.col("x.id").alias("x"), *[F.col(f"y.{c}").alias(c) for c in ("id", "at", "n", "sig")],
                                _possible("x", "y").alias("possible"), (_possible("x", "y") & _clear("x", "y")).alias("clear")), "line-met")
        pairs.append(met.filter("possible").select("x", F.col("id").alias("y")))
        done.append(met.filter("clear").select("id"))
        written.append(met)
        rows = met.select("key", "id", "at", "n", "sig").join(small(done[-1].distinct()), "id", "left_anti")
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts).distinct()
    found = settle(union(pairs), "line-ones"), settle(union(done), "line-likely")
    discard(*written)
    return found


def shared_index(classes: DataFrame) -> DataFrame:
    """One row per line and word of its prefix, of words that another line's prefix has too; most have none.

    One shuffle by word counts the lines of each; the rows that stay are written, and serve every later join.
    """
    rows = classes.filter("n > 3").select("id", F.col("at.doc_id").alias("d"), "sig", "n", F.posexplode("prefix").alias("p", "key"))
    rows = rows.select("key", "id", "d", "sig", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("p")).alias("np"))
    return rows.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("k > 1").drop("k")


def marked(index: DataFrame, **flags: DataFrame) -> DataFrame:
    """The index with columns that are true for the ids of ``flags``."""
    for name, ids in flags.items():
        index = index.join(small(ids.select("id", F.lit(True).alias(name))), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return index


def candidates(later: DataFrame, earlier: DataFrame, wanted: Column) -> DataFrame:
    """Pairs ``x`` of the index ``earlier`` and ``y`` of ``later`` that pass the prefix, place, length and parity filters and
    are ``wanted`` (of ``l`` and ``r``), x in no later document than y; ``clear`` as in ``settled_by_one``."""
    left, right = later.alias("l"), earlier.alias("r")
    n = lambda side: F.shiftright(F.col(f"{side}.np"), 32)
    rest = lambda side: n(side) - F.col(f"{side}.np").bitwiseAND(F.lit(0xFFFFFFFF))
    # overlap >= t / (1 + t) * (sum of sizes); from the first common word on at most the shorter rest is common
    room = F.least(rest("l"), rest("r")) * (NUMER + DENOM) >= (n("l") + n("r")) * NUMER
    before = F.coalesce(F.col("r.d") <= F.col("l.d"), F.col("r.d").isNull()) & (F.col("l.id") != F.col("r.id"))
    pairs = left.join(right, (F.col("l.key") == F.col("r.key")) & wanted & before & room & _possible("l", "r", n))
    return pairs.select(F.col("r.id").alias("x"), F.col("l.id").alias("y"), _clear("l", "r", n).alias("clear")).distinct()


def wanted_lines(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``id, at, n, marks, words`` of the lines in ``pairs``: the words of the set with one space between, their number, and
    their hashes to 16 bits without repeats.

    Texts stay where they are unless the lines are too many for every task; only lines that are asked for go further.
    """
    ids = settle(pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct(), "line-ids")
    places = settle(classes.select("id", "at").join(small(ids), "id", "left_semi").select(
        "id", F.col("at.doc_id").alias("__id"), F.col("at.__th").alias("__h"), F.col("at.line").alias("__line")), "line-wanted")
    rows = _identity(docs).select("doc_id", "__th", F.posexplode(F.split("__text", "\n")).alias("line", "content"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__h")) & (F.col("line") == F.col("__line"))
    rows = rows.join(small(places), same).select("id", F.struct("doc_id", "__th", "line").alias("at"), "content")
    sets = rows.dropDuplicates(["id"]).select("id", "at", F.array_distinct(_words(F.col("content"))).alias("words"))
    marks = F.array_distinct(F.transform("words", lambda w: (F.pmod(F.xxhash64(w), F.lit(1 << 16)) - (1 << 15)).cast("short")))
    return settle(sets.select("id", "at", F.size("words").alias("n"), marks.alias("marks"), F.array_join("words", " ").alias("words")), "line-words")


def similar_lines(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``id`` of the later lines of the settled ``pairs`` whose whole word sets have the similarity asked for.

    Marks, two bytes a word, go first: a mark in one of two sets only is of a word in that set only, so they bound the
    difference from below.  Words go to the pairs that pass.
    """
    sets = wanted_lines(docs, pairs, classes)
    side = lambda end, *columns: sets.select(F.col("id").alias(end), F.struct(*columns).alias(f"{end}_of"))
    join = lambda few, *columns: few.join(side("x", *columns), "x").join(side("y", *columns), "y")
    n = F.col("x_of.n") + F.col("y_of.n")
    shared = F.size(F.array_intersect("x_of.marks", "y_of.marks"))
    apart = F.size("x_of.marks") + F.size("y_of.marks") - 2 * shared
    near = settle(join(pairs, "n", "marks").filter(apart * (NUMER + DENOM) <= n * (DENOM - NUMER)).select("x", "y"), "line-near")
    sets = sets.join(small(settle(near.select(F.col("x").alias("id")).unionByName(near.select(F.col("y").alias("id"))).distinct(), "line-ids")),
                     "id", "left_semi")
    common = F.size(F.array_intersect(F.split("x_of.words", " "), F.split("y_of.words", " ")))
    alike = join(near, "at", "id", "n", "words").filter(common * DENOM >= (n - common) * NUMER)
    place = lambda end: F.struct(F.col(f"{end}_of.at").alias("at"), F.col(f"{end}_of.id").alias("id"))
    return alike.select(F.greatest(place("x"), place("y"))["id"].alias("id")).distinct()


def first_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, __th, lines``: the numbers (from 0) of the lines with words that stay, for documents that have any.

    A line goes if an earlier line (smaller doc_id, then text hash, then line number) has a word set of similarity 0.8
    or more, whether or not that one goes too.
    """
    rarity = settle(word_rarity(docs), "line-rarity")
    classes = settle(line_classes(line_sets(docs, rarity)), "line-classes")
    release(docs.sparkSession)
    shared = settle(shared_index(classes), "line-index")
    discard(rarity)
    release(docs.sparkSession)
    ones, likely = settled_by_one(classes)
    # lines that no meeting settled: among themselves, then those still open with the settled ones
    index = marked(shared, settled=likely)
    first = settle(candidates(index, index, ~F.col("l.settled") & ~F.col("r.settled")), "line-open")
    seems = settle(likely.unionByName(first.filter("clear").select(F.col("y").alias("id"))).distinct(), "line-likely")
    index = marked(shared, settled=likely, seems=seems)
    second = candidates(index.filter("not seems"), small(index.filter("settled"), INDEX_ROWS), F.lit(True))
    pairs = settle(ones.unionByName(first.select("x", "y")).unionByName(second.select("x", "y")).distinct(), "line-both")
    discard(ones, first, likely)
    release(docs.sparkSession)
    gone = settle(similar_lines(docs, pairs, classes), "line-gone")
    discard(pairs)
    failed = settle(seems.join(small(gone), "id", "left_anti"), "line-failed")
    if failed.limit(1).count():
        index = marked(shared, failed=failed)
        again = settle(candidates(small(index.filter("failed"), INDEX_ROWS), index, F.lit(True)).select("x", "y"), "line-both")
        gone = settle(gone.unionByName(similar_lines(docs, again, classes)).distinct(), "line-gone")
    discard(shared)
    stays = classes.select("id", "at").join(gone, "id", "left_anti")
    return stays.select("at.*").groupBy("doc_id", "__th").agg(F.collect_set("line").alias("lines"))


def _judged(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Lists of lines that stay, the condition that joins them to ``docs``, and each line's verdict in a lambda."""
    stay = first_lines(docs).select(F.col("doc_id").alias("__id"), F.col("__th").alias("__h"), F.col("lines").alias("__stay"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(text_of()) == F.col("__h"))
    gone = lambda x, i: (F.btrim(x, F.lit(" \t\r")) != "") & ~F.coalesce(F.array_contains("__stay", i), F.lit(False))
    return stay, same, gone


def line_report(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id, n_lines, n_removed, removed`` (line numbers from 0).

    Lines are the pieces between newlines; words are split at spaces, tabs and carriage returns and compared in lower
    case.  Lines without words are like no other and stay.  Null texts are one empty line.  Rows that repeat doc_id and
    text are one document and get the same result.  No rows give no rows.  Other columns are ignored.
    """
    stay, _, _ = _judged(docs)
    # texts stay where they are: only the numbers of the lines with words go to the join
    with_words = F.filter(F.transform(F.split("__text", "\n"), lambda x, i: F.when(F.btrim(x, F.lit(" \t\r")) != "", i)), lambda i: i.isNotNull())
    rows = _identity(docs).select("doc_id", "__th", F.size(F.split("__text", "\n")).cast("long").alias("n_lines"), with_words.alias("__all"))
    joined = rows.join(stay, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__h")), "left")
    removed = F.when(F.col("__stay").isNull(), F.col("__all")).otherwise(F.array_except("__all", "__stay"))
    return joined.select("doc_id", "n_lines", removed.alias("removed")).select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with ``text`` less its repeated lines.  Texts that lose none stay as they are."""
    stay, same, gone = _judged(docs)
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~gone(x, i)), "\n")
    return docs.join(stay, same, "left").withColumn("text", kept).select(*docs.columns)
