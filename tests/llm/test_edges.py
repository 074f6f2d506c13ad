"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import random
import re
from collections import Counter

import pytest

from agestack.llm import chat, decontam, hashing, html, lines, lm, minhash, mixing, quality, substrings, urls

LONG = " ".join(f"w{i}" for i in range(60_000))
PASSAGE = " ".join(f"p{i}" for i in range(30))


def odd(docs):
    """Null ids and texts, white space alone, one word, a very long text, a repeated row, equal texts."""
    return docs([
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, LONG, None), (6, f"x {PASSAGE} y"), (6, f"x {PASSAGE} y"),
        (7, f"a b {PASSAGE}"), (None, f"{PASSAGE} z"), (None, None, None), (8, "one"),
    ])


def bench(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, doc_id string")


def labels(spark, rows):
    return spark.createDataFrame([(d, q, 0, "t") for d, q in rows], "doc_id long, quality int, toxic int, text string")


def test_lm(docs):
    rows = lm.score(odd(docs)).collect()
    assert len(rows) == 11
    by = {r.doc_id: r for r in rows if r.doc_id not in (None, 6)}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 1 and by[5].n_tokens == 60_001
    assert all(r.score <= 0 and r.base_score < 0 for r in rows)
    assert lm.score(docs([])).collect() == []


def test_lm_without_training(docs):
    from pyspark.sql import functions as F

    rows = lm.score(docs([(1, "a b")]), train=F.lit(False)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in rows] == [(3, 0, 0, 0.0)]


PAGES = {
    "<html><body><div id=menu><a href=x>Home</a></div><div class=content><h2>T</h2><p>" + "long " * 60 + "</p><p>short.</p></div>"
    "<div class=comments><p>" + "nice " * 50 + "</p></div><div><p>All rights</p></div></body>": "T\n" + "long " * 59 + "long\nshort.",
    "<main><header><h1>Title</h1></header><p>a&nbsp;b  c &lt;x&gt; &amp;amp;</p><aside>no</aside><form>f<input></form><p>d<b>e</b>f<br>g"
    "</main><footer>z</footer>": "Title\na b c <x> &amp;\ndef g",
    "<p>just text": "just text", "": "", "<nav>only</nav>": "", "<script>var a='<p>x</p>'": "", "plain & text < 3": "plain & text < 3",
    "<article><p>x<article class=comment><p>c</p></article><p>y</article>": "x\ny",
    "<nav><ul><li>m<article><p>body</article>": "body",
    "<article><p>" + "w " * 50_000 + "</article>": "w " * 49_999 + "w",
}


def test_html(spark):
    rows = [(i, f"u{i}", page, "e") for i, page in enumerate(PAGES)] + [(None, None, None, None), (0, "u0", next(iter(PAGES)), "e")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == ("" if r.page_id is None else list(PAGES.values())[r.page_id]) and r.n_chars == len(r.text)
    assert html.extract(frame.limit(0)).collect() == []


@pytest.mark.parametrize("named", ["site has-sidebar", "layout no-sidebar", "page with-header", "search-page"])
def test_html_names_are_whole_words(named):
    assert html.main_text(f"<body><div class='{named}'><article><h1>T</h1><p>body</p></article></div>") == "T\nbody"
    assert html.main_text(f"<body><div id='{named.split()[-1]}'><h1>T</h1><p>body</p></div>") == "T\nbody"


def test_html_article_ends_what_began_outside():
    ad = "<div class=ad>buy"
    assert html.main_text(f"<body>{ad}<article><p>body</p></article>") == "body"
    assert html.main_text(f"<body>{ad}<main>{ad}<article><p>body</p></article></main>") == "body"
    assert html.main_text(f"<body>{ad}<article><p>one</p></article>{ad}<article><p>two</p></article>") == "one\ntwo"
    assert html.main_text("<body><div class='page sidebar'><main><p>body</p></main></div>") == "body"
    comments = "<div class=comments><article><p>nice</p></article></div>"
    assert html.main_text(f"<main><p>body</p>{comments}<p>end</p></main>{comments}") == "body\nend"


def test_html_ids_within_an_article_are_places():
    page = ("<article><h1 id=header>T</h1><section id=related-work><p>a</p></section><section id=search><h2 id=search>S</h2><p id=share>b</p>"
            "</section><div id=comments><p>nice</p></div><section class=related><p>more</p></section></article>")
    assert html.main_text(page) == "T\na\nS\nb"


def test_html_short_lines_of_a_page_without_article():
    long, items = "w" * 300, ["i" * 14, "j" * 14]
    page = f"<h1>{'t' * 20}</h1><p>{long}</p><ul><li>{items[0]}</li><li>{items[1]}</li></ul><p>{long}</p>"
    assert html.main_text(f"<body>{page}<div>All rights</div></body>").split("\n") == ["t" * 20, long, *items, long]
    assert html.main_text(f"<p>{long}</p><ul><li><a href=x>see</a></li></ul><p>{long}</p><ul><li><a href=y>home</a></ul>") == f"{long}\nsee\n{long}"


def test_html_comments_in_all_their_places():
    body = "<p>body</p>"
    for part in ("<section id=comments><p>nice</p></section>", "<div class=user-comments><p>nice</p></div>", "<div id=post_comments>nice</div>",
                 "<div class='comments-wrapper x'><p>nice</p></div>", "<ol class=comment-list><li>nice</ol>", "<article class=comment><p>nice</p></article>",
                 "<div itemscope itemtype='https://schema.org/Comment'><p>nice</p></div>", "<div class=reader-replies><p>nice</p></div>"):
        assert html.main_text(f"<article>{body}{part}<p>end</p></article>") == "body\nend", part
        assert html.main_text(f"<article>{body}</article>{part}") == "body", part
    assert html.main_text(f"<article class=has-comments>{body}<div class=no-comments><p>more</p></div></article>") == "body\nmore"
    assert html.main_text(f"<article>{body}<h2 id=comments>T</h2><section id=comments-on-law><p>law</p></section></article>").startswith("body\nT")


def test_html_declarations():
    body = "<article><p>body</p></article>"
    for odd in ("<![foo[bar]]>", "<![if !IE]>", "<![endif]>", "<!DOCTYPE html [<!ENTITY x \"y\">]>", "<!doctype html>", "<![CDATA[x]]>", "<!-- a -->", "<!x>",
                "<?php echo 1 ?>"):
        assert html.main_text(odd + body) == "body", odd
    for cut in ("<![", "<![CDATA[", "<!DOCTYPE [", "<!", "<", "</", "<a href='", "&#", "&#x", "&#99999999999;"):
        html.main_text(body + cut)


@pytest.mark.parametrize("seed", range(20))
def test_html_never_raises(seed):
    rng = random.Random(seed)
    bits = ["<![", "]]>", "<!", "<!--", "-->", "<!DOCTYPE", "[", "]", ">", "<", "</", "<div", " class=ad", " id='c", "'", "\"", "&#", "&amp", ";", "<script>", "</script",
            "<article>", "</article>", "<main>", "</main>", "<span>", "</span>", "<textarea>", "<svg>", "<plaintext>", "<?", "/>", "text", "\x00", "\ud7ff", "<a", "=",
            "<div class=comments>", "</div>", "<nav>", "CDATA[", "<p>"]
    for _ in range(400):
        html.main_text("".join(rng.choices(bits, k=rng.randint(1, 40))))


@pytest.mark.parametrize("page", [
    "<div>" * 40_000 + "</span>" * 40_000, "<span><article>" + "<div>" * 40_000 + "</span>" * 40_000, "<article>" * 40_000,
    "<button>" * 20_000 + "<div class=ad><main>" * 20_000, "<div class=comments>" * 20_000 + "<article>" * 20_000, "<a>" * 60_000 + "</p>" * 60_000,
    "<p>" + "x<b>" * 60_000])
def test_html_takes_time_in_proportion(page):
    import time

    start = time.process_time()
    html.main_text(page)
    assert time.process_time() - start < 6


@pytest.mark.parametrize("seed", range(60))
def test_html_without_article_against_the_blocks_written(seed):
    """Short and long blocks of all kinds between two long paragraphs, with a menu before and a footer after."""
    rng, want = random.Random(seed), []

    def text(low, high):
        want.append(" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(rng.randint(low, high))))
        return want[-1]

    def block(depth):
        kind = rng.choice(["p", "p", "div", "ul", "table", "blockquote", "pre", "h3", "dl", "short", "section"][:11 if depth else 10])
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{text(1, 3)}</li>" for _ in range(rng.randint(1, 6))) + "</ul>"
        if kind == "dl":
            return f"<dl><dt>{text(1, 2)}<dd>{text(1, 4)}</dl>"
        if kind == "table":
            return "<table>" + "".join(f"<tr><td>{text(1, 2)}</td><td><p>{text(1, 2)}</p></td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        if kind == "section":
            return "<section>" + "".join(block(depth - 1) for _ in range(rng.randint(1, 3))) + "</section>"
        if kind == "blockquote":
            return f"<blockquote><p>{text(1, 5)}</p></blockquote>"
        if kind in ("short", "h3"):
            return f"<{'div' if kind == 'short' else kind}>{text(1, 3)}</{'div' if kind == 'short' else kind}>"
        return f"<{kind}>{text(30, 60)}</{kind}>"

    tag = rng.choice(["body", "div", "section", "td"])
    inner = f"<h1>{text(2, 4)}</h1><p>{text(50, 60)}</p>" + "".join(block(2) for _ in range(rng.randint(1, 8))) + f"<p>{text(50, 60)}</p><p>{text(1, 2)}</p>"
    inner = {"body": inner, "td": f"<table><tr><td>{inner}</td></tr></table>"}.get(tag, f"<{tag}>{inner}</{tag}>")
    page = f"<body><ul><li><a href=x>Home</a></li></ul><div><p>Menu</p></div>{inner}<div><p>All rights</p></div><div>End</div></body>"
    assert html.main_text(page).split("\n") == want


def test_substrings(docs):
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.text[:9]) for r in substrings.dedup_substrings(odd(docs)).collect())
    assert got == [
        (0, 0, 0, ""), (0, 31, 0, "p0 p1 p2 "), (1, 0, 0, ""), (2, 0, 0, ""), (3, 0, 0, ""), (4, 1, 0, "one"), (5, 60_000, 0, "w0 w1 w2 "),
        (6, 32, 30, "x y"), (6, 32, 30, "x y"), (7, 32, 30, "a b"), (8, 1, 0, "one")]
    assert substrings.dedup_substrings(docs([])).collect() == []


def test_substrings_in_a_run(docs):
    """A run of one word repeats itself from its second window on."""
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.dedup_substrings(
        docs([(1, "go " * 5000), (2, "x " + "go " * 25 + "y"), (3, "go " * 19)])).collect()}
    assert got == {1: (5000, 4999), 2: (27, 25), 3: (19, 0)}


def test_substrings_longer_than_a_batch_of_copies(docs):
    text = " ".join(f"c{i}" for i in range(200))
    got = substrings.dedup_substrings(docs([(i, text) for i in range(300)])).collect()
    assert sorted(r.n_removed for r in got) == [0] + [200] * 299


@pytest.mark.parametrize("shared", [None, 7])
def test_substrings_of_rows_that_share_an_id(docs, shared):
    """Texts of different lengths under one id, or none, against plain Python in the same order of rows."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    passages = [" ".join(f"q{k}w{i}" for i in range(25 + 10 * k)) for k in range(4)]
    some = [" ".join(f"{n}u{i}" for i in range(rng.randint(0, 40))) + " " + " ".join(rng.sample(passages, rng.randint(1, 3))) for n in range(12)]
    rows = [(shared if n % 3 else n, t) for n, t in enumerate(some)] + [(shared, some[1]), (3, passages[0] + " end"), (9, passages[2])]
    frame = docs(rows)
    order = frame.distinct().select("doc_id", "text").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()
    seen, want = set(), {}
    for d, text in order:
        words = text.split()
        keep = [True] * len(words)
        for i in range(len(words) - 19):
            if (window := tuple(words[i:i + 20])) in seen:
                keep[i:i + 20] = [False] * 20
            seen.add(window)
        want[d, " ".join(w for w, k in zip(words, keep) if k), len(words)] = sum(r == (d, text) for r in rows)
    got = Counter((r.doc_id, r.text, r.n_words) for r in substrings.dedup_substrings(frame.repartition(1)).collect())
    assert got == Counter(want)


def test_lines(docs):
    a = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(1, f"{a}\n\n \nshort"), (2, f"x\n{a} now\nshort\n\n"), (2, f"x\n{a} now\nshort\n\n"), (3, None), (4, ""), (5, LONG), (None, a.upper())]
    got = sorted((r.doc_id or 0, r.n_lines, r.n_removed, tuple(r.removed)) for r in lines.line_report(docs(rows)).collect())
    assert got == [(0, 1, 0, ()), (1, 4, 1, (0,)), (2, 5, 2, (1, 2)), (2, 5, 2, (1, 2)), (3, 1, 0, ()), (4, 1, 0, ()), (5, 1, 0, ())]
    clean = lines.dedup_lines(docs(rows))
    assert clean.columns == docs(rows).columns
    assert sorted((r.doc_id or 0, r.text) for r in clean.collect() if r.doc_id != 5 and r.text is not None) == [
        (0, a.upper()), (1, "\n \nshort"), (2, "x\n\n"), (2, "x\n\n"), (4, "")]
    assert lines.line_report(docs([])).collect() == []


def test_very_long_lines(docs):
    words = LONG.split()
    rows = [(1, LONG), (2, " ".join(words[:-5000])), (3, " ".join(words[:40_000])), (4, " ".join(reversed(words)))]
    got = {r.doc_id: r.n_removed for r in lines.line_report(docs(rows)).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1}


@pytest.mark.parametrize("n", [3, 4, 5, 9, 10, 44, 45])
def test_lines_at_the_threshold(docs, n):
    """Sets of n words and of one more, or with one exchanged, at similarities about 0.8."""
    base = [f"b{i}" for i in range(n)]
    sets = [base, base + ["e0"]] + [base[:-k] + [f"x{k}{j}" for j in range(k)] for k in range(1, n)]
    got = {r.doc_id: r.n_removed for r in lines.line_report(docs([(i, " ".join(s)) for i, s in enumerate(sets)])).collect()}
    for i, s in enumerate(sets):
        near = any(10 * len({*s} & {*t}) >= 8 * len({*s} | {*t}) for t in sets[:i])
        assert got[i] == near, (n, i)


def test_words_go_to_pairs_that_marks_allow(docs, monkeypatch):
    """Long lines with a third of their words in common: the parity maps let them pass as pairs, the marks do not."""
    steps = {}
    keep = lines.settle
    monkeypatch.setattr(lines, "settle", lambda df, label, *more: steps.setdefault(label, keep(df, label, *more)))
    shared = [f"a{j}" for j in range(150)]
    sets = [[*shared, *(f"b{i}_{j}" for j in range(300))] for i in range(40)]
    sets += [s[:-20] for s in sets[:5]]
    rows = [(i if i else None, " ".join(s)) for i, s in enumerate(sets)]
    base = docs(rows + rows[3:6])
    classes = keep(lines.line_classes(lines.line_sets(base, keep(lines.word_rarity(base)))), "classes")
    ids = {r.at.doc_id or 0: r.id for r in classes.collect()}
    spark = base.sparkSession
    every = keep(spark.createDataFrame([(ids[i], ids[j]) for i in ids for j in ids if i < j], "x long, y long"), "pairs")
    gone = {r.id for r in lines.similar_lines(base, every, classes).collect()}
    assert gone == {ids[i] for i in range(40, 45)}
    assert {(r.x, r.y) for r in steps["line-near"].collect()} == {(ids[i], ids[40 + i]) for i in range(5)}
    words = steps["line-words"]
    assert words.count() == 45 and dict(words.dtypes)["marks"] == "array<smallint>"


def test_near_duplicates(docs):
    rows = minhash.near_duplicates(odd(docs), 5).collect()
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in rows)
    assert got == [(0, 0, 0, True), (0, 27, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 59_996, 5, True),
                   (6, 28, 6, True), (6, 28, 6, True), (7, 28, 6, False), (8, 1, 4, False)]
    assert minhash.first_of_each(odd(docs)).columns == odd(docs).columns
    assert sorted(r.doc_id or 0 for r in minhash.first_of_each(odd(docs)).collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 6]
    assert minhash.near_duplicates(docs([]), 5).collect() == []


def test_chain_of_near_duplicates(docs):
    """Each text is like the next one only; the chain is one group, named after its smallest id."""
    words = [f"v{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[10 * k:10 * k + 120])) for k in range(12)]
    got = minhash.near_duplicates(docs(rows), 4).collect()
    assert {r.component_id for r in got} == {89} and sum(r.kept for r in got) == 1


def test_bayes_bounds():
    bounds = minhash.least_matches(0.8, 1e-7)
    assert list(bounds) == list(range(16, 97, 16)) and all(bounds[n] < 0.8 * n for n in bounds)


def test_quality(spark, docs):
    good = [(i, " ".join(f"word{(i * 7 + j * 3) % 97}" for j in range(60))) for i in range(10, 40)]
    junk = [(i, " ".join(f"a{j}%%% $$$#{(i * j) % 89}&&" for j in range(60))) for i in range(40, 50)]
    frame = odd(docs).unionByName(docs(good + junk))
    known = labels(spark, [(i, 1) for i in range(10, 38)] + [(i, 0) for i in range(40, 45)] + [(None, 1), (10, 1)])
    got = {r.doc_id: r for r in quality.quality(frame, known).collect()}
    assert all(got[i].kept for i, _ in good) and not any(got[i].kept for i, _ in junk)
    assert got[1].n_words == 0 and got[1].base_failed and got[5].n_words == 60_000 and not got[5].base_failed
    assert quality.quality(docs([]), known).collect() == []
    without = {r.doc_id: r for r in quality.quality(frame, known.limit(0)).collect()}
    assert all(r.log_ratio == 0 and r.kept != r.base_failed for r in without.values())
    kept = quality.good_documents(frame, known)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.kept}


def test_repeated_words():
    texts = ["a b c a b c", "a b c d", "", "x x x x", "a b c a b"]
    assert quality.repeated_words([t.split() for t in texts]).tolist() == [6, 0, 0, 4, 0]


def test_decontamination(spark, docs):
    frame = odd(docs)
    items = bench(spark, [(1, " ".join(f"P{i}" for i in range(5, 25))), (2, "ONE"), (3, None), (4, "..."), (2, "ONE"), (11, PASSAGE), (None, "w5 W6")])
    got = decontam.contamination(frame, items).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == [
        (0, 0, 0, ()), (0, 31, 30, ("1", "11")), (1, 0, 0, ()), (2, 0, 0, ()), (3, 0, 0, ()), (4, 1, 1, ("2",)), (5, 60_000, 2, ()),
        (6, 32, 30, ("1", "11")), (6, 32, 30, ("1", "11")), (7, 32, 30, ("1", "11")), (8, 1, 1, ("2",))]
    clean = decontam.clean_documents(frame, items)
    assert clean.columns == frame.columns and sorted(r.doc_id or 0 for r in clean.collect()) == [0, 1, 2, 3]
    cut = {r.doc_id: r.text for r in decontam.cut_spans(frame, items).collect()}
    assert cut[6] == "x y" and cut[7] == "a b" and cut[4] == "" and cut[1] == "" and len(cut[5].split()) == 59_998
    assert all(r.n_hit == 0 for r in decontam.contamination(frame, items.limit(0)).collect())
    assert decontam.contamination(docs([]), items).collect() == []


def test_lower_case_of_ascii_alone(spark, docs):
    """Equal under Unicode lower case is not enough."""
    got = decontam.contamination(docs([(1, "ÉTÉ x"), (2, "été X"), (3, "a été-x b")]), bench(spark, [(1, "été x")])).collect()
    assert {r.doc_id: r.n_hit for r in got} == {1: 0, 2: 2, 3: 2}


def test_mix(docs):
    frame = odd(docs).unionByName(docs([(i, "a b c", f"s{i % 4}") for i in range(20, 60)]))
    got = mixing.mix(frame, shards=8, block_words=16).collect()
    assert len(got) == frame.count()
    again = mixing.mix(frame.repartition(3), shards=8, block_words=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        assert r.taken == sum(p["last"] - p["first"] for p in r.pieces) <= 2 * r["size"]
        assert all(0 <= p["shard"] < 8 and 0 <= p["first"] < p["last"] <= r["size"] for p in r.pieces)
        by.setdefault((r.source, r.target), []).append(r.taken)
    assert all(abs(sum(t) - target) <= 0.5 for (_, target), t in by.items())
    assert sum(target for _, target in by) == pytest.approx(1.5 * total)
    blocks = {}
    for r in got:
        for p in r.pieces:
            assert blocks.setdefault((r.source, p["block"]), p["shard"]) == p["shard"]  # a block lies in one shard
    counts = [sum(s == k for s in blocks.values()) for k in range(8)]
    assert max(counts) - min(counts) <= 3
    assert mixing.mix(docs([])).collect() == []
    texts = mixing.shard_rows(frame, shards=8, block_words=16).collect()
    assert sum(len(r.text.split()) for r in texts) == sum(r.taken for r in got)


def test_mix_of_more_sources_than_the_tree_holds(docs, monkeypatch):
    rows = [(i, "a b c d e " * (i % 7), f"s{i % 40}") for i in range(400)] + [(i, "x " * 90, "big") for i in range(400, 600)] + [
        (600, None, None), (601, "n m", None), (602, "", "empty")]
    frame = docs(rows)
    tree = mixing.mix(frame, shards=16, block_words=16).collect()
    monkeypatch.setattr(mixing, "TREE_NUMBERS", 100)
    got = mixing.mix(frame, shards=16, block_words=16)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())
    got = got.collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame.repartition(3), shards=16, block_words=16).collect()))

    def but_shards(rows):
        return sorted(str((r.doc_id, r.source, r["size"], r.target, r.taken, [(p["block"], p["first"], p["last"], p["place"]) for p in r.pieces])) for r in rows)

    def blocks(rows):
        found = {}
        for r in rows:
            for p in r.pieces:
                assert found.setdefault((r.source, p["block"]), p["shard"]) == p["shard"]  # a block lies in one shard
        return found

    assert but_shards(got) == but_shards(tree)
    mine = blocks(got)
    assert Counter(mine.values()) == Counter(blocks(tree).values())
    assert all(mine[s, b] <= mine.get((s, b + 1), 99) for s, b in mine)  # shards own runs of a source's blocks
    big = Counter(k for (s, _), k in mine.items() if s == "big")
    assert len(big) == 16 and max(big.values()) < 2 * min(big.values())
    assert len(mixing.mix(frame, shards=1, block_words=16).filter("taken > 0").collect()) == sum(r.taken > 0 for r in tree)


def test_mix_of_a_source_per_document(spark):
    n = mixing.TREE_NUMBERS // 64 + 500
    frame = spark.range(n).selectExpr("id AS doc_id", "'a b c d' AS text", "concat('site', id) AS source")
    row = mixing.mix(frame).selectExpr("count(*) AS n", "sum(taken) AS taken", "sum(target) AS target", "count(DISTINCT pieces[0].shard) AS shards").first()
    assert row.n == n and abs(row.taken - row.target) < n / 2 and row.taken > n and row.shards == 64


def test_splitting_tree():
    tree = mixing.splitting_tree([1000, 10, 0, 500], 16, 3)
    assert tree.shape == (4, 16) and (tree == mixing.splitting_tree([1000, 10, 0, 500], 16, 3)).all()
    assert 400 < tree[0, 1] < 600 and tree[:, 1].sum() == 755 and tree[2].max() == 0


URLS = ["https://A.Example.COM/en/x?q#f", "http://example.com/en/", "ftp://www.example.com/en/a/b", "x.net/es/", "http://a.net/es/q",
        "http://net/fr/", "https://evil.org/x.example.com/en/", "http://spam-farm.example.org/a", "http://example.com", "", None,
        "http://h.org/a/b.ZIP", "http://h.org/a/b.zip", "http://h.org/" + "y" * 5000 + ".zip", "http://é.com/ü\n", "http://com:80/", "://"]
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def test_urls(spark):
    frame = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS)] + [(None, None, "h", "p")], "page_id long, url string, host string, rule string")
    rules = [*(urls.prefix_rule(*r) for r in RULES), *urls.DEFAULT_GLOBS]
    got = urls.judge_urls(frame, rules).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        url = (URLS[r.page_id] if r.page_id is not None else None) or ""
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
        host, path = (m[1], m[2]) if m else ("", "")
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(rule, v) for rule, v in RULES for h, _, p in [rule.partition("/")]
                if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        blocked = (re.search(r"(^|\.)(spam-|casino)", host) and path.startswith("/")) or re.search(r"(?s)^/.*\.(css|exe|gif|gz|jpg|js|mp4|png|zip)$", path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or ("block" if blocked else "allow")), url
    assert urls.judge_urls(frame.limit(0), rules).collect() == []


def test_automaton_against_regular_expressions():
    globs = ["*.a*b/**", "**x?z", "?.c/**/d", "**" + "long" * 30 + "*", ".h/exact", "*", "**", "*.é/**"]
    regexes = [re.compile("(?s)" + re.sub(r"\\\*\\\*|\\\*|\\\?", lambda m: {r"\*\*": ".*", r"\*": "[^/]*", r"\?": "[^/]"}[m[0]], re.escape(g)) + r"\Z") for g in globs]
    texts = [".aab/c", ".q.axxb/", "xyz", "x/z", "..c/e/d", "..c/d", "." + "long" * 30 + "ab", ".h/exact", ".h/exact2", "", "a/b", ".w.é/ü", "." * 300]
    found = urls.Automaton([urls.Rule(g, "block") for g in globs]).match([t.encode() for t in texts])
    assert found.tolist() == [[bool(r.match(t)) for r in regexes] for t in texts]


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "cy", "ok"), (1, 3, "cy", "ok"), (1, 300, "ann", "late"),
            (2, None, None, "?"), (2, 0, "", ""), (None, 0, "ann", "alone"), (3, 0, "system", "only")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, speaker string")
    got = {(r.conv_id, r.speaker, r.segment): r for r in chat.perspectives(frame).collect()}
    assert set(got) == {(1, s, k) for s in ("ann", "bob", "cy") for k in (0, 1)} | {(2, "unknown", 0), (None, "ann", 0)}
    view = got[1, "cy", 0]
    assert view.text == ("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi < |im_end|><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
                         "<|im_start|>assistant\nok<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n")
    assert [view.text[s["start"]:s["end"]] for s in view.spans] == ["ok<|im_end|>"] * 2
    assert view.n_masked == len(view.text) - 24 and got[1, "cy", 1].spans == [] and got[2, "unknown", 0].n_messages == 2
    assert chat.perspectives(frame.limit(0)).collect() == []


def test_word_hashes():
    """Equal words, and only those, have equal hashes, wherever they stand."""
    texts = [b"a b  a\tc", b"", b" \n", "été a  x".encode(), b"abc acb bca " * 3]
    hashes, at = hashing.hashed_words(texts)
    words = [w for t in texts for w in t.split()]
    assert at.tolist() == [0, 4, 4, 4, 7, 16] and len(hashes) == len(words)
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
