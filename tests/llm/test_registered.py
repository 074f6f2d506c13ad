"""Registered queries against SQL, or against plain Python where SQL cannot state them, on whole small tables."""

import hashlib
import re
import string
import zlib
from collections import Counter, defaultdict
from math import log10

import pytest

import corpus_pipeline
from agestack.llm import lm, queries
from oracle import check, duck

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.fixture(scope="module")
def texts(con):
    return {d: t or "" for d, t in con.execute("SELECT doc_id, text FROM documents").fetchall()}


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, con, name):
    diff, n, _ = check(spark, con, SF, name, queries.QUERIES[name], queries.SQL[name])
    assert n and not diff, diff


def test_one_query_per_operator():
    assert [n.partition("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].partition("_")[0]))] == [
        f"op{n}" for n in range(1, 14)]


@pytest.mark.parametrize("name", ["op4_lines", "op7_decontaminate", "op8_mix", "op10_perspectives"])
def test_native_plans(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)


def katz(texts, order):
    """Scores by plain recursion over counters; the discounts are the operator's."""
    train = {d: zlib.crc32(str(d).encode()) % 7 != 2 for d in texts}
    words = {d: ["<s>", *t.encode().lower().split(), "</s>"] for d, t in texts.items()}
    counts = [Counter() for _ in range(order)]
    for d, x in words.items():
        for p in range(1, len(x) if train[d] else 1):
            for k in range(min(order, p + 1)):
                counts[k][tuple(x[p - k:p + 1])] += 1
    n = sum(counts[0].values())
    rules = [lm.discounts(Counter(min(v, lm.TOP + 1) for v in c.values())) for c in counts]

    def history(h):
        return n if not h else sum(train.values()) if h == ("<s>",) else counts[len(h) - 1][h]

    def seen(g):
        c = counts[len(g) - 1][g]
        slope, small = rules[len(g) - 1]
        return c * small.get(c, (1 + 1 / c) ** (slope + 1)) / history(g[:-1])

    masses = defaultdict(lambda: [0.0, 0.0])
    for k in range(1, order):
        for g in counts[k]:
            masses[g[:-1]][0] += seen(g)
            masses[g[:-1]][1] += seen(g[1:])
    unknown = 1 - sum(seen(g) for g in counts[0])

    def value(g):
        if counts[len(g) - 1].get(g):
            return log10(seen(g))
        if len(g) == 1:
            return log10(unknown)
        mass, lower = masses[g[:-1]]
        return (log10((1 - mass) / (1 - lower)) if history(g[:-1]) else 0.0) + value(g[1:])

    out = {}
    for d, x in words.items():
        tokens = range(1, len(x))
        out[d] = (sum(value(tuple(x[max(0, p - order + 1):p + 1])) for p in tokens),
                  sum(log10((counts[0][(x[p],)] + 1) / (n + len(counts[0]) + 1)) for p in tokens),
                  len(tokens), sum((x[p],) in counts[0] for p in tokens), n, not train[d])
    one = [sum(10 ** value((*h, w)) for (w,) in counts[0]) + 10 ** value((*h, "never seen")) for h in list(masses)[:3]]
    return out, one


@pytest.mark.parametrize("order", [2, 3])
def test_lm(spark, texts, order, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 100_000)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 60_000)
    from agestack.llm.common import documents

    want, one = katz(texts, order)
    assert one == pytest.approx([1.0] * len(one))
    got = {r.doc_id: r for r in lm.score(documents(spark, SF), order).collect()}
    assert got.keys() == want.keys()
    for d, (score, base, n, known, total, held) in want.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, held)
        assert (r.score, r.base_score) == pytest.approx((score, base), rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_main_text(spark, con):
    """The pages' articles by a regular expression, which holds for these pages as they nest nothing."""
    import html

    pages = con.execute("SELECT page_id, html FROM pages").fetchall()
    got = {r.page_id: r for r in rows(spark, "op2_main_text")}
    assert len(got) == len(pages)
    for page_id, page in pages:
        article = re.search(r"(?s)<article>(.*?)</article>", page)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        want = "\n".join(x for x in blocks if x)
        assert (got[page_id].text, got[page_id].n_chars) == (want, len(want))


def test_substrings(spark, texts):
    got = {r.doc_id: r for r in rows(spark, "op3_substrings")}
    seen, removed = set(), 0
    for d in sorted(texts):
        words = texts[d].encode().split()
        keep = [True] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i:i + 20])
            if window in seen:
                keep[i:i + 20] = [False] * 20
            seen.add(window)
        kept = [w for w, k in zip(words, keep) if k]
        want = (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == want
        removed += len(words) - len(kept)
    assert removed


def similar_before(texts):
    """(document, line) of every line that has an earlier one of similarity 0.8."""
    sets = [(d, i, frozenset(w.lower() for w in WORD.findall(line)))
            for d in sorted(texts) for i, line in enumerate(texts[d].split("\n"))]
    holders, gone = defaultdict(set), set()
    kinds = set()
    for d, i, s in sets:
        if not s:
            continue
        if s in kinds:
            gone.add((d, i))
            continue
        near = Counter(other for w in s for other in holders[w])
        if any(n * 10 >= 8 * (len(s) + len(other) - n) for other, n in near.items()):
            gone.add((d, i))
        kinds.add(s)
        for w in s:
            holders[w].add(s)
    return gone


def test_lines(spark, texts):
    gone = similar_before(texts)
    got = {r.doc_id: r for r in rows(spark, "op4_lines")}
    assert got.keys() == texts.keys() and gone
    for d, text in texts.items():
        want = [i for i in range(len(text.split("\n"))) if (d, i) in gone]
        assert (got[d].n_lines, got[d].n_removed, got[d].removed) == (len(text.split("\n")), len(want), ",".join(map(str, want)))


def near_groups(texts, size):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(t.translate(LOWER))
        sets[d] = frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    holders = defaultdict(list)
    for d in sorted(sets):
        for other, n in Counter(o for s in sets[d] for o in holders[s]).items():
            if 100 * n >= 80 * (len(sets[d]) + len(sets[other]) - n):
                a, b = root(d), root(other)
                parent[max(a, b)] = min(a, b)
        for s in sets[d]:
            holders[s].append(d)
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_near_duplicates(spark, texts):
    want = near_groups(texts, 4)
    got = rows(spark, "op5_near_duplicates")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and not all(r.kept for r in got)


def base_rules(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit),
            len(words) < 50 or 100 * len(hit) > 50 * len(words))


def test_quality(spark, con, texts):
    got = {r.doc_id: r for r in rows(spark, "op6_quality")}
    for d, t in texts.items():
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_rules(t)
    labels = con.execute("SELECT doc_id, quality FROM labels").fetchall()
    judged = [(q, got[d].kept) for d, q in labels if not got[d].base_failed]
    assert all(kept for q, kept in judged if q) and not any(kept for q, kept in judged if not q)


def test_pipeline(spark, con, texts):
    """Every stage against a plain version of it, on what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    now = dict(texts)
    good = {r.doc_id for r in rows(spark, "op6_quality") if r.kept}
    bench = {tuple(w[i:i + 10]) for (t,) in con.execute("SELECT text FROM benchmark").fetchall()
             for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))] for i in range(len(w) - 9)}

    def lines(now):
        gone = similar_before(now)
        return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in now.items()}

    def leaks(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        return any(tuple(w[i:i + 10]) in bench for i in range(len(w) - 9))

    plain = [
        lambda now: {d: t for d, t in now.items() if d in good}, lines,
        lambda now: {d: now[d] for d, (_, root) in near_groups(now, 5).items() if root == d},
        lambda now: {d: t for d, t in now.items() if not leaks(t)},
    ]
    for (_, stage), expected in zip(corpus_pipeline.STAGES, plain):
        from agestack.session import settle

        docs = settle(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        now = expected(now)
        assert {r.doc_id: r.text for r in docs.collect()} == now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    size = {d: len(WORD.findall(t)) for d, t in now.items()}
    total = defaultdict(int)
    for r in last:
        assert r.text == now[r.doc_id] and 0 < r.taken <= 2 * size[r.doc_id]
        total[r.source, round(r.target)] += r.taken
    assert all(abs(taken - target) <= 1 for (_, target), taken in total.items())
