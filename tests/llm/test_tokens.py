"""Token files: against the tokenizer itself, exact round trips, and reads of single tokens."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from agestack.llm import queries, tokens
from agestack.session import scratch_path
from oracle import SF, duck

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def definition():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def tokenizer(definition):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


def expected(tokenizer, rows):
    """``(doc_id, start, n_tokens, crc)`` of whole texts, ids ascending and nulls first."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark, tokenizer):
    want = expected(tokenizer, duck(SF).execute("SELECT doc_id, text FROM documents").fetchall())
    assert sorted(map(tuple, queries.QUERIES["op11_token_files"](spark, SF).collect())) == want


PIECES = ["a", "B", " ", " ", "  ", "\n", "\xa0", "　", " ", "'s", "'ve", "1", "é", "ß", "ǅ", "ª", "²", "½", "×", "\x1c", "\x85", "\x80", "日", "!",
          "_", "\t", "​", "\xad", "\x00", "ʰ", "İ", "<|endoftext|>", "hello", "naïve"]


@pytest.mark.parametrize("seed", range(4))
def test_encoder_against_the_tokenizer(definition, tokenizer, seed):
    rng, encoder = random.Random(seed), tokens.Encoder(definition)
    assert encoder.by_words
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(5000)]
    for text, code in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(code, dtype=np.uint32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_part_goes_to_the_model_once(monkeypatch, definition, tokenizer):
    given, model = [], tokens.Encoder._model
    monkeypatch.setattr(tokens.Encoder, "_model", lambda self, parts: given.extend(parts) or model(self, parts))
    texts = ["x one one, one. two! (one two) one\n two", "x one; two? one, two.\n\n \none", "x two one"]
    encoder = tokens.Encoder(definition)
    for _ in range(2):
        assert encoder.encode(texts) == [np.array(e.ids, dtype=np.uint32).tobytes() for e in tokenizer.encode_batch(texts)]
    assert {" one", " two"} <= set(given) and len(given) == len(set(given))


def test_added_tokens_of_letters(definition):
    from tokenizers import Tokenizer

    added = Tokenizer.from_str(definition)
    added.add_tokens(["qqsep"])
    text = "a word qqsep and aqqsepb, word"
    assert tokens.Encoder(added.to_str()).encode([text]) == [np.array(added.encode(text).ids, dtype=np.uint32).tobytes()]


def test_other_tokenizers_get_whole_texts():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as file:
        encoder = tokens.Encoder(file.read())
    assert not encoder.by_words
    assert np.frombuffer(encoder.encode(["Two  Words"])[0], dtype=np.uint32).tolist() == encoder.tokenizer.encode("Two  Words", add_special_tokens=False).ids


def test_text_pieces(monkeypatch, definition, tokenizer):
    monkeypatch.setattr(tokens, "TEXT_PIECE", 5)
    rng, encoder = random.Random(3), tokens.Encoder(definition)
    for _ in range(500):
        text = "".join(rng.choices(PIECES, k=rng.randint(0, 60)))
        pieces = list(tokens.text_pieces(text))
        assert "".join(pieces) == text
        ids = np.frombuffer(b"".join(encoder.encode(pieces)), dtype=np.uint32).tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("high", [1, 16, 256, 5000, 50_257, 1 << 20, 1 << 32])
def test_any_token_without_the_others(tmp_path, monkeypatch, high):
    monkeypatch.setattr(tokens, "PIECE", 1024)
    rng = np.random.default_rng(high)
    ids = (rng.random(5001) ** 3 * high).astype(np.uint64).astype(np.uint32)
    sizes = np.array([0, 1, 700, 0, 4300, 0])
    with open(tmp_path / "x.dac", "wb") as out:
        n = tokens.write_file(out, ids, sizes, pa.array(["b", None, "c", "d", "e", "f"]))
    assert n == (tmp_path / "x.dac").stat().st_size
    with tokens.TokenFile(str(tmp_path), "x.dac") as file:
        assert sum(x["width"] for x in file.levels) >= max(1, int(ids.max()).bit_length())
        assert file.doc_ids().to_pylist() == ["b", None, "c", "d", "e", "f"]
        assert (file.read(0, 5001) == ids).all()
        for place in (0, 1, 511, 512, 513, 1023, 1024, 2049, 4999, 5000):
            assert file.token(place) == ids[place]
        for _ in range(50):
            a, b = sorted(rng.integers(0, 5002, 2).tolist())
            assert (file.read(a, b) == ids[a:b]).all()
        assert file.document(0).tolist() == [] and (file.document(2) == ids[1:701]).all()
    if high == 50_257:
        assert sum(x["n"] * (x["width"] + 1) for x in file.levels) < 16.5 * len(ids)


def test_no_tokens(tmp_path):
    with open(tmp_path / "x.dac", "wb") as out:
        tokens.write_file(out, np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), pa.array([], pa.int64()))
    with tokens.TokenFile(str(tmp_path), "x.dac") as file:
        assert file.read(0, 0).tolist() == [] and file.doc_ids().to_pylist() == []


def test_widths_are_the_best(monkeypatch):
    from itertools import product

    ids = (np.random.default_rng(1).random(3000) ** 4 * 60_000).astype(np.uint32)

    def bits(widths):
        total, rest = 0, ids
        for k, w in enumerate(widths):
            total += len(rest) * (w + (k + 1 < len(widths)) * (1 + 32 / tokens.RANK_BITS))
            rest = (rest >> w)[rest >> w > 0]
        return total if not len(rest) else float("inf")

    every = [w for n in range(1, 5) for w in product([4, 8, 12, 16], repeat=n)]
    assert bits(tokens.widths_of(ids)) == min(map(bits, every))


def test_edges(spark, docs, definition, tokenizer, monkeypatch):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, long), (6, "twice"), (6, "twice"), (6, "another"), (None, "no id"), (None, None)]
    got = tokens.token_table(docs(rows), definition).collect()
    assert len(got) == len(rows)
    want = expected(tokenizer, rows)
    key = lambda rows: sorted((d is not None, d or 0, n, c) for d, _, n, c in rows)
    assert key(got) == key(want)
    spans = sorted((r.start, r.start + r.n_tokens, r.doc_id if r.doc_id is not None else -1) for r in got)
    assert all(a[1] == b[0] and a[2] <= b[2] for a, b in zip(spans, spans[1:])) and spans[0][0] == 0
    assert tokens.token_table(docs([]), definition).collect() == []


def test_many_files_and_text_ids(spark, definition, tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_TOKENS", 40)
    rows = [(f"d{i:03d}", "word " * (i % 17)) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    folder = scratch_path(spark, "files")
    files = tokens.write_tokens(frame, folder, definition)
    listed = files.collect()
    assert len(listed) > 20 and all(r.n_tokens <= 40 for r in listed)
    got = tokens.token_table(frame, definition, folder=scratch_path(spark, "files")).collect()
    assert sorted(map(tuple, got)) == expected(tokenizer, rows)
    first = min(listed, key=lambda r: (r.part, r.number))
    with tokens.TokenFile(folder, first.file) as file:
        assert file.doc_ids()[0].as_py() == "d000" and file.document(0).tolist() == [0]
