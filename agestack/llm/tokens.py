"""Token ids of texts in binary files of directly addressable codes.

An id is cut into chunks of bits, lowest first.  Level k holds the k-th chunks of all ids that have so many, a bitmap that
says which of them go on, and a rank directory: the number of marks before each block of 512 bits.  A token's place on the
next level is the number of marks before it, so any token is found by one look at each level, without decoding others.
The widths of the levels are chosen for each file, as those that make it smallest.

Documents are dealt by ranges of their ids, so the files in the order of their names hold them in ascending order.  A task
writes its files one after another, each under a name of its own that is changed when it is whole: a task that runs again
puts the same bytes in the same place.
"""

from __future__ import annotations

import codecs
import gc
import json
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from agestack import session

from .common import settle, text_of

#: A file is closed when it has so many tokens; a longer document is a file of its own.
SHARD_TOKENS = 8_000_000
#: Bits of a bitmap to an entry of its rank directory.
RANK_BITS = 512
#: Tokens encoded or decoded at a time.
PIECE = 1 << 18
#: Texts are cut at spaces to pieces of at least so many characters while they are encoded.
TEXT_PIECE = 1_000_000
#: Words and characters of words whose ids a Python worker remembers; beyond, it forgets those not met again.
KNOWN_WORDS, KNOWN_CHARS = 400_000, 16_000_000
#: Characters of texts encoded together, so that words they share are looked up once.
BATCH_CHARS = 8_000_000
MAGIC = b"DACS0001"


def open_folder(path: str):
    """The file system of a folder and the path on it."""
    from pyarrow import fs

    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(path)


# --- Text to ids ---

#: What the byte-level pre-tokenizer splits words into, here applied to Latin letters only (below U+0250),
#: whose classes no version of Unicode has changed.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Fixed rule: bytes that are printable in Latin-1 stand for themselves, the others for the characters from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_OTHERS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_BYTES = "".join(chr(_OTHERS.get(b, b)) for b in range(256))
#: The same with a space for 0xFF, which is in no text: it parts those that are given to the model together.
_JOINED = _BYTES[:255] + " "


class Encoder:
    """The ids of texts as the tokenizer gives them, with every distinct word encoded once.

    The byte-level pre-tokenizer never joins a space to what stands before it, so a text may be cut wherever a space follows
    anything but white space.  Words of Latin letters, digits and ASCII signs are split here and go straight to the
    tokenizer's model; all other words go through the whole tokenizer.  A tokenizer with any other rule gets whole texts.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        spec = json.loads(definition)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        self.by_words = (
            not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
            and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not (spec.get("model") or {}).get("dropout")
            and not any(" " in t["content"] or t["content"].isalpha() or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added))
        self.added = [t["content"] for t in added]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # parts not met since ``known`` was begun
        self.chars = 0

    @classmethod
    def of_task(cls, definition: str) -> Encoder:
        """One encoder for all tasks of a Python worker: it is kept beside the library, which outlives a task."""
        import tokenizers

        kept = vars(tokenizers).setdefault("_kept_encoders", {})
        if definition not in kept:
            kept.clear()
            kept[definition] = cls(definition)
        return kept[definition]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _model(self, parts: list[str]) -> list[bytes]:
        """The ids of each of what the pre-tokenizer leaves whole."""
        if not parts:
            return []
        letters = codecs.charmap_decode(b"\xff".join(map(str.encode, parts)), "strict", _JOINED)[0].split(" ")
        tokenize = self.tokenizer.model.tokenize
        return [array("I", [t.id for t in tokenize(x)]).tobytes() for x in letters]

    def _codes(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The ids of distinct pieces, as bytes in some order, and the place of each piece there.

        Words that begin with white space are split alone: side by side, it would join that of the word before.
        """
        odd = pc.match_substring_regex(words, _WHOLE)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(words, token))
        odd = odd.to_numpy(zero_copy_only=False)
        plain = _SPLIT.findall(" " + " ".join(words.filter(pa.array(~odd)).to_pylist())) if not odd.all() else []
        other = [" " + w for w in words.filter(pa.array(odd)).to_pylist()]
        if len(self.known) > KNOWN_WORDS or self.chars > KNOWN_CHARS:
            self.older, self.known, self.chars = self.known, {}, 0
        self._learn(plain, self._model)
        self._learn(other, self._ids)
        code = self.known.__getitem__
        codes = pa.array([*map(code, plain), *map(code, other)], pa.large_binary())
        first = np.append(pc.starts_with(pa.array(plain, pa.large_string()), " ").to_numpy(zero_copy_only=False),
                          np.ones(len(other), dtype=bool))
        ends = np.frombuffer(codes.buffers()[1], dtype=np.int64)[:len(codes) + 1][np.append(first, True)]
        joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), codes.buffers()[2]])
        place = np.empty(len(words), dtype=np.int64)
        place[~odd] = np.arange(len(words) - len(other))
        place[odd] = np.arange(len(words) - len(other), len(words))
        return joined, place

    def _learn(self, parts: list[str], encode: Callable) -> None:
        known, older = self.known, self.older.get
        new = list(dict.fromkeys(x for x in parts if x not in known))
        self.chars += sum(map(len, new))
        known.update((x, older(x)) for x in new)
        new = [x for x in new if known[x] is None]
        collecting = gc.isenabled()
        gc.disable()  # many small objects are made, none of which refer to each other
        try:
            known.update(zip(new, encode(new)))
        finally:
            if collecting:
                gc.enable()

    def _merged(self, text: str) -> list[str]:
        """The pieces of a text; every one but the first stands for itself with a space before it.  Spaces after white space
        belong to the piece that holds it."""
        words = text.split(" ")
        merged = words[:1]
        for word in words[1:]:
            if merged[-1] and not merged[-1][-1].isspace():
                merged.append(word)
            elif len(merged) == 1 and not merged[0]:
                merged.append(word)
            elif len(merged) > 1 and not merged[-1]:
                merged[-1] = " " + word  # two spaces in a row: the piece is " " and then " word"
            else:
                merged[-1] += " " + word
        return merged

    def _encode(self, texts: list[str]) -> list[bytes]:
        """The pieces of all texts are numbered by distinct piece, and the ids of each are copied to its places."""
        column = pa.array(texts, pa.large_string())
        gaps = pc.match_substring_regex(column, _GAP).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(column.filter(pa.array(~gaps)), " ")
        pieces, sizes = [split.flatten()], [pc.list_value_length(split).to_numpy(zero_copy_only=False)]
        if gaps.any():
            merged = [self._merged(texts[k]) for k in np.flatnonzero(gaps).tolist()]
            pieces.append(pa.array([x for words in merged for x in words], pa.large_string()))
            sizes.append(np.array([len(words) for words in merged], dtype=np.int64))
        pieces, sizes = pa.concat_arrays(pieces), np.concatenate(sizes)
        rest = np.ones(len(pieces), dtype=bool)
        rest[np.cumsum(sizes) - sizes] = False
        heads = self._ids(pieces.filter(pa.array(~rest)).to_pylist())
        coded = pieces.filter(pa.array(rest)).dictionary_encode()
        codes, place = self._codes(coded.dictionary)
        found = codes.take(pa.array(place[coded.indices.to_numpy()]))
        bounds = np.append(0, np.cumsum(sizes - 1))
        ends = np.frombuffer(found.buffers()[1], dtype=np.int64)[bounds].tolist() if len(found) else [0] * len(bounds)
        data = memoryview(found.buffers()[2] or b"")
        out = [head + data[i:j] for head, i, j in zip(heads, ends, ends[1:])]
        order = np.argsort(np.append(np.flatnonzero(~gaps), np.flatnonzero(gaps)))
        return [out[k] for k in order.tolist()]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers of this machine's byte order."""
        if not self.by_words:
            return self._ids(texts)
        out: list[bytes] = []
        held, chars = [], 0
        for text in texts:
            if held and chars + len(text) > BATCH_CHARS:
                out += self._encode(held)
                held, chars = [], 0
            held.append(text)
            chars += len(text)
        return out + self._encode(held) if held else out


#: White space (all that Python knows) before a space.
_SPACES = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_GAP = f"[{_SPACES}] "
#: Words for the whole tokenizer: signs, digits and separators whose classes the two regular expression languages need not
#: agree on, all beyond the Latin letters, and words that are empty, begin with white space or hold a space.
_WHOLE = rf"^$|^[{_SPACES}]| |[\x1c-\x1f\x80-\xbf\xd7\xf7]|[^\x00-\x{{24f}}]"


def text_pieces(text: str) -> Iterator[str]:
    """Pieces of a long text, cut before a space that follows a character other than white space."""
    at = 0
    while len(text) - at > 2 * TEXT_PIECE:
        cut = _CUT.search(text, at + TEXT_PIECE)
        if cut is None:
            break
        yield text[at:cut.start() + 1]
        at = cut.start() + 1
    yield text[at:] if at else text


_CUT = re.compile(r"\S(?= )")


# --- Files ---

def widths_of(ids: np.ndarray) -> list[int]:
    """Bits of each level, multiples of four, for which the levels of ``ids`` take least room."""
    top = int(ids.max()) if len(ids) else 0
    nibbles = max(1, -(-top.bit_length() // 4))
    beyond = [len(ids), *(int(np.count_nonzero(ids >= np.uint32(1 << 4 * k))) for k in range(1, nibbles)), 0]  # with more than k nibbles
    best: list[tuple[float, list[int]]] = [(0.0, [])] * (nibbles + 1)
    for at in range(nibbles - 1, -1, -1):
        best[at] = min(
            (beyond[at] * (4 * w + (at + w < nibbles) * (1 + 32 / RANK_BITS)) + best[at + w][0], [4 * w, *best[at + w][1]])
            for w in range(1, nibbles - at + 1))
    return best[0][1]


def pack_chunks(values: np.ndarray, width: int) -> bytes:
    """Numbers of ``width`` bits, a multiple of four, without gaps."""
    nibbles = ((values[:, None] >> np.arange(0, width, 4, dtype=np.uint32)) & np.uint32(15)).astype(np.uint8).reshape(-1)
    if len(nibbles) % 2:
        nibbles = np.append(nibbles, np.uint8(0))
    return (nibbles[::2] | (nibbles[1::2] << 4)).tobytes()


def unpack_chunks(data: bytes, skip: int, count: int, width: int) -> np.ndarray:
    """``count`` numbers after ``skip`` nibbles."""
    raw = np.frombuffer(data, dtype=np.uint8)
    nibbles = np.empty(2 * len(raw), dtype=np.uint8)
    nibbles[::2], nibbles[1::2] = raw & 15, raw >> 4
    per = width // 4
    nibbles = nibbles[skip:skip + count * per].reshape(count, per).astype(np.uint32)
    return (nibbles << np.arange(0, width, 4, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_file(out, ids: np.ndarray, sizes: np.ndarray, doc_ids: pa.Array) -> int:
    """One file: the magic, the length of a header, the header (JSON), and the sections it names."""
    widths = widths_of(ids)
    sections, levels, rest = [], [], ids
    for k, width in enumerate(widths):
        last = k + 1 == len(widths)
        parts, marks = [], []
        above = []
        step = PIECE  # an even number of chunks, so that parts end at whole bytes
        for at in range(0, len(rest), step):
            part = rest[at:at + step]
            parts.append(pack_chunks(part, width))
            if not last:
                more = part >> np.uint32(width)
                marks.append(more > 0)
                above.append(more[more > 0])
        levels.append({"width": width, "n": len(rest), "chunks": len(sections)})
        sections.append(b"".join(parts))
        if not last:
            bits = np.concatenate([*marks, np.zeros(0, dtype=bool)])
            starts = np.arange(0, len(bits), RANK_BITS)
            counts = np.add.reduceat(bits, starts, dtype=np.int64) if len(bits) else np.zeros(0, dtype=np.int64)
            sections.append(np.packbits(bits, bitorder="little").tobytes())
            sections.append((np.cumsum(counts) - counts).astype("<u4").tobytes())
            rest = np.concatenate([*above, np.zeros(0, dtype=np.uint32)])
    sections.append(np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes())
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([doc_ids], ["doc_id"])
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    sections.append(sink.getvalue().to_pybytes())
    places = np.cumsum([0] + [len(s) for s in sections]).tolist()
    header = json.dumps({"n_tokens": len(ids), "n_docs": len(sizes), "levels": levels, "places": places}).encode()
    for part in (MAGIC, len(header).to_bytes(4, "little"), header, *sections):
        out.write(part)
    return len(MAGIC) + 4 + len(header) + places[-1]


class TokenFile:
    """A file opened for reading any tokens of it."""

    def __init__(self, folder: str, name: str):
        system, path = open_folder(folder)
        self.file = system.open_input_file(f"{path}/{name}")
        head = self.file.read_at(len(MAGIC) + 4, 0)
        if head[:len(MAGIC)] != MAGIC:
            raise ValueError(f"{name} is not a token file")
        size = int.from_bytes(head[len(MAGIC):], "little")
        header = json.loads(self.file.read_at(size, len(MAGIC) + 4))
        self.levels, self.n_tokens, self.n_docs = header["levels"], header["n_tokens"], header["n_docs"]
        self.places = [p + len(MAGIC) + 4 + size for p in header["places"]]

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _bytes(self, section: int, first: int, end: int) -> bytes:
        return self.file.read_at(end - first, self.places[section] + first)

    def _marks(self, section: int, first: int, end: int) -> np.ndarray:
        """Bits ``first`` to ``end`` of a bitmap."""
        data = np.frombuffer(self._bytes(section, first // 8, -(-end // 8)), dtype=np.uint8)
        return np.unpackbits(data, bitorder="little")[first % 8:first % 8 + end - first].astype(bool)

    def _rank(self, section: int, place: int) -> int:
        block = place // RANK_BITS
        before = int.from_bytes(self._bytes(section + 1, 4 * block, 4 * block + 4), "little")
        return before + int(self._marks(section, block * RANK_BITS, place).sum())

    def read(self, first: int, end: int) -> np.ndarray:
        """Tokens ``first`` to ``end``: their chunks on every level, and nothing else."""
        ids = np.zeros(end - first, dtype=np.uint32)
        where, shift = None, 0
        for level in self.levels:
            if first == end:
                break
            per, section = level["width"] // 4, level["chunks"]
            data = self._bytes(section, first * per // 2, -(-end * per // 2))
            chunks = unpack_chunks(data, first * per % 2, end - first, level["width"]) << np.uint32(shift)
            if where is None:
                ids |= chunks
            else:
                ids[where] |= chunks
            shift += level["width"]
            if level is self.levels[-1]:
                break
            marks = self._marks(section + 1, first, end)
            where = np.flatnonzero(marks) if where is None else where[marks]
            first = self._rank(section + 1, first)
            end = first + len(where)
        return ids

    def token(self, place: int) -> int:
        return int(self.read(place, place + 1)[0])

    def starts(self, first: int, end: int) -> np.ndarray:
        """The places of the first tokens of documents ``first`` to ``end``; that of ``n_docs`` is the number of tokens."""
        section = len(self.places) - 3
        return np.frombuffer(self._bytes(section, 8 * first, 8 * end), dtype="<u8").astype(np.int64)

    def document(self, number: int) -> np.ndarray:
        return self.read(*self.starts(number, number + 2).tolist())

    def doc_ids(self) -> pa.Array:
        section = len(self.places) - 2
        data = self._bytes(section, 0, self.places[section + 1] - self.places[section])
        return pa.ipc.open_stream(data).read_all().column("doc_id").combine_chunks()


# --- Spark ---

def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, list, list[str]]]:
    """The type of ``doc_id``, ids and texts of batches, several at a time until they hold ``BATCH_CHARS`` bytes of text."""
    kind, ids, texts, size = None, [], [], 0
    for batch in batches:
        more = batch.column("text")
        if texts and size + more.nbytes > BATCH_CHARS:
            yield kind, ids, texts
            ids, texts, size = [], [], 0
        kind = batch.schema.field("doc_id").type
        ids += batch.column("doc_id").to_pylist()
        texts += more.to_pylist()
        size += more.nbytes
    if texts:
        yield kind, ids, texts


def write_tokens(docs: DataFrame, folder: str, definition: str, end_id: int = 0) -> DataFrame:
    """Encode every text with the tokenizer of ``definition`` (its JSON), append ``end_id`` to each, and write files to ``folder``.

    Returns a row per file: ``part, number, file, n_docs, n_tokens, n_bytes``; ``part`` and ``number`` give their order.
    Documents stand in ascending order of doc_id, those without one first, then by a hash of the text.  Null texts are
    empty and have the end id alone.  Repeated rows are documents of their own.  No rows give no files.  Other columns are
    ignored.
    """
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    folder = system.makeQualified(path).toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of_task(definition), TaskContext.get().partitionId()
        files, base = open_folder(folder)
        end = array("I", [end_id]).tobytes()
        held, doc_ids, sizes, n_held, number = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:06d}-{number:06d}.dac"
            own = f"{base}/_{name}-{uuid.uuid4().hex}"
            with files.open_output_stream(own, compression=None) as out:
                n = write_file(out, np.frombuffer(b"".join(held), dtype=np.uint32), np.array(sizes, dtype=np.int64),
                               pa.array(doc_ids, type=kind))
            files.move(own, f"{base}/{name}")
            row = [part, number, name, len(sizes), n_held, n]
            return pa.RecordBatch.from_pydict({c: [x] for c, x in zip(_FILE.names, row)}, schema=_FILE)

        for kind, ids, texts in _gathered(batches):
            pieces = [list(text_pieces(t)) for t in texts]
            codes = iter(encoder.encode([p for t in pieces for p in t]))
            for doc_id, t in zip(ids, pieces):
                code = b"".join([*(next(codes) for _ in t), end])
                if held and n_held + len(code) // 4 > SHARD_TOKENS:
                    yield close()
                    held, doc_ids, sizes, n_held, number = [], [], [], 0, number + 1
                held.append(code)
                doc_ids.append(doc_id)
                sizes.append(len(code) // 4)
                n_held += sizes[-1]
        if held:
            yield close()

    rows = docs.select("doc_id", text_of().alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    dealt = rows.withColumns({"h": order[1], "i": order[2]}).repartitionByRange(order[0], "h", "i")
    dealt = dealt.sortWithinPartitions(order[0], "h", "i").select("doc_id", "text")
    return settle(dealt.mapInArrow(run, "part int, number int, file string, n_docs long, n_tokens long, n_bytes long"), "token-files")


_FILE = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()),
                   ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])


def placed_files(files: DataFrame) -> DataFrame:
    """``files`` with ``base``, the tokens in all files before.  The driver adds up a number per part, of which there are at
    most as many as shuffle partitions."""
    spark = files.sparkSession
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    bases = np.cumsum([0] + [r.n for r in sums]).tolist()
    parts = spark.createDataFrame([(r.part, b) for r, b in zip(sums, bases)], "part int, before long")
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("n_tokens")
    return files.join(parts, "part").withColumn("base", F.col("before") + within).drop("before")


def read_documents(files: DataFrame, folder: str, id_type: T.DataType) -> DataFrame:
    """Per document of the files ``doc_id, start, n_tokens, ids_crc32``, all from the files' own directories and codes.

    ``start`` counts the tokens of all files before; the checksum is that of the ids as little-endian 32-bit numbers.
    """
    spark = files.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with TokenFile(folder, name) as source:
                    starts = source.starts(0, source.n_docs + 1)
                    sums = np.zeros(source.n_docs, dtype=np.int64)
                    for at in range(0, source.n_tokens, PIECE):
                        end = min(at + PIECE, source.n_tokens)
                        raw = memoryview(source.read(at, end).astype("<u4").tobytes())
                        first, last = np.searchsorted(starts, [at, end - 1], side="right") - 1
                        for k in range(first, last + 1):
                            own = raw[4 * (max(starts[k], at) - at):4 * (min(starts[k + 1], end) - at)]
                            sums[k] = zlib.crc32(own, int(sums[k]))
                    yield pa.RecordBatch.from_arrays(
                        [source.doc_ids(), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(sums)], schema.names)

    n = files.count()
    return placed_files(files).select("file", "base").repartition(max(1, n)).mapInArrow(run, schema)


def token_table(docs: DataFrame, definition: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write the files of ``docs`` (to the shared folder if none is named) and return ``read_documents`` of them.

    The edge cases are those of ``write_tokens``: a row per row, whatever is null, empty, long or repeated.
    """
    folder = folder or session.scratch_path(docs.sparkSession, "token-files")
    return read_documents(write_tokens(docs, folder, definition, end_id), folder, docs.schema["doc_id"].dataType)
