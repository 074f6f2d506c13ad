"""URL filters: many glob rules matched at once by a bit-parallel automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Bytes of URLs that one step of the automaton works on together.
BATCH_BYTES = 8 << 20


@dataclass(frozen=True)
class Rule:
    """``glob`` over ``.host/path``: ``*`` is any run without a slash, ``**`` any run, ``?`` one character but a slash.

    A rule with a ``name`` decides before those without; of several that fit, the longest name wins.
    """

    glob: str
    verdict: str
    name: str | None = None


def prefix_rule(rule: str, verdict: str) -> Rule:
    """``host/path``: the host and all its subdomains, paths that begin with the rule's."""
    host, slash, path = rule.partition("/")
    return Rule(f"*.{host}{slash}{path}**", verdict, rule)


#: What else is blocked: link farms by host, and files that hold no text.
DEFAULT_GLOBS = (
    Rule("*.spam-*/**", "block"), Rule("*.casino*/**", "block"),
    *(Rule(f"*/**.{ending}", "block") for ending in ("css", "exe", "gif", "gz", "jpg", "js", "mp4", "png", "zip")),
)


def parse_glob(glob: str) -> tuple[list[object], list[str]]:
    """The symbols that move the automaton on, and for each place before, between and after them what it may skip.

    Symbols are byte values or ``?``; skips are ``""``, ``*`` or ``**``.
    """
    symbols, skips, i = [], [""], 0
    while i < len(glob):
        if glob[i] == "*":
            wide = glob.startswith("**", i)
            skips[-1] = "**" if wide or skips[-1] == "**" else "*"
            i += 2 if wide else 1
            continue
        for byte in glob[i].encode("utf-8", "surrogatepass") if glob[i] != "?" else ["?"]:
            symbols.append(byte)
            skips.append("")
        i += 1
    return symbols, skips


class Automaton:
    """All globs side by side in one row of bits, as many 64-bit words as they need.

    Glob g owns one bit per place: bit 0 of it is set before the first character, its last bit says that all of it is
    matched.  One character moves every bit on by one where the symbol fits, and holds it where the place may skip it.
    """

    def __init__(self, rules: Sequence[Rule]):
        parsed = [parse_glob(r.glob) for r in rules]
        bits = sum(len(skips) for _, skips in parsed)
        self.words = (bits + 63) // 64
        self.move = np.zeros((256, self.words), dtype=np.uint64)
        self.hold = np.zeros((256, self.words), dtype=np.uint64)
        self.begin = np.zeros(self.words, dtype=np.uint64)
        self.last: list[tuple[int, np.uint64]] = []
        slash = ord("/")
        at = 0
        for symbols, skips in parsed:
            self._set(self.begin, at)
            for k, skip in enumerate(skips):
                for c in range(256) if skip else ():
                    if skip == "**" or c != slash:
                        self._set(self.hold[c], at + k)
                if k:
                    for c in range(256) if symbols[k - 1] == "?" else (symbols[k - 1],):
                        if symbols[k - 1] != "?" or c != slash:
                            self._set(self.move[c], at + k)
            at += len(skips)
            self.last.append(((at - 1) // 64, np.uint64(1 << ((at - 1) % 64))))

    @staticmethod
    def _set(row: np.ndarray, bit: int) -> None:
        row[bit // 64] |= np.uint64(1 << (bit % 64))

    def match(self, urls: Sequence[bytes]) -> np.ndarray:
        """A row of booleans per URL, one per glob.  All URLs take their n-th character at the same time."""
        sizes = np.fromiter((len(u) for u in urls), dtype=np.int64, count=len(urls))
        order = np.argsort(-sizes, kind="stable")
        text = np.frombuffer(b"".join(urls[i] for i in order) + b"\0", dtype=np.uint8)
        sizes = sizes[order]
        start = np.cumsum(sizes) - sizes
        state = np.tile(self.begin, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        for n in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -n, side="left"))  # URLs longer than n stand first
            c, now = text[start[:live] + n], state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.move[c]) | (now & self.hold[c])
        found = np.empty((len(urls), len(self.last)), dtype=bool)
        for g, (word, bit) in enumerate(self.last):
            found[order, g] = (state[:, word] & bit) != 0
        return found


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", key: str = "page_id") -> DataFrame:
    """Per row ``key, host, path, rule, verdict``.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; the path follows
    it up to ``?``, ``#`` or the end.  Both are empty for a null URL and one without ``://``.  Of named rules that fit
    the longest name decides (of equal lengths block, then the smaller name); ``rule`` has it.  Else ``rule`` is null and
    the other globs decide, block before allow; else ``default``.  Work is per row: repeated rows get the same result,
    no rows give none, other columns are ignored.
    """
    rules = tuple(rules)
    schema = T.StructType([
        pages.schema[key], *(T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict"))])
    ranked = sorted(range(len(rules)), key=lambda g: (
        rules[g].name is None, -len(rules[g].name or ""), rules[g].verdict != "block", rules[g].name or ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(rules)

        def judge(rows: list[tuple]) -> pa.RecordBatch:
            fits = automaton.match([f".{host}{path}".encode("utf-8", "surrogatepass") for _, host, path in rows])
            chosen = np.full(len(rows), -1)
            for g in reversed(ranked):
                chosen[fits[:, g]] = g
            names = [rules[g].name if g >= 0 else None for g in chosen]
            verdicts = [rules[g].verdict if g >= 0 else default for g in chosen]
            columns = [pa.array([r[0] for r in rows], type=kind)]
            columns += [pa.array(c, type=pa.string()) for c in ([r[1] for r in rows], [r[2] for r in rows], names, verdicts)]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            kind = batch.schema.field(key).type
            rows, held = [], 0
            for row in zip(*[batch.column(c).to_pylist() for c in (key, "host", "path")]):
                rows.append(row)
                held += len(row[1]) + len(row[2])
                if held > BATCH_BYTES:
                    yield judge(rows)
                    rows, held = [], 0
            if rows:
                yield judge(rows)

    after = F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract("__after", r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract("__after", r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    parts = pages.select(key, F.coalesce(after, F.lit("")).alias("__after")).select(
        key, F.translate(host, upper, upper.lower()).alias("host"), path.alias("path"))
    return parts.mapInArrow(run, schema)
