"""Words of many texts as arrays of 64-bit hashes, without an object per word."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 64, size=256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = [np.uint64(int(x) | 1) for x in _rng.integers(0, 1 << 63, size=64, dtype=np.uint64)]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Texts are worked on together until they hold so many bytes.
CHUNK_BYTES = 1_000_000


def encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: Iterable[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """``(number of the first text, texts)`` of bounded size; a longer text is a chunk of its own."""
    first, part, held = 0, [], 0
    for text in texts:
        part.append(text)
        held += len(text)
        if held > CHUNK_BYTES:
            yield first, part
            first, part, held = first + len(part), [], 0
    if part:
        yield first, part


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and the place of each text's first word, with the number of words at the end.

    A word is a run of bytes other than the six white space characters of ASCII, so it never ends inside a character.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    inside = ~_SPACE[raw]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    sizes = np.flatnonzero(edge == -1) - starts
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    offsets = np.concatenate([[0], np.searchsorted(starts, ends)])
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), offsets
    first = np.cumsum(sizes) - sizes
    power = np.concatenate([[np.uint64(1)], np.full(int(sizes.max()), _BASE)]).cumprod(dtype=np.uint64)
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    values = _BYTE[raw[inside]] * power[place]
    return mixed(np.add.reduceat(values, first) + sizes.astype(np.uint64)), offsets


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every window of ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total += words[k:n + k] * _ODD[k]
    return mixed(total)


def sequence_hash(words: np.ndarray) -> np.uint64:
    """The hash of a whole sequence shorter than a window."""
    total = len(words)
    for k, w in enumerate(words.tolist()):
        total = (total * int(_BASE) + w * int(_ODD[k % len(_ODD)])) & 0xFFFFFFFFFFFFFFFF
    return mixed(np.array([total], dtype=np.uint64))[0]
