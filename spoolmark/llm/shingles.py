"""Word shingles of whole texts as 64-bit hashes, computed for many texts at once.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text, with
A-Z lower-cased. A text is hashed in slices cut at blanks, so memory does not
follow its length; every word is hashed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE = 1 << 18  # bytes hashed at once; the arrays of a slice take about 60 bytes for each

_U = np.uint64
_cache: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables(seed: int):
    """What each byte adds, and which bytes are blank."""
    if seed not in _cache:
        drawn = np.random.Generator(np.random.PCG64(seed))
        values = drawn.integers(0, 2**64, 256, dtype=np.uint64)
        values[65:91] = values[97:123]
        blank = np.zeros(256, bool)
        blank[[9, 10, 11, 12, 13, 32]] = True
        _cache[seed] = values, blank
    return _cache[seed]


def _words(data: bytes, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of a piece of bytes.

    A byte and its place in the word are mixed to one number, and a word's
    numbers summed: unlike a polynomial modulo 2^64, under which words of
    a regular build collide whatever its base.
    """
    raw = np.frombuffer(data, np.uint8)
    values, blank = _tables(seed)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~blank[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    place = np.arange(len(raw), dtype=np.uint64)
    if len(starts):
        first = np.zeros(len(raw), np.int64)
        first[starts[0]] = starts[0]
        first[starts[1:]] = np.diff(starts)
        place -= np.cumsum(first).astype(np.uint64)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(mix(values[raw] + place * _U(0x9E3779B97F4A7C15)), out=sums[1:])
    return starts, mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes, seed: int = 1) -> np.ndarray:
    """A hash for each word of one text, in order."""
    parts, at = [], 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        parts.append(_words(text[at:end], seed)[1])
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _grouped(texts: Sequence[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > SLICE:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text) + 1
    if group:
        yield group


def words_of_all(texts: Sequence[bytes], seed: int = 1) -> Iterator[np.ndarray]:
    """``word_hashes`` of each text, many short texts in one go."""
    for group in _grouped(texts):
        if len(group) == 1:
            yield word_hashes(group[0], seed)
            continue
        starts, hashes = _words(b" ".join(group), seed)
        bounds = np.cumsum([0] + [len(t) + 1 for t in group])
        cuts = np.searchsorted(starts, bounds)
        for k in range(len(group)):
            yield hashes[cuts[k] : cuts[k + 1]]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words.

    Fewer words make one shingle of the whole sequence; none make none.
    """
    if not len(words):
        return words
    size = min(size, len(words))
    out = mix(words[: len(words) - size + 1] + _U(size))
    for k in range(1, size):
        out = mix(out * _U(0xD6E8FEB86659FD93) + words[k : len(words) - size + 1 + k])
    return np.unique(out)


def shingles_of_all(texts: Sequence[bytes], size: int, seed: int = 1) -> Iterator[np.ndarray]:
    for words in words_of_all(texts, seed):
        yield shingles(words, size)


def encoded(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    import pyarrow as pa

    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]
