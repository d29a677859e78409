"""Word shingles of texts as sorted arrays of 64-bit hashes, by numpy over whole batches."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np

from panelwright.llm.common import runs

_CHUNK = 1 << 22
_ROOT = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@functools.lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """A random 64-bit value for each byte, A-Z those of a-z; whether a byte separates words (space, \\t to \\r)."""
    values = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
    values[65:91] = values[97:123]
    gap = np.zeros(256, bool)
    gap[[32, *range(9, 14)]] = True
    return values, gap


_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        base = np.full(max(n, 1 << 16), _ROOT if which == "up" else _INVERSE, np.uint64)
        base[0] = 1
        _powers[which] = np.cumprod(base)
    return _powers[which][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word in bytes that begin and end between words."""
    values, gap = _letters()
    edges = np.diff(np.concatenate([[True], gap[data], [True]]).view(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * _power("up", len(data)), out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * _power("down", len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, A-Z lower-cased."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
    gap = _letters()[1]
    at, starts, hashes = 0, [], []
    while at < len(data):  # in chunks that end between words
        end = min(at + _CHUNK, len(data))
        while end < len(data) and not len(cut := np.flatnonzero(gap[data[at:end]])):
            end = min(end + _CHUNK, len(data))
        if end < len(data):
            end = at + int(cut[-1]) + 1
        s, h = _words(data[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    starts, hashes = np.concatenate(starts), np.concatenate(hashes)
    cuts = np.searchsorted(starts, bounds)
    for i in range(len(texts)):
        yield hashes[cuts[i] : cuts[i + 1]]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words in order; of a shorter sequence as a whole; none without words."""
    n = min(size, len(words))
    if not n:
        return words
    total = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        total = mix(total * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - n + 1 + i])
    return total


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles, as sorted signed 64-bit hashes."""
    for a, b in runs(texts):
        for words in word_hashes(texts[a:b]):
            yield np.unique(shingle_hashes(words, size).view(np.int64))


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that name the set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
