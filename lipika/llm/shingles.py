"""Word shingles of whole texts as sets of 64-bit hashes, from Arrow buffers, in blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lipika.llm.textbytes import whole

WIDTH = 5
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90))
_LOWERED = _BYTE[_LOWER]
_FILLED = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes of whole words that are hashed together; a longer word is hashed by itself.
PIECE = 1 << 17
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers from 0 to ``n`` at least, and their inverses."""
    if n > PIECE or not _POWERS:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        made = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, PIECE), x)])) for x in (_BASE, inverse))
        if n > PIECE:
            return made
        _POWERS.append(made)
    return _POWERS[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word, A-Z lower-cased; words end at the six ASCII white-space characters.

    A word's hash is the polynomial of its bytes with its length, mixed: a difference of running sums, brought back to the
    word's first place by a power's inverse.
    """
    data, offsets = whole(texts)
    filled = _FILLED.take(data)
    first, last = filled.copy(), filled.copy()
    first[1:] = filled[1:] > filled[:-1]
    last[:-1] = filled[:-1] > filled[1:]
    for at, edge in ((first, offsets[:-1][offsets[:-1] < len(data)]), (last, offsets[1:][offsets[1:] > 0] - 1)):
        at[edge] = filled[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, offsets)))
    h = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + PIECE, side="right")))
        here, s, e = data[start[lo] : end[hi - 1]], start[lo:hi] - start[lo], end[lo:hi] - start[lo]
        powers, inverse = _powers(len(here))
        sums = np.zeros(len(here) + 1, np.uint64)
        np.cumsum(_LOWERED.take(here) * powers[: len(here)], out=sums[1:])
        h[lo:hi] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        lo = hi
    return mix(h), owner


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle; a text of fewer words is one shingle, a text without words has none."""
    h, owner = word_hashes(texts)
    n = len(texts)
    words = np.bincount(owner, minlength=n)
    total = len(h)
    sums = np.zeros(total, np.uint64)
    for j in range(min(WIDTH, total)):
        sums[: total - j] += h[j:] * _PLACE[j]
    nth = np.arange(total) - (np.cumsum(words) - words)[owner]
    full = nth + WIDTH <= words[owner]
    out, of = mix(sums[full] + np.uint64(WIDTH)), owner[full]
    short = np.flatnonzero((words > 0) & (words < WIDTH))
    if len(short):
        at = np.cumsum(words) - words
        s = np.array([(h[at[d] : at[d] + words[d]] * _PLACE[: words[d]]).sum(dtype=np.uint64) + np.uint64(words[d]) for d in short], np.uint64)
        out, of = np.concatenate([out, mix(s)]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Per text its sorted distinct shingles."""
    s, of = shingles(texts)
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))])
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield np.unique(s[a:b])


def digest(members: np.ndarray) -> bytes:
    """16 bytes that name a set."""
    return hashlib.blake2b(members.astype("<u8").tobytes(), digest_size=16).digest()


def links(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct sets."""
    if not len(a) or not len(b):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= percent * (len(a) + len(b) - both)
