"""Word shingles of many texts at once, as sets of 64-bit hashes."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np

from quern.llm.ordermin import distinct, mix, multipliers

_Q = np.uint64(0xD6E8FEB86659FD93)
#: White space is U+0020 and U+0009 to U+000D; only A-Z are lower-cased.
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[_LOWER]
CELLS = 1_000_000
#: Bytes of a sketch: a second, finer signature for ids that share buckets.
SKETCH = 512
_EMPTY = np.uint32(0xFFFFFFFF)


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _Q, np.uint64)]), dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and how many each text has."""
    raw = [t.encode() for t in texts]
    sizes = np.fromiter((len(b) + 1 for b in raw), np.int64, len(raw))
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    solid = ~_SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    at = np.flatnonzero(begin)
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(raw), np.int64)
    chars = np.flatnonzero(solid)
    first = np.searchsorted(chars, at)
    length = np.diff(np.append(first, len(chars)))
    inside = np.arange(len(chars)) - np.repeat(first, length)
    h = np.add.reduceat(_BYTE[data[chars]] * powers(int(length.max()))[inside], first)
    owner = np.searchsorted(np.cumsum(sizes), at, side="right")
    return mix(h + length.astype(np.uint64)), np.bincount(owner, minlength=len(raw))


def shingle_sets(texts: list[str], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than k words are one shingle, no word gives none."""
    words, counts = word_hashes(texts)
    run = words[: max(0, len(words) - k + 1)].copy()
    for j in range(1, k):
        run = run * _Q + words[j : j + len(run)]
    run, out, at = mix(run), [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(distinct(run[at : at + n - k + 1]))
        elif n:
            with np.errstate(over="ignore"):
                out.append(mix(np.add.reduce(words[at : at + n] * powers(n)[:n], keepdims=True) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def minhash(shingles: np.ndarray, positions: int) -> np.ndarray:
    """The least value under each of `positions` hash functions."""
    a, out = multipliers(positions), np.empty(positions, np.uint64)
    step = max(1, CELLS // len(shingles))
    for t in range(0, positions, step):
        out[t : t + step] = (a[t : t + step, None] * shingles[None, :]).min(axis=1)
    return mix(out)


#: So many bins are tried for all holes at once; what is left then is filled row by row.
STEPS = 40


@lru_cache(maxsize=4)
def _orders(bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each bin an order of all bins, the place of each bin in it, and for each of STEPS how far away the next one is."""
    grid = mix(np.arange(1, bins * bins + 1, dtype=np.uint64) * _Q).reshape(bins, bins)
    order = grid.argsort(axis=1)
    return order, order.argsort(axis=1), np.ascontiguousarray((order - np.arange(bins)[:, None])[:, :STEPS].T)


def one_permutation(h: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """(sets, bins) of the hashes (32 bits) of many sets, one after the other, `counts` to a set; repeats do not matter.

    The least value in each bin; an empty bin takes that of the first filled one in its own fixed order of bins.
    """
    n = len(counts)
    out = np.full(n * bins, _EMPTY, np.uint32)
    place = np.repeat(np.arange(n, dtype=np.int64) * bins, counts)
    place += ((h >> np.uint32(16)) * np.uint32(bins)) >> np.uint32(16)
    np.minimum.at(out, place, h * np.uint32(0x9E3779B1))
    filled = out != _EMPTY
    some = filled.reshape(n, bins).any(axis=1)
    holes = np.flatnonzero(~filled & np.repeat(some, bins))
    order, rank, ahead = _orders(bins)
    cols = holes % bins
    for step in range(STEPS):
        if not len(holes):
            break
        source = holes + ahead[step].take(cols)
        hit = filled.take(source)
        out[holes[hit]] = mix32(out.take(source[hit]) + cols[hit].astype(np.uint32))
        left = np.flatnonzero(~hit)
        holes, cols = holes.take(left), cols.take(left)
    if len(holes):
        rows = holes // bins
        cuts = np.flatnonzero(np.diff(rows)) + 1
        for own, at in zip(np.split(cols, cuts), [0, *cuts.tolist()], strict=True):
            base = int(rows[at]) * bins
            have = np.flatnonzero(filled[base : base + bins])
            source = have[rank[own][:, have].argmin(axis=1)]
            out[base + own] = mix32(out[base + source] + own.astype(np.uint32))
    return out.reshape(n, bins)


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def sketches(signatures: np.ndarray) -> np.ndarray:
    """(sets, bins / 8) signed 64-bit numbers: a byte of each value of one_permutation."""
    return (mix32(signatures) >> np.uint32(24)).astype(np.uint8).view(np.int64)


def sketch(shingles: np.ndarray, positions: int = SKETCH) -> list[int]:
    """The sketch of one set of 64-bit hashes."""
    return sketches(one_permutation((shingles >> np.uint64(32)).astype(np.uint32), np.array([len(shingles)]), positions))[0].tolist()


def sketch_least(percent: int, positions: int = SKETCH) -> int:
    """Fewer bytes than that are equal for one pair in 100,000 of this similarity, and less."""
    share = percent / 100
    return math.floor(positions * share - 4.5 * math.sqrt(positions * share * (1 - share)))


def set_digest(shingles: np.ndarray) -> str:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest()
