"""Word shingles of whole texts as 64-bit hashes, a batch at a time in numpy.

Words are runs of bytes other than space and the controls 9 to 13; A-Z are lower-cased.
Words hash by a polynomial over their bytes, taken from prefix sums, and a finaliser;
shingles combine the hashes of their words.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
#: Bytes of text that are hashed at once.
STEP = 1 << 18
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; a worker keeps no more of them than ``STEP`` needs."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(n if n > 2 * STEP else 1 << (n - 1).bit_length(), base, np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= 2 * STEP:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(raw: bytes) -> np.ndarray:
    """The hash of each word of a text in UTF-8."""
    if len(raw) > STEP:  # cut at white space, so that no word is cut
        out, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + STEP)
            while end < len(raw) and not _WHITE[raw[end]]:
                end += 1
            out.append(_words(np.frombuffer(raw, np.uint8, end - at, at))[0])
            at = end
        return np.concatenate(out)
    return _words(np.frombuffer(raw, np.uint8))[0]


def words_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of some texts, one text after the other, and their number in each."""
    if sum(map(len, raws)) + len(raws) > STEP:
        own = [words(r) for r in raws]
        return np.concatenate(own), np.array([len(w) for w in own], np.int64)
    w, starts = _words(np.frombuffer(b" ".join(raws), np.uint8))
    stops = np.cumsum(np.array([len(r) + 1 for r in raws], np.int64))
    return w, np.diff(np.searchsorted(starts, stops), prepend=0)


def _words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words in some bytes."""
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ink = ~_WHITE[b]
    edge = np.flatnonzero(np.diff(ink, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _power(_P, len(b)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_P_INVERSE, len(b) + 1)[starts]), starts


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Per text its sorted distinct shingles of ``k`` words; the whole sequence as one
    where it has fewer words; none where it has no word."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(raws):
        end, size = at, 0
        while end < len(raws) and (end == at or size + len(raws[end]) < STEP // 4):
            size += len(raws[end]) + 1
            end += 1
        out.extend(_sets(raws[at:end], k))
        at = end
    return out


def _sets(raws: list[bytes], k: int) -> list[np.ndarray]:
    w, counts = words_of(raws)
    bounds = [0, *np.cumsum(counts).tolist()]
    factors = np.random.default_rng(4 + k).integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(w)
    if n >= k:
        s = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            s += w[i : n - k + 1 + i] * factors[i]
        s = mix(s)
    sets = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo >= k:
            own = np.sort(s[lo : hi - k + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif hi > lo:
            short = (w[lo:hi] * factors[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            sets.append(mix(np.array([short ^ np.uint64(0x5851F42D4C957F2D)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


_lines: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def signature(hashes: np.ndarray, k: int) -> np.ndarray:
    """``k`` min-hashes of a non-empty set, 32 bits each."""
    if k not in _lines:
        rng = np.random.default_rng(1000 + k)
        _lines[k] = (rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64))
    a, b = _lines[k]
    least = np.full(k, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(hashes), 512):
        np.minimum(least, (hashes[i : i + 512, None] * a + b).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """The size of the intersection of two sorted distinct arrays."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def similar(x: np.ndarray, y: np.ndarray, percent: int = 80) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = overlap(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)
