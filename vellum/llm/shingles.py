"""Sets of hashed word shingles of whole texts, computed for many texts at once with numpy."""

from __future__ import annotations

import numpy as np

WIDTH, HASH_BITS = 5, 48
#: Bytes of text hashed at once; bounds memory, without effect on results.
BLOCK = 1 << 20

_random = np.random.default_rng(5_077)
_LETTER = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _c in range(65, 91):  # A-Z count as a-z
    _LETTER[_c] = _LETTER[_c + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _random.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[i] = np.cumprod(factors, dtype=np.uint64)
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and 64-bit hashes of the words of some bytes."""
    codes = np.frombuffer(data, np.uint8)
    space = np.concatenate([[True], _SPACE[codes], [True]])
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    up, down = _power_tables(len(codes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[codes] * up[: len(codes)], dtype=np.uint64)])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _long_words(data: bytes) -> np.ndarray:
    """Word hashes of a very long text, in pieces cut at white space."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        out.append(word_hashes(data[at:end])[1])
        at = end
    return np.concatenate(out)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (text number << 48 | shingle hash), sorted and distinct, and each text's set size.

    At most 65,536 texts. A text of fewer than five words has its whole sequence as one shingle.
    """
    keys = []
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= BLOCK):
            size += len(texts[upto]) + 1
            upto += 1
        part = texts[at:upto]
        if len(part) == 1:
            words = _long_words(part[0])
            owner = np.zeros(len(words), np.int64)
        else:
            starts, words = word_hashes(b"\n".join(part))
            offsets = np.cumsum([0] + [len(t) + 1 for t in part[:-1]])
            owner = np.searchsorted(offsets, starts, "right") - 1
        n = np.bincount(owner, minlength=len(part))
        if len(words) >= WIDTH:
            last = len(words) - WIDTH + 1
            h = words[:last] * _PLACE[0]
            for j in range(1, WIDTH):
                h = h + words[j : last + j] * _PLACE[j]
            whole = owner[:last] == owner[WIDTH - 1 :]
            keys.append(_keys(owner[:last][whole] + at, mix(h[whole])))
        short = np.flatnonzero((n > 0) & (n < WIDTH))
        first = np.cumsum(n) - n
        if len(short):
            sums = [(words[first[i] : first[i] + n[i]] * _PLACE[: n[i]]).sum(dtype=np.uint64) for i in short]
            keys.append(_keys(short + at, mix(np.array(sums, np.uint64), 0x5BD1E995) ^ n[short].astype(np.uint64)))
        at = upto
    found = distinct(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    return found, np.bincount((found >> np.uint64(HASH_BITS)).astype(np.int64), minlength=len(texts))


def _keys(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    return owner.astype(np.uint64) << np.uint64(HASH_BITS) | h >> np.uint64(64 - HASH_BITS)


def signatures(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each set's mixed hashes: equal for equal sets."""
    out = np.zeros((len(sizes), 2), np.uint64)
    h = keys & np.uint64((1 << HASH_BITS) - 1)
    some = np.flatnonzero(sizes)
    if len(some):
        first = (np.cumsum(sizes) - sizes)[some]
        for i, salt in enumerate((0x1F3D5B79, 0x2545F491)):
            out[some, i] = np.add.reduceat(mix(h, salt), first)
    return out.view(np.int64)
