"""Words, shingles and MinHash signatures, as NumPy passes over Arrow batches.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the lower-cased text; everything else separates.
``WORD_BREAK`` says the same to Spark's and DuckDB's regular expressions. Texts are worked through in pieces of about ``PIECE`` bytes,
so memory does not follow the size of an Arrow batch or of one text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

WORD_BREAK = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
PIECE = 1 << 19
SIGNED = 1 << 17
SHINGLE = 5
THRESHOLD = 0.8

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = _U(0x9E3779B97F4A7C15)
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_PLACE = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_PERM = (_RNG.integers(0, 2**31, 512, dtype=np.uint32) * np.uint32(2) + np.uint32(1))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size in _POWERS:
        return _POWERS[size]
    both = tuple(np.cumprod(np.concatenate(([_U(1)], np.full(size - 1, x)))) for x in (_STEP, _U(pow(int(_STEP), -1, 2**64))))
    if size <= 4 * PIECE:  # those of longer texts are not worth keeping
        _POWERS[size] = both
    return both


def spans_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``[starts, ends)``: equal bytes, equal hash, wherever they stand."""
    up, down = _powers(len(raw))
    total = np.concatenate(([_U(0)], np.cumsum(_BYTE[raw] * up[: len(raw)])))
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _STEP)


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.concatenate(([False], _WORD[b], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return spans_hash(b, edge[::2], edge[1::2]), edge[::2]


def pieces(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about PIECE characters together."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        size = len(t) if t else 0
        if held and held + size > PIECE:
            yield at, i
            at, held = i, 0
        held += size + 1
    if at < len(texts):
        yield at, len(texts)


def lowered(texts: list) -> list[bytes]:
    return [(t or "").lower().encode("utf-8", "replace") for t in texts]


def _long_words(raw: bytes) -> np.ndarray:
    """Word hashes of one text longer than a piece, cut at spaces."""
    out, at = [], 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            cut = max(raw.rfind(b" ", at + 1, end), raw.rfind(b"\n", at + 1, end))
            if cut < 0:
                cut = next((x for x in (raw.find(b" ", end), raw.find(b"\n", end)) if x >= 0), len(raw))
            end = cut
        out.append(_word_hashes(raw[at:end])[0])
        at = end
    return np.concatenate(out)


def ascii_lowered(texts: list) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace").lower() for t in texts]


def words(texts: list, lower: Callable[[list], list[bytes]] = lowered) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, hashes, counts)``: word hashes of texts ``[first, last)`` one after the other, and how many each has."""
    for a, z in pieces(texts):
        raws = lower(texts[a:z])
        if z == a + 1 and len(raws[0]) > 4 * PIECE:
            h = _long_words(raws[0])
            yield a, z, h, np.array([len(h)])
            continue
        h, at = _word_hashes(b"\n".join(raws))
        ends = np.cumsum([len(r) + 1 for r in raws])
        yield a, z, h, np.diff(np.searchsorted(at, ends), prepend=0)


def shingles(h: np.ndarray, counts: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words, and how many each text has. A text of fewer than k words, but one at least, is one shingle."""
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    starts = np.cumsum(counts) - counts
    first = np.repeat(starts, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    room = np.repeat(np.minimum(counts, k), n)
    out = np.zeros(len(first), np.uint64)
    for j in range(k):
        there = np.minimum(first + j, max(len(h) - 1, 0))
        out += np.where(room > j, h[there] * _PLACE[j], _U(0)) if len(h) else out
    return mix(out + room.astype(np.uint64)), n


def distinct(s: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The sorted set of shingles of each text."""
    out = []
    for a, z in zip(np.cumsum(n) - n, np.cumsum(n)):
        x = np.sort(s[a:z])
        new = np.ones(len(x), bool)
        np.not_equal(x[1:], x[:-1], out=new[1:])
        out.append(x[new])
    return out


def signatures(s: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """MinHash values, one row for each text with shingles (``n > 0``), ``size`` columns of 32 bits."""
    some = n[n > 0]
    ends = np.cumsum(some)
    starts = ends - some
    x = (s >> _U(32)).astype(np.uint32)
    out = np.empty((len(some), size), np.uint32)
    first, room = 0, np.empty((2, 0), np.uint32)
    while first < len(some):  # about SIGNED shingles at a time, in work space that is used again
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + SIGNED, side="right")))
        part, at = x[starts[first] : ends[last - 1]], starts[first:last] - starts[first]
        if room.shape[1] < len(part):
            room = np.empty((2, max(SIGNED, len(part))), np.uint32)
        t, u = room[:, : len(part)]
        for k in range(size):
            np.multiply(part, _PERM[k], out=t)
            np.right_shift(t, np.uint32(15), out=u)
            t ^= u
            t *= np.uint32(0x2C1B3C6D)
            np.minimum.reduceat(t, at, out=out[first:last, k])
        first = last
    return out


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` values; the band's number is part of the key."""
    n, size = sig.shape
    out = np.zeros((n, size // rows), np.uint64)
    wide = sig[:, : size // rows * rows].reshape(n, -1, rows).astype(np.uint64)
    for j in range(rows):
        out = mix(out + wide[:, :, j] + _PLACE[j])
    return mix(out + np.arange(size // rows, dtype=np.uint64) * _STEP)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of shingles (sorted, distinct), as two signed longs."""
    with np.errstate(over="ignore"):
        a = mix(np.asarray([np.sum(mix(s + _PLACE[7])) + _U(len(s))], np.uint64))
        b = mix(np.asarray([np.sum(mix(s ^ _PLACE[9])) + _PLACE[8]], np.uint64))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])
