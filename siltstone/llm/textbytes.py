"""Whole texts as numpy arrays: slices of Arrow batches, words and hashed word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in slices of about so many bytes (a longer text is a slice of its own).
SLICE_BYTES = 1 << 19
#: Values hashed at a time.
PIECE = 1 << 19

_BASE, _SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if offsets is not None and offsets.size else np.zeros(n + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, kept: dict = {}) -> np.ndarray:  # noqa: B006
    """Powers 0 to PIECE of a base, modulo 2^64."""
    if base not in kept:
        p = np.full(PIECE + 1, base, np.uint64)
        p[0] = 1
        kept[base] = np.cumprod(p, dtype=np.uint64)
    return kept[base]


def word_spans(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of a slice of texts: 64-bit hashes, starts and ends in the slice, and each text's first
    word (n + 1 offsets). A long slice is gone through by pieces; words may cross them."""
    data, at = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    n = len(data)
    s, e = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in range(0, n, PIECE):
        q = min(n, p + PIECE)
        inner = np.zeros(q - p + 2, bool)  # with a byte on each side
        begin, end = max(0, p - 1), min(n, q + 1)
        inner[begin - p + 1 : end - p + 1] = ~_SPACE[data[begin:end]]
        text = np.zeros(q - p + 1, bool)
        lo, hi = np.searchsorted(at, [p, q + 1])
        text[at[lo:hi] - p] = True
        own = inner[1:-1]
        s.append(np.flatnonzero(own & (text[:-1] | ~inner[:-2])) + p)
        e.append(np.flatnonzero(own & (text[1:] | ~inner[2:])) + p + 1)
    s, e = np.concatenate(s), np.concatenate(e)
    return span_hashes(data, s, e, lower), s, e, np.searchsorted(s, at)


def _sums_before(data: np.ndarray, where: np.ndarray, lower: bool, base: int) -> np.ndarray:
    """For rising positions: the sum of all (value + 1) * base ** index before each."""
    rising = _powers(base)
    out = np.empty(len(where), np.uint64)
    total, shift = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for p in range(0, len(data) + 1, PIECE):
        part = data[p : p + PIECE]
        part = (_LOWER[part] if lower else part).astype(np.uint64)
        part += np.uint64(1)
        part *= rising[: len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        lo, hi = np.searchsorted(where, [p, p + PIECE])
        out[lo:hi] = total + shift * sums[where[lo:hi] - p]
        total, shift = total + shift * sums[-1:], shift * rising[PIECE:]
    return out


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = False, base: int = _BASE) -> np.ndarray:
    """64-bit hashes of the spans from ``s`` up to ``e``. A span hashes alike wherever it stands. Values
    are taken by pieces, so beyond ``data`` only arrays as long as ``s`` are made."""
    both = np.concatenate([s, e])
    by = np.argsort(both, kind="stable")
    before = np.empty(len(both), np.uint64)
    before[by] = _sums_before(data, both[by], lower, base)
    inside = before[len(s) :] - before[: len(s)]
    falling = _powers(pow(base, -1, 1 << 64))
    far = np.full(len(data) // PIECE + 1, falling[PIECE], np.uint64)
    far[0] = 1
    inside *= falling[s % PIECE]
    if len(far) > 1:
        inside *= np.cumprod(far, dtype=np.uint64)[s // PIECE]
    return mixed(inside + (e - s).astype(np.uint64))


#: Blocks of scripts written without spaces: Thai and Lao, Myanmar, Khmer, kana, Han and its further planes.
_UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF),
)


def unspaced(data: np.ndarray) -> np.ndarray:
    """Where the characters (by their first bytes) of scripts without spaces start."""
    out = np.zeros(len(data), bool)
    at = np.flatnonzero(data >= 0xE0)
    more = [np.append(data[k:], np.zeros(k, np.uint8))[at].astype(np.int64) & 0x3F for k in (1, 2, 3)]
    lead = data[at].astype(np.int64)
    code = ((lead & 0x0F) << 12) | (more[0] << 6) | more[1]
    code = np.where(lead >= 0xF0, ((lead & 0x07) << 18) | (more[0] << 12) | (more[1] << 6) | more[2], code)
    found = np.zeros(len(at), bool)
    for a, b in _UNSPACED:
        found |= (code >= a) & (code <= b)
    out[at] = found
    return out


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All lines (between newlines) of a slice of texts: two independent 64-bit hashes, numbers of words,
    and each text's first line (n + 1 offsets); an empty text has one empty line. A word with characters of
    scripts without spaces counts as that many words."""
    own, at = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    newline = np.flatnonzero(own == 10)
    order = np.argsort(np.concatenate([2 * at[1:], 2 * newline + 1]), kind="stable")
    e = np.concatenate([at[1:], newline])[order]
    by_newline = order >= len(at) - 1
    s = np.concatenate([[0], e[:-1] + by_newline[:-1]]) if len(e) else e
    first = np.concatenate([[0], np.flatnonzero(~by_newline) + 1])
    _, word, end, _ = word_spans(data, offsets)
    weight = np.ones(len(word), np.int64)
    if (own >= 0xE0).any():
        characters = np.concatenate([[0], np.cumsum(unspaced(own))])
        weight = np.maximum(weight, characters[end] - characters[word])
    sums = np.concatenate([[0], np.cumsum(weight)])
    count = sums[np.searchsorted(word, e)] - sums[np.searchsorted(word, s)]
    return span_hashes(own, s, e), span_hashes(own, s, e, base=_SECOND), count, first


_TAKE = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles, end to end, and n + 1 offsets.

    A text of fewer than k words has its whole sequence as one shingle; one without words has none.
    """
    hashes, _, _, at = word_spans(data, offsets, lower=True)
    n = len(hashes)
    grams = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        grams += hashes[i : i + len(grams)] * _TAKE[i % len(_TAKE)] ** np.uint64(1 + i // len(_TAKE))
    grams = mixed(grams)
    out, sizes = [], np.zeros(len(at), np.int64)
    for t in range(len(at) - 1):
        a, b = at[t], at[t + 1]
        if b - a >= k:
            own = np.sort(grams[a : b - k + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        elif b > a:
            short = np.array([b - a], np.uint64)
            for i in range(b - a):
                short += hashes[a + i : a + i + 1] * _TAKE[i % len(_TAKE)]
            own = mixed(short)
        else:
            own = grams[:0]
        out.append(own)
        sizes[t + 1] = len(own)
    return (np.concatenate(out) if out else grams[:0]), np.cumsum(sizes)
