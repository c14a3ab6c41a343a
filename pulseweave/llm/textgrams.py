"""N-grams of texts as numbers, a batch at a time: hashed character n-grams and word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken together up to so many characters; longer ones are gone through in windows of this size.
WINDOW = 1 << 18
ORDERS = (1, 2, 3)


def slices(sizes: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` in size (or one row) and at most ``rows`` rows."""
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        end = min(max(at + 1, int(np.searchsorted(ends, before + most, side="right"))), at + rows)
        yield at, end
        at = end


def _hashes(points: np.ndarray, order: int) -> np.ndarray:
    n = len(points) - order + 1
    h = np.full(n, (order * 0x9E3779B1) & 0xFFFFFFFF, dtype=np.uint32)
    for k in range(order):
        h = (h ^ points[k : k + n]) * np.uint32((0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)[k % 4])
        h ^= h >> np.uint32(15)
    return h * np.uint32(0x2C1B3C6D) >> np.uint32(8)


def char_counts(texts: list[str], dims: int, orders: tuple[int, ...] = ORDERS, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of all hashed character n-grams of whole texts, by row and feature.

    A text's end counts as a character.  ``dims`` is a power of two.
    """
    if lower:
        texts = [t.lower() for t in texts]
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    points = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    total = None
    most = max(orders)
    for a in range(0, len(points), WINDOW):
        part, own = points[a : a + WINDOW + most - 1], owner[a : a + WINDOW + most - 1]
        keys = []
        for order in orders:
            n = min(WINDOW, len(part) - order + 1)
            if n > 0:
                key = own[:n] * dims + (_hashes(part, order)[:n] & np.uint32(dims - 1))
                keys.append(key if order == 1 else key[own[:n] == own[order - 1 : order - 1 + n]])
        found = np.bincount(np.concatenate(keys), minlength=len(texts) * dims)
        total = found if total is None else total + found
    if total is None:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(total)
    return at // dims, at % dims, total[at]


def tf_idf(rows: np.ndarray, counts: np.ndarray, idf: np.ndarray, n_rows: int) -> np.ndarray:
    """(1 + ln count) * idf, each row brought to length 1."""
    w = (1.0 + np.log(counts)) * idf
    norm = np.sqrt(np.bincount(rows, weights=w * w, minlength=n_rows))
    return w / np.maximum(norm[rows], 1e-12)


def text_batches(column: pa.Array, rows: int = 32) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of a string column, nulls as empty texts, of about WINDOW bytes."""
    sizes = np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64)
    for a, b in slices(sizes, WINDOW, rows):
        yield a, b, [t or "" for t in column.slice(a, b - a).to_pylist()]


# --- word shingles -----------------------------------------------------------

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _rng.integers(1, 1 << 63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BYTES = 1 << 19


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie one behind the other, and each word's text.

    ``ends`` has the end of each text in ``data``.  A-Z count as a-z; words
    are runs of bytes other than ASCII white space.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(n, dtype=bool)
    first[0] = True
    first[ends[ends < n]] = True
    begins = inside.copy()
    begins[1:] &= first[1:] | ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= first[1:] | ~inside[1:]
    s, e = np.flatnonzero(begins), np.flatnonzero(stops)
    power, inverse = _power(n)
    run = np.cumsum(_BYTE[data] * power, dtype=np.uint64)
    h = run[e]
    h[s > 0] -= run[s[s > 0] - 1]
    return mix64(h * inverse[s] + (e - s).astype(np.uint64)), np.searchsorted(ends, s, side="right")


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For ranges of a string column: (first row, shingle hashes, row ends in them); each row's are distinct and rising.

    A text of fewer than ``width`` words has its whole sequence as one shingle; one without words, or null, has none.
    """
    column = column.cast(pa.large_binary()).fill_null(b"") if not pa.types.is_large_binary(column.type) else column.fill_null(b"")
    sizes = np.asarray(pc.binary_length(column), dtype=np.int64)
    for a, b in slices(sizes, BYTES, 1024):
        part = column.slice(a, b - a)
        offsets = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        ends = offsets[1:] - offsets[0]
        words, owner = _long_words(data) if b - a == 1 and len(data) > BYTES else word_hashes(data, ends)
        n = len(words) - width + 1
        if n > 0:
            h = np.zeros(n, dtype=np.uint64)
            for k in range(width):
                h += mix64(words[k : k + n] + np.uint64(k)) * _PLACE[k % 5]
            full = owner[:n] == owner[width - 1 : width - 1 + n]
            h, own = mix64(h[full]), owner[:n][full]
        else:
            h, own = np.empty(0, np.uint64), np.empty(0, np.int64)
        counts = np.bincount(owner, minlength=b - a)
        got = np.searchsorted(own, np.arange(b - a + 1))
        starts = np.concatenate(([0], np.cumsum(counts)))
        sets = []
        for i in range(b - a):
            if counts[i] >= width:
                x = np.sort(h[got[i] : got[i + 1]])
                keep = np.ones(len(x), dtype=bool)
                keep[1:] = x[1:] != x[:-1]
                sets.append(x[keep])
            elif counts[i]:
                few = words[starts[i] : starts[i + 1]]
                x = np.array([counts[i]], dtype=np.uint64)
                for k, w in enumerate(few):
                    x = x + mix64(np.array([w], np.uint64) + np.uint64(k + 101)) * _PLACE[k % 5]
                sets.append(mix64(x))
            else:
                sets.append(few_none)
        yield a, np.concatenate(sets) if sets else few_none, np.cumsum([len(x) for x in sets])


few_none = np.empty(0, np.uint64)


def _long_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of one very long text, in parts that end at white space where there is any."""
    out, at = [], 0
    while at < len(data):
        end = min(at + BYTES, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            gap = np.flatnonzero(_SPACE[data[end : end + BYTES]])
            end = end + int(gap[0]) if len(gap) else min(end + BYTES, len(data))
        out.append(word_hashes(data[at:end], np.array([end - at]))[0])
        at = end
    words = np.concatenate(out) if out else few_none
    return words, np.zeros(len(words), dtype=np.int64)
