"""Words and word-sequence hashes of Arrow text columns, vectorised over bytes.

A-Z are read as a-z. Two word classes exist: ``SPACED`` takes runs of bytes other than 0x20 and 0x09-0x0D,
``ALNUM`` runs of 0-9, a-z and bytes from 0x80. UTF-8 keeps its multi-byte letters at 0x80 and above, so
both give the words of the matching patterns over characters. Words are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are split at a time.
CHUNK = 1 << 20

_byte = np.arange(256)
SPACED = ~((_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D)))
_fold = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 0x20, _byte)
ALNUM = ((_fold >= 0x30) & (_fold <= 0x39)) | ((_fold >= 0x61) & (_fold <= 0x7A)) | (_byte >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_LETTERS = mix((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))[_fold]
_BASE = 0x5851F42D4C957F2D
_MASK = (1 << 64) - 1
_STEP = np.uint64(0x2545F4914F6CDD1D)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << 16)
        _tables[:] = [_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)]
    return _tables[0], _tables[1]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its n + 1 offsets; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about ``limit`` bytes, one row at least."""
    data, offsets = text_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _split(data: np.ndarray, breaks: np.ndarray, kind: np.ndarray, hashed: bool):
    inside = kind[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    breaks = breaks[(breaks > 0) & (breaks < len(data))]
    begins[breaks] = inside[breaks]
    ends[breaks - 1] = inside[breaks - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not hashed:
        return starts, stops, None
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * power[: len(data)], out=sums[1:])
    return starts, stops, mix((sums[stops] - sums[starts]) * inverse[starts] + np.uint64(1))


def split_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, limit: int = 2 * CHUNK):
    """(starts, ends, hashes, words per row) of the words in ``data``."""
    if len(data) <= limit:
        starts, stops, hashes = _split(data, offsets[1:-1], kind, True)
    else:  # one very long text: cut where no word is cut
        parts, at = [], 0
        while at < len(data):
            end = min(len(data), at + limit)
            while end < len(data):
                gaps = np.flatnonzero(~kind[data[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                    break
                end = min(len(data), end + limit)
            inner = offsets[(offsets > at) & (offsets < end)] - at
            s, e, h = _split(data[at:end], inner, kind, True)
            parts.append((s + at, e + at, h))
            at = end
        starts, stops, hashes = (np.concatenate(x) for x in zip(*parts))
    edges = np.searchsorted(starts, offsets)
    return starts, stops, hashes, np.diff(edges)


def sequences(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words (runs over row ends too; mask them with ``inside``)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out *= _STEP
        out += words[k : len(words) - n + 1 + k]
    return mix(out + np.uint64(n))


def inside(counts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of the ``size`` runs of ``n`` words lie in one row."""
    ends = np.repeat(np.cumsum(counts), counts)[:size]
    return np.arange(size) + n <= ends


def rows_of(counts: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(counts)), counts)


def shingle_sets(words: np.ndarray, counts: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's ``n``-word runs; a row of fewer words, but not none, has its whole
    sequence as one."""
    runs = sequences(words, n)
    edges = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for k, c in enumerate(counts):
        a = edges[k]
        if c >= n:
            own = np.sort(runs[a : a + c - n + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own)
        elif c:
            out.append(sequences(words[a : a + c], int(c)))
        else:
            out.append(runs[:0])
    return out
