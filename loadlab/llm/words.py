"""Words and word shingles of Arrow text batches, hashed with numpy.

A word is a run of bytes that are no separators.  Its hash depends on its bytes
alone; a text is worked through in pieces of ``PIECE`` bytes, so memory beyond
the words themselves does not grow with the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Blanks and every ASCII sign that is neither letter nor digit.
_SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and its inverse modulo 2 ** 64 for ``i < n``."""
    tables = []
    for step in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, step, dtype=np.uint64)
        steps[0] = 1
        tables.append(np.cumprod(steps, dtype=np.uint64))
    return tables[0], tables[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Words:
    """Words of ``n`` texts: of text ``i`` those from ``first[i]`` to ``first[i + 1]``.

    ``start`` and ``end`` are byte offsets within ``data``; ``origin[i]`` is
    where text ``i`` begins there.
    """

    n: int
    data: np.ndarray
    origin: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.first))


def lowered(texts: pa.Array, ascii_only: bool = False) -> pa.Array:
    """Lower case, NULL as the empty text.  ``ascii_only``: A-Z and nothing else."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    # Lower before anything else: a cast slice keeps its offsets, which ascii_lower then reads wrongly.
    texts = pc.ascii_lower(texts) if ascii_only else pc.utf8_lower(texts)
    return pc.fill_null(texts.cast(pa.large_string()), "")


def split_words(texts: pa.Array, signs: bool = False, hashes: bool = True) -> Words:
    """Words of a large_string array without NULLs.

    Separators are space and 0x09-0x0D; with ``signs`` also every other ASCII
    character that is neither letter nor digit.
    """
    n = len(texts)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    data, origin = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
    table = _SIGNS if signs else _SPACE
    starts, ends, found = [], [], []
    at, size = 0, len(data)
    while at < size:
        stop = at + PIECE
        while stop < size:  # cut where no word runs on: after a separator or at a text's end
            gap = np.flatnonzero(table[data[max(at, stop - 4096) : stop]])
            if len(gap):
                stop = max(at, stop - 4096) + int(gap[-1]) + 1
                break
            following = int(origin[np.searchsorted(origin, stop)])
            gap = np.flatnonzero(table[data[stop : min(following, stop + PIECE)]])
            if len(gap) or following <= stop + PIECE:
                stop = stop + int(gap[0]) + 1 if len(gap) else following
                break
            stop += PIECE
        stop = min(stop, size)
        piece = data[at:stop]
        part = ~table[piece]
        before = np.empty(len(piece), dtype=bool)
        before[0], before[1:] = True, ~part[:-1]
        after = np.empty(len(piece), dtype=bool)
        after[-1], after[:-1] = True, ~part[1:]
        edges = origin[np.searchsorted(origin, at) : np.searchsorted(origin, stop)] - at
        before[edges] = True
        after[edges[edges > 0] - 1] = True
        s = np.flatnonzero(part & before)
        e = np.flatnonzero(part & after) + 1
        if hashes:
            up, down = powers(1 << max(len(piece), PIECE).bit_length())
            total = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum(_BYTES[piece] * up[: len(piece)], out=total[1:])
            found.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    none = np.zeros(0, dtype=np.int64)
    start = np.concatenate(starts) if starts else none
    end = np.concatenate(ends) if ends else none
    hash = np.concatenate(found) if found else none.astype(np.uint64)
    return Words(n, data, origin, start, end, hash, np.searchsorted(start, origin))


def shingles(hash: np.ndarray, first: np.ndarray, width: int, whole_if_short: bool = True):
    """Hashes of ``width`` consecutive words and the row each belongs to, in text order.

    A text with fewer words, but at least one, has its whole sequence as its one
    shingle if ``whole_if_short``; sequences of different length never hash alike on purpose.
    """
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    n = len(hash)

    def of(at: np.ndarray, w: int) -> np.ndarray:
        h = np.full(len(at), w, dtype=np.uint64)
        for j in range(w):
            h = h * np.uint64(0xD6E8FEB86659FD93) + hash[at + j]
        return mix(h)

    at = np.arange(max(0, n - width + 1))
    at = at[row[at] == row[at + width - 1]] if len(at) else at
    out, rows = of(at, width), row[at]
    if whole_if_short:
        parts, owners = [out], [rows]
        for w in range(1, width):
            short = np.flatnonzero(counts == w)
            if len(short):
                parts.append(of(first[short], w))
                owners.append(short)
        if len(parts) > 1:
            out, rows = np.concatenate(parts), np.concatenate(owners)
            order = np.argsort(rows, kind="stable")
            out, rows = out[order], rows[order]
    return out, rows


def distinct_per_row(hash: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, and where each row's begin (``n + 1`` places)."""
    cut = np.searchsorted(row, np.arange(n + 1))
    sets = []
    for i in range(n):
        own = np.sort(hash[cut[i] : cut[i + 1]])
        if len(own) > 1:
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        sets.append(own)
    first = np.zeros(n + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=first[1:])
    return (np.concatenate(sets) if sets else hash[:0]), first


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most_bytes`` of text, at least one row each."""
    column = batch.column(text)
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    total = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, base + most_bytes, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
