"""Vectorised text helpers shared by the operators: Arrow slices, words, hashes, shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (splitmix64); works on a copy."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def spread(n: int, salt: int) -> np.ndarray:
    """n odd pseudo-random 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(salt)) | U64(1)


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row exclusive, bytes, row offsets): nulls count as empty; a slice holds one row or at most `limit` bytes."""
    values = batch.column(batch.schema.get_field_index(column))
    if values.null_count:
        values = values.fill_null("")
    values = values.cast(pa.large_string())
    if not len(values):
        return
    _, offs, data = values.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo, n = 0, len(values)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n of each."""
    if len(_POWERS.get("up", ())) < n:
        base = 0x9E3779B97F4A7C15 | 1
        size = max(n, SLICE_BYTES + 1)
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _POWERS[name] = p
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Prefix sums of table[byte] * base**position; length len(data) + 1."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(table[data] * up[:-1], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hash of each byte range; the range's length is mixed in."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def punctuation_table() -> np.ndarray:
    """White space and every other ASCII byte that is no letter or digit."""
    t = np.zeros(256, bool)
    t[:128] = [not chr(i).isalnum() for i in range(128)]
    return t


def word_spans(data: np.ndarray, offs: np.ndarray, between: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words of every row; a word never crosses a row. `between`: bytes that separate words."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~(space_table() if between is None else between)[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs[:-1]] = True
    first = first[: len(data)]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (first | ~before))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = word[1:] & ~first[1:]
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(data: np.ndarray, offs: np.ndarray, salt: int = 1, between: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of each word, A-Z lower-cased."""
    starts, ends, rows = word_spans(data, offs, between)
    table = spread(256, salt)[lower_table()]
    return range_hash(prefix_hash(data, table), starts, ends), rows, starts, ends


def shingles(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of distinct k-word shingles, sorted by row then hash; a row of 1..k-1 words is one shingle; none without words."""
    h, rows, _, _ = word_hashes(data, offs)
    n = len(offs) - 1
    c = spread(k, 77)
    counts = np.bincount(rows, minlength=n)
    out_r, out_h = [], []
    if len(h) >= k:
        m = len(h) - k + 1
        s = np.zeros(m, dtype=U64)
        for j in range(k):
            s += h[j : j + m] * c[j]
        ok = rows[:m] == rows[k - 1 :]
        out_r.append(rows[:m][ok])
        out_h.append(mix(s[ok]))
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.searchsorted(rows, short)
        s = counts[short].astype(U64) * U64(0xA24BAED4963EE407)
        for j in range(k - 1):
            has = counts[short] > j
            s[has] += h[first[has] + j] * c[j]
        out_r.append(short)
        out_h.append(mix(s))
    if not out_r:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    r, s = np.concatenate(out_r), np.concatenate(out_h)
    order = np.lexsort((s, r))
    r, s = r[order], s[order]
    keep = np.ones(len(r), bool)
    keep[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
    return r[keep], s[keep]


def binary_column(blob: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An Arrow binary array from concatenated bytes and cumulative ends (starting with 0)."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(blob, dtype=np.uint8))]).cast(pa.binary())


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + size)."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]
