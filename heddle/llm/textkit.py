"""Vectorised tokenising of Arrow string columns: words as 64-bit hashes, without a Python object per word.

Two word rules, both after lower-casing A-Z:

* ``space``: maximal runs of bytes other than 0x20 and 0x09-0x0D;
* ``alnum``: maximal runs of digits, a-z and all non-ASCII characters.

Bytes above 0x7F are word bytes in both, so working on UTF-8 bytes gives the same words as on characters.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = {"space": np.ones(256, bool), "alnum": np.zeros(256, bool)}
_WORD["space"][[0x20, *range(0x09, 0x0E)]] = False
_WORD["alnum"][48:58] = _WORD["alnum"][97:123] = _WORD["alnum"][128:] = True

_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
CHUNK = 1 << 20
SLICE = 2 << 20  # bytes of text handled at once where results do not depend on it


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix): spreads every input bit over the whole word."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _powers(n: int, cache: list = [np.ones(1, np.uint64)]) -> np.ndarray:  # noqa: B006
    while len(cache[0]) < n:
        p = cache[0]
        with np.errstate(over="ignore"):
            cache[0] = np.concatenate([p, p * (p[-1] * _BASE)])
    return cache[0]


def _buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n+1) and bytes of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, off, data = col.buffers()
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def _pieces(offsets: np.ndarray, raw: np.ndarray, rule: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cut the byte stream between words, near every CHUNK bytes: (hashes, starts, ends) of each piece."""
    n, pos = len(raw), 0
    while pos < n:
        span = CHUNK
        while True:
            end = min(n, pos + span)
            low = _LOWER[raw[pos:end]]
            word = rule[low]
            if end == n:
                break
            gaps = np.flatnonzero(~word)
            inner = offsets[np.searchsorted(offsets, end, "right") - 1]
            cut = max(pos + (int(gaps[-1]) + 1 if len(gaps) else 0), int(inner))
            if cut > pos:
                end = cut
                low, word = low[: end - pos], word[: end - pos]
                break
            span *= 2
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        lo, hi = np.searchsorted(offsets, [pos, end])
        edge = offsets[lo : hi + 1]
        edge = edge[(edge > pos) & (edge < end)] - pos
        first[edge] = word[edge]
        last[edge - 1] = word[edge - 1]
        starts = np.flatnonzero(first)
        if len(starts):
            ends = np.flatnonzero(last) + 1
            lens = ends - starts
            chars = low[word]
            heads = np.cumsum(lens) - lens
            with np.errstate(over="ignore"):
                power = _powers(int(lens.max()))[np.arange(len(chars)) - np.repeat(heads, lens)]
                h = mix(np.add.reduceat(_TABLE[chars] * power, heads) + lens.astype(np.uint64))
            yield h, starts + pos, ends + pos
        pos = end


def words(col: pa.Array, rule: str = "space", places: bool = False):
    """(hashes of all words, words before each document (n+1)); with places also byte starts, ends and the raw bytes."""
    offsets, raw = _buffers(col)
    parts = list(_pieces(offsets, raw, _WORD[rule]))
    join = lambda i, kind: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind)
    hashes, starts = join(0, np.uint64), join(1, np.int64)
    bounds = np.searchsorted(starts, offsets)
    return (hashes, bounds, starts, join(2, np.int64), raw) if places else (hashes, bounds)


def hash_words(texts: list[str], rule: str = "space") -> list[np.ndarray]:
    h, b = words(pa.array(texts, pa.string()), rule)
    return [h[b[i] : b[i + 1]] for i in range(len(texts))]


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and what they hold counts as their executor's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def docs_in_batch(batches, text: str, budget: int = 8 << 20):
    """Split Arrow batches so that the texts of a slice hold about ``budget`` bytes at most (one text may hold more)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        offsets, _ = _buffers(col)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + budget, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
        del batch, col, offsets
        give_back()
