"""Vectorised word handling shared by the text operators.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text (``bytes.split`` cuts at
exactly these six bytes).  A word's hash is a polynomial over random byte
values modulo 2**64, finished by an avalanche step; it depends on the word's
bytes alone, so it is equal on every executor.  Work goes block by block, so
temporary arrays stay near ``BLOCK`` bytes times eight whatever the batch is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240401))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}
_LOWER = bytes(range(65, 91)), bytes(range(97, 123))
TO_LOWER = bytes.maketrans(*_LOWER)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. n, kept between calls."""
    held = _powers.get(int(base))
    if held is None or len(held) <= n:
        steps = np.full(max(n, BLOCK + (1 << 17)) + 2, base, np.uint64)
        steps[0] = 1
        held = _powers[int(base)] = np.multiply.accumulate(steps)
    return held


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finishing step."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hash_buffer(buf: bytes) -> np.ndarray:
    """Hashes of the words of buf: each word is followed by one space."""
    a = np.frombuffer(buf, np.uint8)
    ends = np.flatnonzero(a == 32)
    if not len(ends):
        return np.empty(0, np.uint64)
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    n = len(a)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[a] * powers(_BASE, n)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, n)[starts])  # as if the word stood at 0


def split(text: bytes | None, lower: bool) -> list[bytes]:
    if not text:
        return []
    return (text.translate(TO_LOWER) if lower else text).split()


def hash_words(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each document."""
    counts = np.fromiter((len(w) for w in docs), np.int64, len(docs))
    parts, hold, size = [], [], 0

    def flush() -> None:
        nonlocal hold, size
        if hold:
            parts.append(_hash_buffer(b" ".join(hold) + b" "))
        hold, size = [], 0

    for w in docs:
        for at in range(0, len(w), 1 << 16):
            piece = b" ".join(w[at : at + (1 << 16)])
            hold.append(piece)
            size += len(piece)
            if size >= BLOCK:
                flush()
    flush()
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), counts


def ngrams(h: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of n words; position i covers i .. i + n - 1 (the caller masks ends of documents)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    r = np.uint64((0xD1342543DE82EF95 * (2 * seed + 1)) % (1 << 64) | 1)
    out = h[:m].copy()
    for k in range(1, n):
        out *= r
        out += h[k : k + m]
    return mix(out)


def inside(counts: np.ndarray, n: int) -> np.ndarray:
    """Positions, in the concatenated words, at which a window of n words of one document starts."""
    total = int(counts.sum())
    if total < n:
        return np.empty(0, np.int64)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(total)
    return np.flatnonzero(left >= n)


def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + n[0] - 1, start[1] .. and so on."""
    ends = np.cumsum(n, dtype=np.int32)
    out = np.repeat(start - (ends - n), n)
    out += np.arange(len(out), dtype=np.int32)
    return out


def binaries(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def as_ids(ids: list[int | None], absent: int = -(1 << 63)) -> np.ndarray:
    """ids as an array; absent stands for null."""
    return np.array([absent if i is None else i for i in ids], np.int64)


def blocks(batches: Iterator[pa.RecordBatch], key: str | tuple[str, ...], text: str, size: int = 1 << 20, rows: int = 1024) -> Iterator[tuple[list, list[bytes | None]]]:
    """(keys, texts) of `size` bytes and `rows` rows at most, or one longer text; null texts stay null.  Several key columns give tuples."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            some = batch.slice(start, rows)
            part = some.column(key).to_pylist() if isinstance(key, str) else list(zip(*(some.column(k).to_pylist() for k in key), strict=True))
            texts = binaries(some.column(text))
            at, held = 0, 0
            for i, t in enumerate(texts):
                held += len(t or b"")
                if held >= size:
                    yield part[at : i + 1], texts[at : i + 1]
                    at, held = i + 1, 0
            if at < len(part):
                yield part[at:], texts[at:]
