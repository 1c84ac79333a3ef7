"""Words, word hashes and Arrow batches shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

ODD = np.uint64(0x9E3779B97F4A7C15)
MEMO = 250_000
#: Bytes that separate words.
BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def raw(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def longs(column: pa.Array) -> np.ndarray:
    """A column of longs without nulls."""
    return np.asarray(column.cast(pa.int64()).to_numpy(zero_copy_only=False), dtype=np.int64)


class WordHash(dict):
    """64-bit hash of a word, remembered; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hash_words(texts: list[bytes], hashes: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """`hashes.of` the words of all texts, A-Z lower-cased, and how many words each text has: XXH64 of all words of a length together, `hashes` for those of 32 bytes and more."""
    data = np.frombuffer(b" " + b" ".join(texts).lower() + b" " * 8, np.uint8)
    blank = BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = np.zeros(len(starts), np.uint64)
    for n in range(1, 32):
        mine = np.flatnonzero(size == n)
        at, h = starts[mine], np.full(len(mine), int(P5) + n, np.uint64)
        for _ in range(n // 8):
            h = _turn(h ^ _turn(eight[at] * P2, 31) * P1, 27) * P1 + P4
            at = at + 8
        if n % 8 >= 4:
            h = _turn(h ^ (eight[at] & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3
            at = at + 4
        for _ in range(n % 4):
            h = _turn(h ^ data[at] * P5, 11) * P1
            at = at + 1
        h = (h ^ h >> np.uint64(33)) * P2
        h = (h ^ h >> np.uint64(29)) * P3
        out[mine] = h ^ h >> np.uint64(32)
    long = np.flatnonzero(size >= 32)
    out[long] = hashes.of([data[a : a + n].tobytes() for a, n in zip(starts[long].tolist(), size[long].tolist())])
    return out, np.diff(np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)])))


def grams(words: np.ndarray, size: int, base: int = int(ODD)) -> np.ndarray:
    """Hash of every run of `size` consecutive word hashes, by doubling the run length."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, power, span = None, 0, words, 1
    factor, shift, left = np.array([base], np.uint64), np.ones(1, np.uint64), size
    while left:
        if left & 1:
            part = power[have : have + n] if have else power[:n]
            out = part.copy() if out is None else out + part * shift
            shift = shift * factor
            have += span
        left >>= 1
        if left:
            power = power[:-span] + power[span:] * factor
            factor = factor * factor
            span *= 2
    return mix(out)


def slide(x: np.ndarray, size: int, pick: Callable) -> np.ndarray:
    """Smallest or largest of every `size` neighbours (`pick` is np.minimum or np.maximum)."""
    n = len(x) - size + 1
    out, have = x[:n].copy(), 1
    for k in range(have, size):
        pick(out, x[k : k + n], out=out)
    return out


def batches(rows: Iterable[dict[str, list]], schema: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches from dictionaries of columns, cut to `most` rows."""
    for columns in rows:
        batch = pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)
