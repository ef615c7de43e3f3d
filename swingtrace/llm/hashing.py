"""Numpy helpers on bytes: word and shingle hashes of many texts at once."""

from __future__ import annotations

import numpy as np

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(33)


def salt(j: int) -> np.uint64:
    return np.uint64(j * int(GOLDEN) % 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes: every input bit reaches every output bit."""
    x = x ^ (x >> SHIFT)
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> SHIFT)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> SHIFT)


def _byte_values() -> np.ndarray:
    """A random 64-bit value for each byte; A-Z count as a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
    values[65:91] = values[97:123]
    return values


BYTE_VALUE = _byte_values()
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
MULTIPLIER = np.uint64(0x2545F4914F6CDD1D)


def powers(n: int) -> np.ndarray:
    out = np.full(max(1, n), MULTIPLIER, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without white space, A-Z lower-cased) of all texts, and words per text."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    solid = np.flatnonzero(~IS_SPACE[buf])
    if not len(solid):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.empty(len(solid), bool)
    first[0] = True
    np.not_equal(np.diff(solid), 1, out=first[1:])
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(solid)))
    within = np.arange(len(solid)) - np.repeat(starts, lengths)
    values = BYTE_VALUE[buf[solid]] * powers(int(lengths.max()))[within]
    hashes = mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64) * GOLDEN)
    per_text = np.bincount(np.searchsorted(ends, solid[starts], side="right"), minlength=len(texts))
    return hashes, per_text


def shingle_places(texts: list[bytes], k: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Hashes of all words; per text the sorted distinct hashes of its k-word shingles; and the word at which each first stands.

    Fewer words make one shingle, none make none.
    """
    hashes, per_text = word_hashes(texts)
    sets, places, at = [], [], 0
    n = len(hashes) - k + 1
    rolled = np.zeros(max(0, n), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            rolled += mix(hashes[j : j + max(0, n)] + salt(j + 1))
        rolled = mix(rolled)
        for count in per_text.tolist():
            if count >= k:
                own, first = np.unique(rolled[at : at + count - k + 1], return_index=True)
            elif count:
                all_words = hashes[at : at + count]
                own = mix((mix(all_words + np.arange(1, count + 1, dtype=np.uint64) * GOLDEN)).sum(keepdims=True) ^ np.uint64(count))
                first = np.zeros(1, np.int64)
            else:
                own, first = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            sets.append(own)
            places.append(first + at)
            at += count
    return hashes, sets, places


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles."""
    return shingle_places(texts, k)[1]


def set_key(values: np.ndarray) -> bytes:
    """128 bits that depend on the set alone."""
    a = mix(values).sum(dtype=np.uint64)
    b = mix(values ^ GOLDEN).sum(dtype=np.uint64)
    return a.tobytes() + (b ^ mix(np.array([len(values)], np.uint64))[0]).tobytes()


def batches(iterator, most: int, column: str = "text"):
    """Slices of Arrow batches with `most` bytes of text or one row, so that a task's memory is bounded by its longest text."""
    for batch in iterator:
        texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
        raw = [t.encode("utf-8", "surrogatepass") if t is not None else b"" for t in texts]
        start = size = 0
        for i, t in enumerate(raw):
            if i > start and size + len(t) > most:
                yield batch.slice(start, i - start), raw[start:i]
                start, size = i, 0
            size += len(t)
        if len(raw) > start:
            yield batch.slice(start), raw[start:]
