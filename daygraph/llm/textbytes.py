"""Words of Arrow texts as 64-bit hashes, computed on the UTF-8 bytes with numpy.

Separators are ASCII, so bytes can be classified without decoding; A-Z count as
a-z. A word's hash is a sum of byte values times powers of an odd base, mixed
once more; equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at a time; a longer text is a piece of its own.
PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(separators) -> np.ndarray:
    """A value per byte; 0 marks a separator, upper case has the value of lower case."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _BASE) | np.uint64(1)
    values[65:91] = values[97:123]
    values[np.array(list(separators), dtype=int)] = 0
    return values


#: Words are runs without a blank.
BLANK = byte_values([0x20, *range(0x09, 0x0E)])
#: Words are runs of digits, letters and bytes from 128.
PLAIN = byte_values([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """The texts as one array, null read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return pc.fill_null(column.cast(pa.large_string()), "")


def hash_words(data: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the place of its first word (with the end as last entry)."""
    v = values[data]
    word = v != 0
    start = word.copy()
    start[1:] &= ~word[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    start[cut] = word[cut]
    places = np.flatnonzero(start)
    if not len(places):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    length = np.diff(np.append(places, len(data)))
    within = np.arange(places[0], len(data)) - np.repeat(places, length)
    powers = np.cumprod(np.full(int(length.max()), _BASE, np.uint64))
    hashes = np.add.reduceat(v[places[0] :] * powers[within], places - places[0])
    return mix(hashes), np.searchsorted(places, offsets)


def runs(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """First and end of runs of whole texts of about ``size`` bytes; a longer text is a run of its own."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to
        at = to


def pieces(texts: pa.LargeStringArray, values: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, word hashes, word offsets) for runs of whole texts of about ``size`` bytes."""
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for at, to in runs(offsets, size):
        # Hashing takes some fifty bytes per byte of text, so it goes by PIECE however large the runs are.
        hashes, firsts, n = [], [np.zeros(1, np.int64)], 0
        for a, b in runs(offsets[at : to + 1], PIECE):
            a, b = at + a, at + b
            found, first = hash_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], values)
            hashes.append(found)
            firsts.append(first[1:] + n)
            n += len(found)
        yield at, np.concatenate(hashes), np.concatenate(firsts)


_ROLE = mix(np.arange(101, 133, dtype=np.uint64)) | np.uint64(1)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * _ROLE[k]
    return mix(total)


def shingle_sets(texts: pa.LargeStringArray, size: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, a text without words none."""
    for _, hashes, offsets in pieces(texts, BLANK):
        every = windows(hashes, size)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            if b - a >= size:
                yield np.unique(every[a : b - size + 1])
            elif b > a:
                yield windows(hashes[a:b], int(b - a)) + np.uint64(b - a)
            else:
                yield every[:0]
