"""Word shingles of whole texts as sorted sets of 64-bit numbers, many documents at a time in numpy.

Words are found on the UTF-8 bytes.  A word's number is a polynomial over its bytes modulo 2^64,
read from one running sum over the batch; a shingle's number mixes those of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: bytes of text that are worked on at a time; a longer text is worked on alone
BATCH = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bytes_table() -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte, A-Z as a-z; and which bytes are white space."""
    code = np.arange(256)
    white = (code == 0x20) | ((code >= 0x09) & (code <= 0x0D))
    lower = np.where((code >= 65) & (code <= 90), code + 32, code).astype(np.uint64)
    return mix(lower + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), white


_NUMBER, _WHITE = _bytes_table()
_BASE = 0xD1342543DE82EF95
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n at least; kept up to twice the batch."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(max(n, BATCH + 1), base, np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps))
    if n <= 2 * BATCH:
        _powers = (made[0], made[1])
    return made[0], made[1]


def word_numbers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of documents data[offsets[i]:offsets[i+1]], and where each document's words begin."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_WHITE[data]
    begins, ends = np.empty(n, bool), np.empty(n, bool)
    begins[0], ends[-1] = True, True
    np.logical_not(word[:-1], out=begins[1:])
    np.logical_not(word[1:], out=ends[:-1])
    cuts = offsets[(offsets > 0) & (offsets < n)]
    begins[cuts] = True
    ends[cuts - 1] = True
    start, end = np.flatnonzero(begins & word), np.flatnonzero(ends & word) + 1
    power, inverse = _power_tables(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_NUMBER[data] * power[:n], out=total[1:])
    numbers = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return numbers, np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted set of k-word shingles of each document; fewer words make one shingle, none an empty set."""
    words, first = word_numbers(data, offsets)
    run = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        run = mix(run + words[i : len(words) - k + 1 + i]) if len(run) else run
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(run[a : b - k + 1]))
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for i in range(a, b):
                whole = mix(whole + words[i : i + 1])
            out.append(mix(whole + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def text_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [a, b) of a string column with their bytes and offsets, about BATCH bytes at a time."""
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(at, at[a] + BATCH, "right")) - 1)
        b = min(b, len(column))
        yield a, b, data[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b
