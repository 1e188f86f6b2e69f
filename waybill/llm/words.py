"""Texts as flat byte arrays: slices of bounded size, words and their hashes.

Arrow already holds a text column as one byte buffer with offsets.  Words are
found and hashed over that buffer with numpy, so no Python string is made per
word.  A slice holds about ``SLICE_BYTES`` of text (one text may exceed it), which
bounds the memory of a task whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
# So many bytes are hashed at a time that the arrays over them stay in a core's cache.
_PIECE = 1 << 16

# Lower case for A-Z only, as a byte table.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Words of anything but ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
# Words of ASCII letters and digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    ALNUM[_a:_b] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_power: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64; kept per worker."""
    if not _power or len(_power[0]) <= n:
        size = max(n + 1, _PIECE + 4096)
        _power[:] = [
            np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)]), dtype=np.uint64)
            for b in (_BASE, _UNBASE)
        ]
    return _power[0], _power[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its offsets; a null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    cuts = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize)
    data = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]]
    return data, cuts.astype(np.int64) - int(cuts[0])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in record batches of about ``size`` bytes of text."""
    for batch in batches:
        _, cuts = buffers(batch.column(column))
        start = 0
        while start < len(batch):
            end = max(start + 1, int(np.searchsorted(cuts, cuts[start] + size, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def looked_up(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The entry of each byte in a table of 256 bytes or booleans; not to be written to."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def word_spans(data: np.ndarray, cuts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each text's first word (one more at the end)."""
    word = looked_up(data, inside)
    n = len(data)
    border = np.zeros(n + 1, bool)
    border[cuts] = True  # a word never reaches over the border of two texts
    opens, closes = np.ones(n, bool), np.ones(n, bool)
    np.logical_not(word[:-1], out=opens[1:])
    np.logical_not(word[1:], out=closes[:-1])
    opens |= border[:-1]
    closes |= border[1:]
    opens &= word
    closes &= word
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    ends += 1
    return starts, ends, np.searchsorted(starts, cuts)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word in lower case, from prefix sums of a polynomial."""
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        origin = starts[done]
        to = max(done + 1, int(np.searchsorted(ends, origin + _PIECE, "right")))
        stop = ends[to - 1]
        power, inverse = _powers(stop - origin)
        sums = np.zeros(stop - origin + 1, np.uint64)
        terms = looked_up(data[origin:stop], _LOWER).astype(np.uint64)
        terms += np.uint64(1)
        terms *= power[: stop - origin]
        np.cumsum(terms, out=sums[1:])
        s, e = starts[done:to] - origin, ends[done:to] - origin
        own = sums.take(e)
        own -= sums.take(s)
        own *= inverse.take(s)
        own += (e - s).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        out[done:to] = mix(own)
        done = to
    return out


def hashed(texts: pa.Array, inside: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and where each text's words begin."""
    data, cuts = buffers(texts)
    starts, ends, firsts = word_spans(data, cuts, inside)
    return word_hashes(data, starts, ends), firsts


def hash_of(words: list[bytes], inside: np.ndarray = SPACED) -> np.ndarray:
    """The hash of each given word."""
    values, firsts = hashed(pa.array(words, pa.binary()), inside)
    if len(values) != len(words) or (np.diff(firsts) != 1).any():
        raise ValueError("each item must be one word")
    return values
