"""Words and their hashes over byte buffers."""

import tracemalloc

import numpy as np
import pyarrow as pa

from waybill.llm.words import ALNUM, SPACED, buffers, hashed, mix, word_hashes, word_spans


def _hash(word: bytes) -> int:
    """The hash of one word, byte by byte."""
    low = [b + 32 if 65 <= b <= 90 else b for b in word]
    value = sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(low)) + len(low) * 0xD6E8FEB86659FD93
    return int(mix(np.array([value % (1 << 64)], np.uint64))[0])


def test_hashes_equal_those_made_byte_by_byte():
    texts = [b"Ab c", None, b"", b" x\xff\xc3\xa9  ", b"ab", b"\tQ\n" * 3, b"w" * 70_000 + b" v " + b"u" * 70_000, b"end"]
    values, firsts = hashed(pa.array(texts, pa.binary()))
    want = [(t or b"").split() for t in texts]
    assert np.diff(firsts).tolist() == [len(w) for w in want]
    assert values.tolist() == [_hash(w) for words in want for w in words]
    assert hashed(pa.array([b"a-b_c\xff", b"d"], pa.binary()), ALNUM)[0].tolist() == [_hash(w) for w in (b"a", b"b", b"c\xff", b"d")]


def test_hashing_holds_little_beside_its_result():
    data, cuts = buffers(pa.array([b"some words " * 200_000], pa.binary()))
    starts, ends, _ = word_spans(data, cuts, SPACED)
    tracemalloc.start()
    try:
        out = word_hashes(data, starts, ends)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most - out.nbytes < 6 << 20
