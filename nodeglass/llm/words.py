"""Texts as byte buffers: words, word hashes and shingle hashes in numpy.

Arrow hands a column of texts over as one buffer of UTF-8 bytes with offsets.
All functions work on that buffer, without a Python object per word. A word is
a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
# Texts are taken in blocks of about this many bytes, so that the arrays of a
# block stay small; a longer single text makes a block of its own.
BLOCK_BYTES = 1 << 18

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
# Bytes other than ASCII letters, digits and those of other scripts.
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x):
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def blocks(column):
    """(first row, bytes, offsets) for runs of texts; a null text is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    _, places, content = column.buffers()
    size = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(places, size)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    content = np.frombuffer(content, np.uint8) if content is not None and len(content) else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        yield at, content[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def word_spans(data, offsets, gaps=WHITE):
    """Starts and ends of all words, and for each text the place of its first.

    ``gaps`` marks the bytes that stand between words.
    """
    white = gaps[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = white[:-1], white[1:]
    filled = np.flatnonzero(np.diff(offsets))
    before[offsets[filled]] = True
    after[offsets[filled + 1] - 1] = True
    starts, ends = np.flatnonzero(before & ~white), np.flatnonzero(after & ~white) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _byte_values():
    """A number for each byte at each of the first 64 places of a word."""
    return mix(np.arange(1, 64 * 256 + 1, dtype=U64) * U64(_BASE))


_VALUES = _byte_values()


def word_hashes(data, starts, ends):
    """A 64-bit hash of each word, equal for equal words.

    The sum of a number for each byte and its place. The numbers look random, so
    words with a regular pattern are as unlikely to meet as any others.
    """
    lengths = ends - starts
    begin = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    if not len(starts):
        return np.zeros(0, U64)
    place = np.arange(begin[-1] + lengths[-1]) - np.repeat(begin, lengths)
    values = _VALUES[((place & 63) << 8) | data[place + np.repeat(starts, lengths)]]
    far = np.flatnonzero(place > 63)
    values[far] *= mix((place[far] >> 6).astype(U64)) | U64(1)
    return mix(np.add.reduceat(values, begin) + lengths.astype(U64))


def shingle_hashes(words, first, k):
    """Hashes of all runs of ``k`` words of each text, and each text's first.

    A text of fewer words has its whole sequence as the only shingle, a text
    without words has none.
    """
    lengths = np.diff(first)
    counts = np.where(lengths >= k, lengths - k + 1, (lengths > 0).astype(lengths.dtype))
    begin = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], counts)
    size = np.repeat(np.minimum(lengths, k), counts)
    out = size.astype(U64)
    for j in range(k):
        there = size > j
        out = np.where(there, mix(out * U64(_BASE) + words[np.where(there, at + j, 0)]), out) if len(out) else out
    return out, begin


def hashed_words(data, offsets):
    """Word hashes of a block and the place of each text's first word."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    return word_hashes(data, starts, ends), first


def shingle_sets(column, k):
    """For each text its distinct shingle hashes, ascending."""
    for _, data, offsets in blocks(column):
        hashes, begin = shingle_hashes(*hashed_words(data, offsets), k)
        for a, b in zip(begin[:-1], begin[1:]):
            yield np.unique(hashes[a:b])


def set_key(hashes):
    """128 bits that name a set of hashes, as two signed numbers."""
    digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return np.frombuffer(digest, np.int64)
