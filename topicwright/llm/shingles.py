"""Word shingles of whole texts as sorted arrays of 64-bit hashes, for many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
SLICE_BYTES = 1 << 20
_LONG = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=8).digest() for i in range(256)), np.uint64)
_PLACES = np.frombuffer(b"".join(hashlib.blake2b(b"place%d" % i, digest_size=8).digest() for i in range(64)), np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each bit of the input moves about half of the output's."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes data[start:stop] of each span, all spans a byte at a time; spans of over 64 bytes one by one."""
    length = stop - start
    order = np.argsort(-np.minimum(length, _LONG + 1), kind="stable")
    at, left = start[order], length[order]
    h = np.zeros(len(start), np.uint64)
    falling = -left
    for k in range(int(min(_LONG, left[0])) if len(left) else 0):
        some = int(np.searchsorted(falling, -k, "left"))  # spans longer than k
        h[:some] = h[:some] * _BASE + _TABLE[data[at[:some] + k]]
    out = np.empty(len(start), np.uint64)
    out[order] = mix(h + left.astype(np.uint64) * _BASE)
    for w in np.flatnonzero(length > _LONG):
        out[w] = int.from_bytes(hashlib.blake2b(data[start[w] : stop[w]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text): words [^\\x20\\x09-\\x0D]+ after A-Z are made lower case; a null text has none."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(x for x in texts.cast(pa.large_binary()).to_pylist() if x is not None), np.uint8)
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + 32, data).astype(np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    ends = np.cumsum(sizes)
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    edge[0] = True
    inside = ~space
    start = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], space[:-1]])))
    stop = np.flatnonzero(inside & (edge[1:] | np.concatenate([space[1:], [True]]))) + 1
    words = np.searchsorted(start, ends) - np.searchsorted(start, ends - sizes)
    return span_hashes(data, start, stop), words


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of each text, ascending in each; their number): a text of fewer than five words has its whole sequence as one, a text without words none."""
    w, words = word_hashes(texts)
    many = np.where(words >= WORDS, words - WORDS + 1, np.minimum(words, 1))
    text = np.repeat(np.arange(len(words)), many)
    first = np.cumsum(words) - words
    at = first[text] + np.arange(len(text)) - (np.cumsum(many) - many)[text]
    last = first[text] + words[text]
    value = np.minimum(words, WORDS)[text].astype(np.uint64) * _PLACES[WORDS]
    padded = np.concatenate([w, np.zeros(WORDS, np.uint64)])
    for k in range(WORDS):
        value += np.where(at + k < last, padded[at + k], np.uint64(0)) * _PLACES[k]
    value = mix(value)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], np.bincount(text[new], minlength=len(words))
