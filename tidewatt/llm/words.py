"""Words of whole string columns as numpy arrays: boundaries and 64-bit hashes.

A batch of texts is one byte buffer. Words are found and hashed for the whole buffer at
once; no text is ever cut. All hashing is modulo 2**64 and the same in every task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Byte classes of the two kinds of words, and A-Z to a-z.
ALNUM_BYTES = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
NON_SPACE_BYTES = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
LOWER_BYTES = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
# Odd 64-bit constants of a published mixing function (splitmix64) and FNV-1a.
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
FNV_BASIS, FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)

SLICE_BYTES = 2 << 20  # text handled at once; a longer text is one slice of its own
SLICE_ROWS = 1 << 16  # texts handled at once, so that their numbers fit in 16 bits
LONG_WORD = 48  # words above this many bytes are hashed one by one


class Words(NamedTuple):
    data: np.ndarray  # uint8, lower-cased if asked for
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    first: np.ndarray  # index of each text's first word, and the number of words at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the offsets of its values; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most SLICE_ROWS rows whose texts hold about ``limit`` bytes; at least one row each."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), at + SLICE_ROWS, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def split_words(column: pa.Array, word_bytes: np.ndarray, lower: bool) -> Words:
    data, offsets = utf8(column)
    if lower:
        data = LOWER_BYTES[data]
    inside = word_bytes[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]  # a word never crosses texts
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def hash_words(words: Words, seed: int = 0) -> np.ndarray:
    """One 64-bit hash for each word."""
    lengths = words.ends - words.starts
    out = np.full(len(lengths), FNV_BASIS ^ np.uint64(seed), np.uint64)
    rest = np.flatnonzero(lengths <= LONG_WORD)
    position = 0
    while len(rest):
        byte = words.data[words.starts[rest] + position]
        out[rest] = (out[rest] ^ byte) * FNV_PRIME
        position += 1
        rest = rest[lengths[rest] > position]
    out = mixed(out)
    for i in np.flatnonzero(lengths > LONG_WORD):
        digest = hashlib.blake2b(words.word(i), digest_size=8, key=seed.to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def hash_runs(hashes: np.ndarray, at: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A hash of the ``length`` words from each position of ``at``, sensitive to their order."""
    out = np.full(len(at), np.uint64(length) + (np.uint64(seed) << np.uint64(32)), np.uint64)
    for k in range(length):
        out = (out ^ hashes[at + k]) * MIX_1
        out ^= out >> np.uint64(29)
    return mixed(out)


def run_starts(words: Words, length: int) -> np.ndarray:
    """Positions from which ``length`` words of one text follow."""
    counts = words.counts
    room = np.maximum(counts - (length - 1), 0)
    total = int(room.sum())
    base = np.repeat(words.first[:-1] - (np.cumsum(room) - room), room)
    return base + np.arange(total)


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``n`` positions lie in a run of ``length`` from one of ``starts``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + length, n), -1)
    return np.cumsum(change[:-1]) > 0


def per_text(flags: np.ndarray, words: Words) -> np.ndarray:
    """How many words of each text are flagged."""
    sums = np.concatenate([[0], np.cumsum(flags)])
    return (sums[words.first[1:]] - sums[words.first[:-1]]).astype(np.int64)


def without_words(column: pa.Array, words: Words, gone: np.ndarray) -> pa.Array:
    """The texts without the words of ``gone``; kept words stand apart as before, null stays null.

    ``words`` are those of ``column``. A removed word takes the bytes up to the next word of
    its text with it.
    """
    raw, offsets = utf8(column)
    change = np.zeros(len(raw) + 1, np.int32)
    if gone.any():
        upto = np.append(words.starts[1:], len(raw))
        upto = np.minimum(upto, offsets[1:][words.text_of_word()])
        change[words.starts[gone]] += 1
        np.add.at(change, upto[gone], -1)
    keep = np.cumsum(change)[:-1] == 0
    sums = np.concatenate([[0], np.cumsum(keep)])
    made = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(sums[offsets].tobytes()), pa.py_buffer(raw[keep].tobytes()))
    return pc.if_else(pc.is_valid(column), made, pa.scalar(None, pa.large_string())).cast(pa.string())
