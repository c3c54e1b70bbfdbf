"""Repeated passages across documents, found at difference-cover anchors.

Positions are taken modulo a period ``v``. A difference cover D has for any two positions
i, j an offset d < v with i + d and j + d both in D. So two equal windows always share an
anchor: the words from an aligned cover position, short enough to fit whatever d is. Only
cover positions are hashed and compared over the corpus (3 of 7 for 13 words, 5 of 21 for
50). Windows around anchors that another document has too are then compared whole.

Defined results: windows are judged on the input; "smaller" is by document id, so rows that
repeat an id do not remove from each other; a null id is larger than all others; a null or
empty text has no words; other columns are carried along whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewatt.llm import packs as P
from tidewatt.llm.words import NON_SPACE_BYTES, Words, covered, hash_runs, hash_words, per_text, run_starts, split_words, without_words
from tidewatt.session import staged

# Difference covers by period; all but the first two are perfect difference sets.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
KEYS_PER_OWNER = 400_000
LAST = np.iinfo(np.int64).max


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves anchors of at least half the window."""
    period = max(v for v in COVERS if v == 1 or 2 * v <= window + 1)
    return period, COVERS[period]


class Anchors:
    """Cover positions of a pack, their hashes, and its distinct hashes in order."""

    def __init__(self, words: Words, hashes: np.ndarray, window: int) -> None:
        self.period, cover = cover_for(window)
        self.length = window - self.period + 1
        starts = run_starts(words, self.length)
        local = starts - words.first[:-1][words.text_of_word()[starts]]
        wanted = np.zeros(self.period, bool)
        wanted[list(cover)] = True
        self.at = starts[wanted[local % self.period]]
        self.hash = hash_runs(hashes, self.at, self.length, seed=1)
        self.keys, self.place = np.unique(self.hash, return_inverse=True)

    def in_several(self, doc: np.ndarray) -> np.ndarray:
        """Which distinct hashes occur in more than one document of the pack."""
        least = np.full(len(self.keys), LAST, np.int64)
        most = np.full(len(self.keys), -LAST, np.int64)
        np.minimum.at(least, self.place, doc[self.at])
        np.maximum.at(most, self.place, doc[self.at])
        return least < most


def candidate_windows(words: Words, anchors: Anchors, shared: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that hold an anchor which other documents have too."""
    near = np.zeros(len(words.starts) + 1, np.int64)
    at = anchors.at[shared[anchors.place]]
    first = words.first[:-1][words.text_of_word()[at]]
    np.add.at(near, np.maximum(at - anchors.period + 1, first), 1)
    np.add.at(near, at + 1, -1)
    starts = run_starts(words, window)
    return starts[np.cumsum(near)[starts] > 0]


class Windows:
    """Distinct candidate windows of a pack, in order, with the smallest document of each."""

    def __init__(self, hashes: np.ndarray, at: np.ndarray, doc: np.ndarray, window: int) -> None:
        self.at, self.doc = at, doc[at]
        a = hash_runs(hashes, at, window, seed=2)
        b = (hash_runs(hashes, at, window, seed=3) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((self.doc, b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.place = np.empty(len(a), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.keys, self.rest, self.least = a[new], b[new], self.doc[order][new]


def _shared(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Of one range, for each key whether another pack sent it too."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), np.uint8)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out, 0


def _beaten(keys: np.ndarray, rest: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, int]:
    """Of one range, for each window whether another pack has it in a smaller document."""
    order = np.lexsort((least, rest, keys))
    new = np.ones(len(keys), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (rest[order][1:] != rest[order][:-1])
    first = least[order][new][np.cumsum(new) - 1]
    out = np.zeros(len(keys), np.uint8)
    out[order] = first < least[order]
    return out, 0


def repeated_words(
    docs: DataFrame,
    finish: Callable[[pa.RecordBatch, Words, np.ndarray], pa.RecordBatch],
    schema: T.StructType,
    *,
    window: int = 13,
    text: str = "text",
    doc_id: str = "doc_id",
    keys_per_owner: int = KEYS_PER_OWNER,
    pack_bytes: int = P.PACK_BYTES,
) -> DataFrame:
    """``finish(rows, words, removed)`` over the documents; ``removed`` flags the words that
    lie in a window which also starts in a document with a smaller id."""
    names = [c.lower() for c in docs.columns]
    text_at, id_at = names.index(text.lower()), names.index(doc_id.lower())
    packs, total = P.write_packs(docs, text, lambda column: len(split_words(column, NON_SPACE_BYTES, False).starts), pack_bytes)
    owners = 1 + total // keys_per_owner

    def read(rows: pa.RecordBatch) -> tuple[Words, np.ndarray, np.ndarray]:
        words = split_words(rows.column(text_at), NON_SPACE_BYTES, False)
        ids = rows.column(id_at).cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
        return words, hash_words(words), ids[words.text_of_word()]

    def ask_anchors(pack: int, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, hashes, _ = read(rows)
        anchors = Anchors(words, hashes, window)
        yield P.questions(pack, anchors.keys, owners)

    def windows_of(rows: pa.RecordBatch, shared: np.ndarray) -> tuple[Words, Windows]:
        words, hashes, doc = read(rows)
        anchors = Anchors(words, hashes, window)
        shared = shared.astype(bool) | anchors.in_several(doc)
        return words, Windows(hashes, candidate_windows(words, anchors, shared, window), doc, window)

    def ask_windows(pack: int, rows: pa.RecordBatch, shared: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, found = windows_of(rows, shared)
        yield P.questions(pack, found.keys, owners, rest=(found.rest, "<u4"), least=(found.least, "whole"))

    def remove(pack: int, rows: pa.RecordBatch, shared: np.ndarray, beaten: np.ndarray) -> Iterator[pa.RecordBatch]:
        words, found = windows_of(rows, shared)
        lost = beaten.astype(bool)[found.place] | (found.doc > found.least[found.place])
        yield finish(rows, words, covered(len(words.starts), found.at[lost], window))

    asked = P.over_packs(packs, [], ask_anchors, "owner bigint, pack bigint, keys binary")
    shared = staged(P.answered(asked, _shared, {"keys": "sorted"}), "anchors")
    asked = P.over_packs(packs, [(shared, "u1")], ask_windows, "owner bigint, pack bigint, keys binary, rest binary, least binary")
    beaten = P.answered(asked, _beaten, {"keys": "sorted", "rest": "<u4", "least": "whole"})
    return P.over_packs(packs, [(shared, "u1"), (beaten, "u1")], remove, schema)


def dedup_substrings(docs: DataFrame, *, window: int = 13, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with repeated passages cut from all documents but the first."""
    text_at = [c.lower() for c in docs.columns].index(text.lower())

    def cut(rows: pa.RecordBatch, words: Words, gone: np.ndarray) -> pa.RecordBatch:
        columns = list(rows.columns)
        columns[text_at] = without_words(columns[text_at], words, gone)
        return pa.RecordBatch.from_arrays(columns, names=rows.schema.names)

    return repeated_words(docs, cut, docs.schema, window=window, text=text, doc_id=doc_id, **options)


def substring_digest(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""

    def digest(rows: pa.RecordBatch, words: Words, gone: np.ndarray) -> pa.RecordBatch:
        kept = []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            keep = a + np.flatnonzero(~gone[a:b])
            joined = b" ".join([words.data[s:e].tobytes() for s, e in zip(words.starts[keep].tolist(), words.ends[keep].tolist())])
            kept.append(hashlib.sha256(joined).hexdigest())
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(words.counts.astype(np.int64)), pa.array(per_text(gone, words)), pa.array(kept, pa.string())], names=[id_field.name, "n_words", "n_removed", "kept_sha256"])

    narrow = docs.select(doc_id, text)
    id_field = narrow.schema[0]
    more = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    return repeated_words(narrow, digest, T.StructType([id_field, *more]), text=text, doc_id=doc_id, **options)
