"""Token counts that follow edits without encoding a text again.

Each document is cut into pre-tokens, whose token counts are independent of each other. A
segment tree over short runs of pre-tokens holds the sums of characters and of tokens, so
the pre-token at a character is found, and a changed run's sums are renewed, in logarithmic
time. An edit re-encodes the pre-tokens it touches with their boundary context: from the
last one that cannot see the edit (the split looks at most two characters beyond a
pre-token) until a new boundary meets an old one; what follows is as it was.

Edits of a document apply in order, each to the text that the ones before left. Documents and
their edits are brought together and sorted, and stream through a task: one document is held
at a time, with its tree, while any number of edits pass.

Defined results: a null or empty text has no tokens; offsets are code points, moved into the
text where they lie outside; a null replacement is empty; a null offset makes the edit do
nothing; edits without a document are left out; rows that repeat an id get the same edits;
edits of equal number apply by offset, then replacement; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt.llm.frames import Shared, released, small_batches

LEAF = 64  # pre-tokens in a leaf when it is made
CONTEXT = 2  # characters beyond a pre-token that its split can depend on
CACHE_BYTES = 64 << 20
ENTRY_BYTES = 150  # of objects and table beside what an entry says
LONG_ENTRY = 256  # characters from which a pre-token is not remembered


class Counter:
    """Token counts of pre-tokens in one task; remembers those it has seen, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import tiktoken

        self.split = regex.compile(pattern)
        self.coder = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}
        self.held = 0

    def counts(self, words: list[str]) -> list[int]:
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        known, encode = self.known, self.coder.encode_ordinary
        new = [word for word in set(words) if word not in known]
        for word in new:
            known[word] = len(encode(word))
        out = list(map(known.__getitem__, words))
        for word in new:
            if len(word) > LONG_ENTRY:
                del known[word]
            else:
                self.held += ENTRY_BYTES + 4 * len(word)
        return out


class SegmentTree:
    """Sums of (characters, tokens) over leaves, in arrays where node i has children 2i and 2i + 1."""

    def __init__(self, leaves: list[tuple[int, int]]) -> None:
        self.base = 1 << max(0, (len(leaves) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for i, (chars, tokens) in enumerate(leaves):
            self.chars[self.base + i], self.tokens[self.base + i] = chars, tokens
        for i in range(self.base - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        i = self.base + leaf
        self.chars[i], self.tokens[i] = chars, tokens
        while i > 1:
            i //= 2
            self._sum(i)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before the leaf."""
        i, before = 1, 0
        while i < self.base:
            i *= 2
            if at >= before + self.chars[i]:
                before += self.chars[i]
                i += 1
        return i - self.base, before


class Document:
    """A text as leaves of pre-tokens under a segment tree of their sums."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.counter, self.encoded = counter, 0
        words = counter.split.findall(text)
        self._plant(words, counter.counts(words))

    def _plant(self, words: list[str], counts: list[int]) -> None:
        self.leaves = [(words[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(words), LEAF)] or [([], [])]
        self.tree = SegmentTree([(sum(map(len, w)), sum(c)) for w, c in self.leaves])

    @property
    def tokens(self) -> int:
        return self.tree.tokens[1]

    @property
    def chars(self) -> int:
        return self.tree.chars[1]

    def text(self) -> str:
        return "".join(w for words, _ in self.leaves for w in words)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters from start to end."""
        start = min(max(start, 0), self.chars)
        end = min(max(end, start), self.chars)
        leaf, before = self.tree.find(max(start - CONTEXT, 0))
        leaf = min(leaf, len(self.leaves) - 1)
        before = min(before, self.chars - self.tree.chars[self.tree.base + leaf])
        # the first pre-token that can see the edit: one that ends less than CONTEXT before it
        skip, at = 0, before
        words = self.leaves[leaf][0]
        while skip < len(words) and at + len(words[skip]) + CONTEXT <= start:
            at += len(words[skip])
            skip += 1
        last, old, limit = leaf, list(words[skip:]), at
        marks = [at]  # old boundaries from the first re-encoded pre-token on
        for w in old:
            marks.append(marks[-1] + len(w))
        shift, made = len(new) - (end - start), []
        while True:
            while marks[-1] < end and last + 1 < len(self.leaves):
                last = self._draw(last, old, marks)
            old_text = "".join(old)
            text = old_text[: start - limit] + new + old_text[end - limit :]
            stops = {m + shift for m in marks if m >= end}
            made, position, met = [], limit, None
            for m in self.counter.split.finditer(text):
                made.append(m.group())
                position = limit + m.end()
                complete = m.end() + CONTEXT <= len(text) or last + 1 == len(self.leaves)
                if not complete:
                    break
                if position in stops:
                    met = position - shift
                    break
            if met is not None or last + 1 == len(self.leaves):
                break
            last = self._draw(last, old, marks)
        count = len(old) if met is None else marks.index(met)
        self.encoded += len(made)
        kept_after = old[count:]
        # counts of what follows the meeting point, from the leaves they came from
        tail_counts = [c for i in range(leaf, last + 1) for c in self.leaves[i][1]][skip + count :]
        head_words, head_counts = self.leaves[leaf][0][:skip], self.leaves[leaf][1][:skip]
        words = head_words + made + kept_after
        counts = head_counts + self.counter.counts(made) + tail_counts
        self._store(leaf, last, words, counts)

    def _draw(self, last: int, old: list[str], marks: list[int]) -> int:
        """Adds the next leaf's pre-tokens to those that are looked at."""
        for w in self.leaves[last + 1][0]:
            old.append(w)
            marks.append(marks[-1] + len(w))
        return last + 1

    def _store(self, first: int, last: int, words: list[str], counts: list[int]) -> None:
        """Deals words out over the leaves first to last; plants the tree anew if they grow too large."""
        n = last - first + 1
        size = -(-len(words) // n) if words else 0
        if size > 4 * LEAF:
            everything = [*self.leaves[:first], (words, counts), *self.leaves[last + 1 :]]
            self._plant([w for part, _ in everything for w in part], [c for _, part in everything for c in part])
            return
        for k in range(n):
            part = words[k * size : (k + 1) * size], counts[k * size : (k + 1) * size]
            self.leaves[first + k] = part
            self.tree.put(first + k, sum(map(len, part[0])), sum(part[1]))


def load_counter(spark: SparkSession, path: str, pattern: str) -> Shared:
    """The ranks of a vocabulary file (a fixed size), for tasks."""
    with open(path, "rb") as file:
        return Shared(spark, ({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}, pattern))


def count_tokens(docs: DataFrame, edits: DataFrame, path: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_before, n_after, n_chars_after, n_pretokens, n_reencoded.

    ``edits`` has columns doc_id, edit_no, start, stop, replacement. ``n_reencoded`` counts
    the pre-tokens that edits made anew, context included.
    """
    vocabulary = load_counter(docs.sparkSession, path, pattern)
    kind = docs.schema[doc_id].dataType.simpleString()
    empty = {c: F.lit(None).cast(t) for c, t in (("edit_no", "bigint"), ("start", "bigint"), ("stop", "bigint"))}
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.lit(1).alias("what"), F.col(text).alias("text")).withColumns(empty)
    changes = edits.where("doc_id IS NOT NULL AND start IS NOT NULL AND stop IS NOT NULL").select(
        F.col("doc_id").cast(kind).alias("doc_id"), F.lit(0).alias("what"), F.coalesce(F.col("replacement"), F.lit("")).alias("text"),
        *[F.col(c).cast("bigint").alias(c) for c in ("edit_no", "start", "stop")],
    )
    # a document without an id has no edits, so it is counted where it is
    known = texts.where("doc_id IS NOT NULL").unionByName(changes)
    rows = known.repartition("doc_id").sortWithinPartitions("doc_id", F.desc("what"), "edit_no", "start", "stop", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*vocabulary.get())
        held: dict[str, list] = {}  # text: document, tokens before, rows
        owner, kind = object(), pa.int64()

        def done() -> list[tuple]:
            return [(owner, before, d.tokens, d.chars, sum(len(w) for w, _ in d.leaves), d.encoded) for d, before, rows in held.values() for _ in range(rows)]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind if i == 0 else pa.int64()) for i in range(6)], names=["doc_id", "n_before", "n_after", "n_chars_after", "n_pretokens", "n_reencoded"])

        for batch in batches:
            kind, out = batch.column(0).type, []
            for doc, what, text, _, start, stop in zip(*[c.to_pylist() for c in batch.columns]):
                if doc is None or doc != owner:
                    out += done()
                    held, owner = {}, doc
                if what == 1:
                    text = text or ""
                    if text not in held:
                        document = Document(text, counter)
                        held[text] = [document, document.tokens, 0]
                    held[text][2] += 1
                else:
                    for document, _, _ in held.values():
                        document.edit(start, stop, text)
            yield made(out)
        yield made(done())

    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {id_type}, n_before bigint, n_after bigint, n_chars_after bigint, n_pretokens bigint, n_reencoded bigint"
    counted = small_batches(rows).mapInArrow(lambda batches: released(run(batches)), schema)
    counted = counted.unionByName(texts.where("doc_id IS NULL").select(rows.columns).mapInArrow(lambda batches: released(run(batches)), schema))
    return counted if doc_id == "doc_id" else counted.withColumnRenamed("doc_id", doc_id)
