"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words are a bounded number of blocks; each block becomes one automaton, which
the documents stream through. After each word the automaton holds the longest match that
ends there. A match of ``window`` words is an occurrence of a window; an item of fewer
words is found where the match ends with all of them.

Defined results: a null or empty text has no words and no hits; items without words take no
part; repeated items count once for each id; repeated documents each get their own row;
other columns are carried along whatever their names; a null item id has no name, so it is
hit but not listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatt.llm.automaton import SuffixAutomaton
from tidewatt.llm.frames import Shared, add_struct, free_name, released, small_batches
from tidewatt.llm.words import ALNUM_BYTES, covered, hash_words, per_text, slices, split_words, utf8, without_words
from tidewatt.session import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_WORDS = 200_000
PIECE_WORDS = 4_000

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("hit_words", T.ArrayType(T.IntegerType())),
    ]
)


class ItemIndex:
    """The automaton of one block of item pieces, and what its states mean."""

    def __init__(self, pieces: list[tuple[str | None, list[str]]], window: int) -> None:
        self.window = window
        names = sorted({w for _, words in pieces for w in words})
        column = pa.array(names, pa.large_string())
        data, offsets = utf8(column)
        hashes = np.array([], np.uint64)
        if names:
            hashes = hash_words(split_words(column, np.ones(256, bool), False))
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.bytes = [names[i].encode() for i in order]
        number = {names[i]: k for k, i in enumerate(order)}
        self.machine = machine = SuffixAutomaton()
        coded = [(item, [number[w] for w in words]) for item, words in pieces]
        for _, words in coded:
            machine.add(words)
        self.items: dict[int, set[str | None]] = {}
        whole = [False] * len(machine.link)
        pairs = set()
        for item, words in coded:
            state = 0
            for k, word in enumerate(words):
                state = machine.next[state][word]
                if k + 1 >= window:
                    anchor = machine.at_length(state, window)
                    self.items.setdefault(anchor, set()).add(item)
            if len(words) < window:  # the whole item is the window; its state's longest string is the item
                whole[state] = True
                self.items.setdefault(state, set()).add(item)
            pairs.update(zip(words, words[1:]))
        self.short = machine.nearest(whole)
        self.pairs = np.array(sorted(a * len(names) + b for a, b in pairs), np.int64)
        self.least = min((min(window, len(words)) for _, words in coded), default=window)

    def scan(self, column: pa.Array) -> tuple[np.ndarray, list[set[str | None]], object]:
        """Which words of the texts are hit, and each text's items."""
        words = split_words(column, ALNUM_BYTES, True)
        found: list[set[str | None]] = [set() for _ in range(len(column))]
        n = len(words.starts)
        if not n or not len(self.hashes):
            return np.zeros(n, bool), found, words
        hashes = hash_words(words)
        code = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[code] == hashes
        owner = words.text_of_word()
        joined = np.zeros(n, bool)  # joined to the word before: same text, and the pair is in an item
        both = np.flatnonzero(known[1:] & known[:-1] & (owner[1:] == owner[:-1])) + 1
        if len(self.pairs):
            pair = code[both - 1].astype(np.int64) * len(self.hashes) + code[both]
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[both] = self.pairs[place] == pair
        begins = np.flatnonzero(known & ~joined)
        ends = np.concatenate([np.flatnonzero(known[:-1] & ~joined[1:]) + 1, [n] if known[-1] else []]).astype(np.int64)
        long = ends - begins >= self.least  # no window fits into a shorter run
        starts_by_length: dict[int, list[int]] = {}
        machine, window = self.machine, self.window
        for begin, end in zip(begins[long].tolist(), ends[long].tolist()):
            state = matched = 0
            items = found[owner[begin]]
            for at in range(begin, end):
                word = int(code[at])
                if words.word(at) != self.bytes[word]:  # another word with the same hash
                    state = matched = 0
                    continue
                state, matched = machine.move(state, matched, word)
                if matched >= window:
                    items |= self.items[machine.at_length(state, window)]
                    starts_by_length.setdefault(window, []).append(at - window + 1)
                else:
                    item = self.short[state]
                    if item >= 0 and machine.length[item] > matched:
                        item = self.short[machine.link[item]] if machine.link[item] >= 0 else -1
                    while item > 0:
                        items |= self.items[item]
                        starts_by_length.setdefault(machine.length[item], []).append(at - machine.length[item] + 1)
                        item = self.short[machine.link[item]]
                if matched >= window and self.least < window:
                    item = self.short[machine.link[machine.at_length(state, window)]]
                    while item > 0:
                        items |= self.items[item]
                        item = self.short[machine.link[item]]
        hit = np.zeros(n, bool)
        for length, starts in starts_by_length.items():
            hit |= covered(n, np.array(starts), length)
        return hit, found, words


def item_pieces(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item, words): items cut into pieces of bounded length that share window - 1 words."""
    words = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(WORD), F.lit(0))
    step = PIECE_WORDS
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(step))
    return (
        items.select(F.col(item_id).cast("string").alias("item"), words.alias("words"))
        .where("size(words) > 0")
        .select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s + 1, F.lit(step + window - 1)))).alias("words"))
    )


def item_blocks(pieces: DataFrame, block_words: int):
    """Lists of pieces, each of at most ``block_words`` words or one piece, one list at a time."""
    total = pieces.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    count = 1 + total // block_words
    while True:
        block = F.pmod(F.xxhash64("item", "words"), F.lit(count))
        sizes = pieces.distinct().groupBy(block.alias("b")).agg(F.sum(F.size("words")).alias("n"), F.count("*").alias("k"))
        worst = sizes.where(f"n > {2 * block_words} AND k > 1").limit(1).count()
        if not worst:
            break
        count *= 2
    for b in range(count):
        rows = pieces.distinct().where(block == b).collect()
        if rows:
            yield [(r["item"], r["words"]) for r in rows]


def find_leaks(
    docs: DataFrame, items: DataFrame, *, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, into: str = "leak"
) -> DataFrame:
    """``docs`` with a struct ``into``: n_words, n_hit, items (sorted), hit_words (their positions).

    Documents are read once for each block of items. A block is bounded by ``block_words``,
    is the only thing that passes the driver, and is broadcast. With several blocks the
    documents are written between passes, so that one automaton at a time is in memory.
    """
    spark = docs.sparkSession
    names = free_name(docs, into)
    out, first = docs, True
    for pieces in item_blocks(item_pieces(items, item_id, item_text, window), block_words):
        index = Shared(spark, ItemIndex(pieces, window))

        def work(column: pa.Array, index=index) -> list[pa.Array]:
            hit, found, words = index.get().scan(column)
            where = np.flatnonzero(hit)
            cuts = np.searchsorted(where, words.first)
            local = (where - words.first[:-1][words.text_of_word()[where]]).astype(np.int32)
            return [
                pa.array(words.counts.astype(np.int64)),
                pa.array(per_text(hit, words)),
                pa.array([sorted(x for x in s if x is not None) for s in found], pa.list_(pa.string())),
                pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(local)),
            ]

        if first:
            out, first = add_struct(out, text, names, FOUND, work), False
            continue
        out = staged(out, "leaks")
        more = free_name(out, "more")
        out = add_struct(out, text, more, FOUND, work)
        merged = F.array_sort(F.array_union(F.col(names)["hit_words"], F.col(more)["hit_words"]))
        both = F.struct(
            F.col(names)["n_words"].alias("n_words"),
            F.size(merged).cast("long").alias("n_hit"),
            F.array_sort(F.array_union(F.col(names)["items"], F.col(more)["items"])).alias("items"),
            merged.alias("hit_words"),
        )
        out = out.withColumn(names, both).drop(more)
    if first:  # no items with words
        empty = ItemIndex([], window)

        def none(column: pa.Array) -> list[pa.Array]:
            _, found, words = empty.scan(column)
            blank = pa.array([[] for _ in found], pa.list_(pa.string()))
            return [pa.array(words.counts.astype(np.int64)), pa.array(np.zeros(len(found), np.int64)), blank, blank.cast(pa.list_(pa.int32()))]

        out = add_struct(docs, text, names, FOUND, none)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 10, max_coverage: float = 0.5, text: str = "text", **options) -> DataFrame:
    """``docs`` without the words that windows of items hit.

    A document whose hit words are more than ``max_coverage`` of all is dropped as a copy of
    items; from the others the hit spans are cut. Documents without hits keep their text,
    byte for byte.
    """
    leaky = find_leaks(docs, items, window=window, text=text, **options)
    leak = leaky.columns[-1]
    kept = leaky.where(F.col(leak)["n_hit"] <= F.lit(max_coverage) * F.col(leak)["n_words"])
    index = [c.lower() for c in docs.columns].index(text.lower())

    def cut(batches):
        for batch in batches:
            for part in slices(batch, index):
                columns = list(part.columns[:-1])
                hits = part.column(part.num_columns - 1).field("hit_words")
                words = split_words(columns[index], ALNUM_BYTES, False)
                gone = np.zeros(len(words.starts), bool)
                gone[np.repeat(words.first[:-1], pc.list_value_length(hits).to_numpy()) + hits.flatten().to_numpy()] = True
                columns[index] = without_words(columns[index], words, gone)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:-1])

    return small_batches(kept).mapInArrow(lambda batches: released(cut(batches)), docs.schema)


def leak_digest(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_leaks(docs.select(doc_id, options.get("text", "text")), items, **options)
    leak = F.col(found.columns[-1])
    return found.select(
        doc_id,
        leak["n_words"].alias("n_words"),
        leak["n_hit"].alias("n_hit"),
        F.size(leak["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", leak["items"]).cast("binary"), 256).alias("items_sha256"),
        (leak["n_hit"] > 0).alias("contaminated"),
    )
