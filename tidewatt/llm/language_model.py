"""Scores of whole texts under an n-gram model of the corpus, as a weighted backoff automaton.

Counts come from all training documents. A pack of documents asks the corpus for the counts
of its own distinct n-grams and builds the automaton restricted to them, which is all that
its texts can visit: states are contexts seen in training, an arc reads a word and leads to
the longest context that it leaves, and where a state has no arc for the next word its
failure arc leads to the shorter context. Weights are log10 probabilities smoothed with a
Dirichlet prior around the next shorter order:

    p(w)       = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w | h)   = (c(h w) + m p(w | h')) / (c(h) + m)

so an unseen n-gram costs the failure weight m / (c(h) + m), and the probabilities of all
words after any context sum to one. One pass over the tokens carries the state. A state
depends on the last ``order`` - 1 tokens only, so long texts are read in pieces side by side
that begin that many tokens early.

Counts are asked for one order after the other. An n-gram of which a part occurs in no other
pack occurs in no other pack itself; its count is the pack's own, and it is not asked for.

Defined results: a null or empty text is one end token; a null id is text '' for the fold;
rows that repeat an id are scored each, and counted each if they are in training; without
training documents N and V are 0 and all tokens are unknown; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatt.llm import packs as P
from tidewatt.llm.words import NON_SPACE_BYTES, hash_runs, hash_words, split_words

ORDER = 3
PRIOR = 100.0
KEYS_PER_OWNER = 400_000
PACK_BYTES = 3 << 20  # n-grams take more memory than words
PIECE = 512  # tokens of a text that one lane of the traversal reads
END = np.uint64(0x9E3779B97F4A7C15)  # the hash of the end token; no word of bytes is checked against it


class Grams(NamedTuple):
    """The distinct n-grams of one order in a pack."""

    keys: np.ndarray  # sorted hashes
    at: np.ndarray  # for each token the n-gram that ends there, or -1
    example: np.ndarray  # a token at which each n-gram ends


class Tokens:
    """Tokens of a pack with their ends."""

    def __init__(self, column: pa.Array) -> None:
        words = split_words(column, NON_SPACE_BYTES, True)
        counts = words.counts + 1
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.token = np.empty(self.first[-1], np.uint64)
        ends = self.first[1:] - 1
        self.token[ends] = END
        inner = np.ones(len(self.token), bool)
        inner[ends] = False
        self.token[inner] = hash_words(words)
        self.text = np.repeat(np.arange(len(counts)), counts)

    def grams(self, n: int) -> Grams:
        local = np.arange(len(self.token)) - self.first[:-1][self.text]
        ends = np.flatnonzero(local >= n - 1)
        hashes = hash_runs(self.token, ends - (n - 1), n, seed=4)
        rank = np.argsort(hashes)
        hashes = hashes[rank]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        at = np.full(len(self.token), -1, np.int32)
        at[ends[rank]] = np.cumsum(new, dtype=np.int32) - 1
        return Grams(hashes[new], at, ends[rank[new]])


class Counts:
    """Training counts of a pack's n-grams, one order after the other."""

    def __init__(self, tokens: Tokens, training: np.ndarray) -> None:
        self.tokens, self.training = tokens, training
        self.grams: list[Grams] = []
        self.seen: list[np.ndarray] = []
        self.alone = np.zeros(0, bool)  # n-grams of the last order that no other pack has

    def next_order(self) -> tuple[Grams, np.ndarray, np.ndarray]:
        """The n-grams of the next order, the pack's own counts, and which must be asked for."""
        grams = self.tokens.grams(len(self.grams) + 1)
        own = np.bincount(grams.at[self.training & (grams.at >= 0)], minlength=len(grams.keys))
        asked = np.ones(len(grams.keys), bool)
        if self.grams:
            parts = self.grams[-1].at
            asked = ~(self.alone[parts[grams.example - 1]] | self.alone[parts[grams.example]])
        return grams, own, asked

    def learn(self, answer: np.ndarray) -> None:
        """Takes the answer for the asked n-grams of the next order: twice the count, and one more if no other pack asked."""
        grams, seen, asked = self.next_order()
        seen[asked] = answer >> 1
        self.alone = ~asked
        self.alone[asked] = answer & 1 == 1
        self.grams.append(grams)
        self.seen.append(seen)


class BackoffAutomaton:
    """States, arcs and failure arcs of the model, restricted to the n-grams of one pack.

    An n-gram that training has is an arc: from the state of its first words, over its last
    one, to the longest state that its words end with (``target``, log10 ``weight``). A state
    of ``depth`` words finds its arc for a token as the n-gram of one word more that ends there;
    ``target`` is -1 where there is none. State 0, the empty context, has one for every word.
    """

    def __init__(self, counts: Counts, total: int, distinct: int, prior: float) -> None:
        order, self.reach = len(counts.grams), len(counts.grams) - 1
        whole = total + 0.5 * (distinct + 1)
        begin = np.cumsum([0, *(len(g.keys) for g in counts.grams)])
        self.arc_at = np.stack([g.at + b for g, b in zip(counts.grams, begin)])  # used only where so many words came before
        self.target = np.full(begin[-1], -1, np.int64)
        self.weight = np.zeros(begin[-1])
        self.target[: begin[1]], self.weight[: begin[1]] = 0, np.log10(0.5 / whole)
        state_of = [np.zeros(0, np.int64)] * order  # the state of each n-gram, or -1
        failure, context, depth = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        states, shorter = 1, np.zeros(0)
        for n, (grams, seen) in enumerate(zip(counts.grams, counts.seen)):
            known = np.flatnonzero(seen > 0)
            ends, times = grams.example[known], seen[known]
            if n == 0:
                back = np.zeros(len(known), np.int64)
                p = (times + 0.5) / whole
            else:
                lower = counts.grams[n - 1].at
                back = state_of[n - 1][lower[ends]]
                p = (times + prior * shorter[lower[ends]]) / (counts.seen[n - 1][lower[ends - 1]] + prior)
            target = back
            if n < self.reach:
                target = states + np.arange(len(known))
                state_of[n] = np.full(len(seen), -1, np.int64)
                state_of[n][known] = target
                failure.append(back)
                context.append(times)
                depth.append(np.full(len(known), n + 1))
                states += len(known)
            shorter = np.zeros(len(seen))
            shorter[known] = p
            self.target[begin[n] + known] = target
            self.weight[begin[n] + known] = np.log10(p)
        self.depth, self.failure = np.concatenate(depth), np.concatenate(failure)
        self.failure_weight = np.log10(prior / (np.concatenate(context) + prior))

    def step(self, state: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each lane reads the token ``at`` a place: its next state and the log10 probability, over failure arcs where it must."""
        arc = self.arc_at[self.depth[state], at]
        following, cost = self.target[arc], self.weight[arc]
        stuck = np.flatnonzero(following < 0)
        here = state[stuck]
        while len(stuck):
            cost[stuck] += self.failure_weight[here]
            here = self.failure[here]
            arc = self.arc_at[self.depth[here], at[stuck]]
            following[stuck] = self.target[arc]
            cost[stuck] += self.weight[arc]
            still = following[stuck] < 0
            stuck, here = stuck[still], here[still]
        return following, cost

    def traverse(self, first: np.ndarray, piece: int = PIECE) -> np.ndarray:
        """log10 probability of each token of texts that begin at ``first``, left to right."""
        pieces = -(-np.diff(first) // piece)
        text = np.repeat(np.arange(len(pieces)), pieces)
        begin = first[text] + piece * (np.arange(len(text)) - (np.cumsum(pieces) - pieces)[text])
        stop = np.minimum(begin + piece, first[text + 1])
        early = np.maximum(begin - self.reach, first[text])
        longest = np.argsort(early - stop, kind="stable")
        begin, stop, early = begin[longest], stop[longest], early[longest]
        lengths = stop - early
        out, state = np.empty(self.arc_at.shape[1]), np.zeros(len(begin), np.int64)
        for t in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -t))  # lanes longer than t
            at = early[:live] + t
            state, cost = self.step(state[:live], at)
            due = at >= begin[:live]
            out[at[due]] = cost[due]
        return out


def held_out(ids: list[str | None]) -> np.ndarray:
    return np.array([zlib.crc32((i or "").encode()) % 5 == 1 for i in ids], bool)


def _counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, int]:
    """Of one range, twice the training count of each key, one more if one pack asked, and how many keys training has."""
    _, place, packs = np.unique(keys, return_inverse=True, return_counts=True)
    total = np.zeros(len(packs), np.int64)
    np.add.at(total, place, times)
    return (2 * total + (packs == 1))[place], int((total > 0).sum())


def text_scores(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", order: int = ORDER, prior: float = PRIOR, keys_per_owner: int = KEYS_PER_OWNER, pack_bytes: int = PACK_BYTES, piece: int = PIECE
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    narrow = docs.select(doc_id, text)
    id_field = narrow.schema[0]

    def fold(rows: pa.RecordBatch) -> np.ndarray:
        return held_out(rows.column(0).cast(pa.string()).to_pylist())

    def weigh(column: pa.Array) -> int:
        return len(split_words(column, NON_SPACE_BYTES, True).starts) + len(column)

    packs, tokens_in_all = P.write_packs(narrow, text, weigh, pack_bytes)
    owners = 1 + tokens_in_all // keys_per_owner

    def learned(rows: pa.RecordBatch, answers: tuple[np.ndarray, ...]) -> Counts:
        tokens = Tokens(rows.column(1))
        counts = Counts(tokens, ~fold(rows)[tokens.text])
        for answer in answers:
            counts.learn(answer)
        return counts

    def ask(pack: int, rows: pa.RecordBatch, *answers: np.ndarray) -> Iterator[pa.RecordBatch]:
        grams, own, asked = learned(rows, answers).next_order()
        yield P.questions(pack, grams.keys[asked], owners, times=(own[asked], "whole"))

    replies = []
    for n in range(1, order + 1):
        asked = P.over_packs(packs, replies, ask, "owner bigint, pack bigint, keys binary, times binary")
        answers = P.by_pack_once(P.answered(asked, _counted, {"keys": "sorted", "times": "whole"}, "whole"), "counts")
        replies = [*replies, (answers, "whole")]
    distinct = replies[0][0].agg(F.coalesce(F.sum("tally"), F.lit(0))).first()[0]

    def count(pack: int, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = split_words(rows.column(1), NON_SPACE_BYTES, True).counts + 1
        yield pa.RecordBatch.from_pydict({"n": [int(sizes[~fold(rows)].sum())]})

    total = P.over_packs(packs, [], count, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def score(pack: int, rows: pa.RecordBatch, *answers: np.ndarray) -> Iterator[pa.RecordBatch]:
        counts = learned(rows, answers)
        tokens, words = counts.tokens, counts.grams[0].at
        machine = BackoffAutomaton(counts, total, distinct, prior)
        seen = counts.seen[0][words]
        per_text = lambda values: np.add.reduceat(values, tokens.first[:-1])  # noqa: E731  every text has a token
        columns = [
            rows.column(0),
            pa.array(fold(rows)),
            pa.array(np.diff(tokens.first).astype(np.int64)),
            pa.array(per_text((seen > 0).astype(np.int64))),
            pa.array(np.full(rows.num_rows, total, np.int64)),
            pa.array(per_text(np.log10((seen + 0.5) / (total + 0.5 * (distinct + 1))))),
            pa.array(per_text(machine.traverse(tokens.first, piece))),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    kinds = {"held_out": T.BooleanType(), "n_tokens": T.LongType(), "n_known": T.LongType(), "train_tokens": T.LongType(), "base_score": T.DoubleType(), "score": T.DoubleType()}
    fields = [id_field, *[T.StructField(n, t) for n, t in kinds.items()]]
    return P.over_packs(packs, replies, score, T.StructType(fields))
