"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Every prefix of a word has exactly one encoding, so it has one last token. The candidates
are the tokens that end a prefix: a suffix automaton of the vocabulary gives them, longest
first. A candidate is right if it goes with the last token of the prefix before it, which
depends on the two tokens alone: undo both tokens' merges from the latest to the earliest
and see whether a merge across their border would have come first. Following the stored
tokens back from the end gives the ids that greedy merging gives, in one pass over the
word. Words of one batch are encoded side by side, position by position, in numpy.

Defined results: null and empty texts have no tokens; strings of special tokens inside a
text become those tokens, as in the tokenizers library by default; words of any length are
encoded whole; repeated rows and other columns are carried along.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewatt.llm.automaton import SuffixAutomaton
from tidewatt.llm.frames import Shared, add_struct, free_name

WORD_END = 256  # symbols from here on are bytes that end a word
# The split pattern of the vocabulary and white space in it. Letters and numbers are
# those of Unicode 16.0; newer code points are other characters to the library too.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+"
# Letters and numbers of Unicode 16.0, which the library knows and Python 3.13 does not.
UNICODE_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
]
# Lower case where the library's differs from that of Python 3.13: sigma, which takes no
# final form, and letters of Unicode 16.0 and 17.0.
LOWER = {0x03A3: 0x03C3, 0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
LONG_WORD = 1024  # symbols from which a word is encoded on its own
CELLS = 1 << 21  # word symbols in numpy at once
CACHE_BYTES = 96 << 20
ENTRY_BYTES = 200  # of objects and table beside what an entry says
LONG_ENTRY = 256  # characters from which a run or word is not remembered


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    stands = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in stands):
        stands[b] = chr(256 + k)
    return [stands[b] for b in range(256)]


def code_points(category: str) -> str:
    """A regular expression's ranges of the code points of a general category."""
    inside = [unicodedata.category(chr(c))[0] == category for c in range(0x110000)]
    newer = regex.compile(rf"\p{{{category}}}")
    for first, last in UNICODE_16:
        for c in range(first, last + 1):
            inside[c] = inside[c] or bool(newer.match(chr(c)))
    edges = np.flatnonzero(np.diff(np.array([False, *inside, False]).astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2).tolist())


class Lookup:
    """A map from integers to integers for whole arrays; -1 where there is no entry."""

    def __init__(self, entries: dict[int, int]) -> None:
        self.keys = np.array(sorted(entries), np.int64)
        self.values = np.array([entries[k] for k in self.keys.tolist()], np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], -1)


class Vocabulary:
    """Tables of a word-end BPE vocabulary. Tokens are numbered: 512 symbols, then merges in order."""

    def __init__(self, model: dict) -> None:
        ids, suffix = model["model"]["vocab"], model["model"]["end_of_word_suffix"]
        characters = byte_characters()
        texts = characters + [c + suffix for c in characters]
        number = {t: k for k, t in enumerate(texts)}
        symbols: list[tuple[int, ...]] = [(k,) for k in range(2 * WORD_END)]
        left, right = list(range(2 * WORD_END)), list(range(2 * WORD_END))
        pairs: dict[tuple[int, int], int] = {}
        for a, b in model["model"]["merges"]:
            k = len(texts)
            if a + b in number:
                raise ValueError(f"two merges make the token {a + b!r}")
            texts.append(a + b)
            number[a + b] = k
            left.append(number[a])
            right.append(number[b])
            symbols.append(symbols[left[k]] + symbols[right[k]])
            pairs[left[k], right[k]] = k
        self.ids = np.array([ids[t] for t in texts], np.uint32)
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.pattern = SPLIT.format(letters=code_points("L"), numbers=code_points("N"), space=SPACE)
        self.tokens = len(texts)
        self.sizes = np.array([len(s) for s in symbols], np.int64)
        self.pairs = Lookup({a * self.tokens + b: k for (a, b), k in pairs.items()})
        reachable = np.ones(self.tokens, bool)
        merged = np.arange(2 * WORD_END, self.tokens)
        good = self.compatible(self.left[merged], self.right[merged], merged)
        for k, fits in zip(merged.tolist(), good.tolist()):
            reachable[k] = fits and reachable[left[k]] and reachable[right[k]]
        machine = SuffixAutomaton()
        for k in np.flatnonzero(reachable).tolist():
            machine.add(symbols[k])
        token = [-1] * len(machine.link)
        for k in np.flatnonzero(reachable).tolist():
            state = 0
            for symbol in symbols[k]:
                state = machine.next[state][symbol]
            token[state] = k
        self.token = np.array(token, np.int64)
        self.nearest = np.array(machine.nearest([t >= 0 for t in token]), np.int64)
        self.link, self.length = np.array(machine.link, np.int64), np.array(machine.length, np.int64)
        self.moves = Lookup({s * 2 * WORD_END + c: t for s, row in enumerate(machine.next) for c, t in row.items()})
        self.strings = {i: t for t, i in ids.items()}
        self.plain: tuple | None = None  # the tables as dicts and lists, when a long word needs them
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.strings.update({i: t for t, i in self.special.items()})

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether tokens a and b can stand side by side, undoing merges from the latest on.

        ``limit`` is the merge that was undone last: a merge across the border that comes
        before it would have been made instead. Of equal merges the left one comes first.
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), self.tokens, np.int64) if before is None else before.copy()
        fits = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            across = self.pairs[x * self.tokens + y]
            clash = (across >= 0) & (across < limit[open_])
            fits[open_[clash]] = False
            x_made, y_made = self.left[x] != x, self.right[y] != y
            undo_x = x_made & ((x > y) | ~y_made)
            undo_y = y_made & ~undo_x
            limit[open_] = np.where(undo_x, x, np.where(undo_y, y + 1, limit[open_]))
            a[open_] = np.where(undo_x, self.right[x], x)
            b[open_] = np.where(undo_y, self.left[y], y)
            open_ = open_[~clash & (undo_x | undo_y)]
        return fits

    def encode_symbols(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words given as rows of symbols, longest word first: all in a row, and how many each has."""
        n, width = symbols.shape
        last = np.full((n, width + 1), -1, np.int32)
        state, matched = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in range(width):
            m = int(np.searchsorted(-lengths, -i, side="left"))  # words longer than i
            self._advance(state[:m], matched[:m], symbols[:m, i].astype(np.int64))
            candidate = self.nearest[state[:m]]
            shorter = self.length[candidate] > matched[:m]
            candidate = np.where(shorter, self.nearest[self.link[candidate]], candidate)
            open_ = np.arange(m)
            while len(open_):
                c = candidate[open_]
                token, begin = self.token[c], i + 1 - self.length[c]
                fits = begin == 0
                inner = np.flatnonzero(~fits)
                fits[inner] = self.compatible(last[open_[inner], begin[inner]].astype(np.int64), token[inner])
                last[open_[fits], i + 1] = token[fits]
                candidate[open_] = self.nearest[self.link[c]]
                open_ = open_[~fits]
        return self._followed_back(last, lengths)

    def _advance(self, state: np.ndarray, matched: np.ndarray, symbol: np.ndarray) -> None:
        """The longest match of each word, one symbol on. Every symbol is a token, so one exists."""
        open_ = np.arange(len(state))
        while len(open_):
            there = self.moves[state[open_] * 2 * WORD_END + symbol[open_]]
            done = there >= 0
            state[open_[done]] = there[done]
            matched[open_[done]] += 1
            open_ = open_[~done]
            state[open_] = self.link[state[open_]]
            matched[open_] = self.length[state[open_]]

    def _followed_back(self, last: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, steps = lengths.copy(), []
        while (live := at > 0).any():
            token = np.where(live, last[np.arange(len(at)), at], -1)
            steps.append(token)
            at = np.where(live, at - self.sizes[token], 0)
        back = np.array(steps[::-1], np.int64).reshape(len(steps), len(at)).T
        return back[back >= 0], (back >= 0).sum(axis=1)

    def encode_long(self, symbols: list[int]) -> list[int]:
        """The same for one word, symbol by symbol, with plain integers."""
        if self.plain is None:  # once in a task
            self.plain = (
                dict(zip(self.moves.keys.tolist(), self.moves.values.tolist())),
                dict(zip(self.pairs.keys.tolist(), self.pairs.values.tolist())),
                *(v.tolist() for v in (self.left, self.right, self.link, self.length, self.nearest, self.token)),
            )
        moves, pairs, left, right, link, length, nearest, token = self.plain
        seen: dict[tuple[int, int], bool] = {}

        def fits(a: int, b: int) -> bool:
            limit = self.tokens
            while True:
                if pairs.get(a * self.tokens + b, limit) < limit:
                    return False
                if left[a] != a and (a > b or right[b] == b):
                    limit, a = a, right[a]
                elif right[b] != b:
                    limit, b = b + 1, left[b]
                else:
                    return True

        last, state, matched = [-1], 0, 0
        for i, symbol in enumerate(symbols, 1):
            while (there := moves.get(state * 2 * WORD_END + symbol)) is None:
                state = link[state]
                matched = length[state]
            state, matched = there, matched + 1
            candidate = nearest[state]
            if length[candidate] > matched:
                candidate = nearest[link[candidate]]
            while True:
                t, before = token[candidate], last[i - length[candidate]]
                if before < 0:
                    break
                if (good := seen.get((before, t))) is None:
                    good = seen[before, t] = fits(before, t)
                if good:
                    break
                candidate = nearest[link[candidate]]
            last.append(t)
        out, at = [], len(symbols)
        while at:
            out.append(last[at])
            at -= int(self.sizes[last[at]])
        return out[::-1]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        out: list[bytes] = [b""] * len(words)
        at = 0
        while at < len(order) and len(words[order[at]]) > LONG_WORD:
            word = words[order[at]]
            out[order[at]] = self.ids[self.encode_long([*word[:-1], word[-1] + WORD_END])].astype("<u4").tobytes()
            at += 1
        while at < len(order):
            width = len(words[order[at]])
            part = order[at : at + max(1, CELLS // (width + 1))]
            lengths = np.array([len(words[i]) for i in part], np.int64)
            inside = np.arange(width) < lengths[:, None]
            symbols = np.zeros((len(part), width), np.int16)
            symbols[inside] = np.frombuffer(b"".join([words[i] for i in part]), np.uint8)
            symbols[np.arange(len(part)), lengths - 1] += WORD_END
            tokens, counts = self.encode_symbols(symbols, lengths)
            coded, ends = self.ids[tokens].astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
            for i, begin, end in zip(part, [0, *ends], ends):
                out[i] = coded[begin:end]
            at += len(part)
        return out


class Encoder:
    """Texts to ids in one task; remembers runs between spaces that it has seen, up to a bound in bytes.

    The split never crosses a space, normalisation never reaches across one, and a run of letters is a
    word, so a run that was seen before needs neither.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.split = re.compile(vocabulary.pattern)
        self.unlike = re.compile("[" + "".join(map(chr, LOWER)) + "]")
        spaces = [chr(c) for c in range(0x3001) if re.match(f"[{SPACE}]", chr(c))]
        self.plain_spaces = [c for c in spaces if c.isascii() and c != " "]
        self.wide_spaces = [c for c in spaces if not c.isascii()]
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True)) + ")") if vocabulary.special else None
        self.known: dict[str, bytes] = {}  # ids of runs
        self.words: dict[str, bytes] = {}  # ids of their words
        self.held = 0
        self.fixed = {s: int(i).to_bytes(4, "little") for s, i in vocabulary.special.items()}
        self.strings = [vocabulary.strings.get(i, "") for i in range(max(vocabulary.strings) + 1)]

    def runs(self, text: str) -> list[str]:
        """What stands between spaces."""
        for space in self.plain_spaces if text.isascii() else self.plain_spaces + self.wide_spaces:
            text = text.replace(space, " ")
        return [run for run in text.split(" ") if run]

    def words_of(self, run: str) -> list[str]:
        if not run.isascii():
            run = unicodedata.normalize("NFC", run)
            if self.unlike.search(run):
                run = run.translate(LOWER)
        run = run.lower()
        return [run] if run.isalpha() else self.split.findall(run)

    def pieces(self, text: str) -> list[tuple[bool, list[str]]]:
        """(whether special, runs) of a text in order."""
        if self.special is None or not self.special.search(text):
            return [(False, self.runs(text))]
        return [(True, [part]) if part in self.fixed else (False, self.runs(part)) for part in self.special.split(text)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        found = [self.pieces(t or "") for t in texts]
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.words.clear()
            self.held = 0
        known, words = self.known, self.words
        runs = {run for pieces in found for special, parts in pieces if not special for run in parts}.difference(known)
        split = {run: self.words_of(run) for run in runs}
        new = list({w for parts in split.values() for w in parts}.difference(words))
        words.update(zip(new, self.vocabulary.encode_words([w.encode() for w in new])))
        known.update((run, b"".join(map(words.__getitem__, parts))) for run, parts in split.items())
        coded = [b"".join([self.fixed[parts[0]] if special else b"".join(map(known.__getitem__, parts)) for special, parts in pieces]) for pieces in found]
        for cache, added in ((known, split), (words, new)):
            for entry in [e for e in added if len(e) > LONG_ENTRY]:
                del cache[entry]
            # ids take about as much as what they stand for
            self.held += len(added) * ENTRY_BYTES + 2 * min(sum(map(len, added)), LONG_ENTRY * len(added))
        return coded

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' strings joined by spaces, special tokens included: this vocabulary has no decoder."""
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


def load_vocabulary(spark: SparkSession, path: str) -> Shared:
    """The tables of a vocabulary file (a fixed size), for tasks."""
    with open(path, encoding="utf-8") as file:
        return Shared(spark, Vocabulary(json.load(file)))


def _encoders(vocabulary: Shared):
    made: list[Encoder] = []

    def get() -> Encoder:
        if not made:
            made.append(Encoder(vocabulary.get()))
        return made[0]

    return get


def encode(docs: DataFrame, path: str, *, text: str = "text", into: str = "tokens") -> DataFrame:
    """``docs`` with a struct ``into``: n_tokens and ids."""
    encoder = _encoders(load_vocabulary(docs.sparkSession, path))
    fields = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def work(column: pa.Array) -> list[pa.Array]:
        coded = encoder().encode(column.to_pylist())
        sizes = np.array([len(c) // 4 for c in coded], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        ids = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
        return [pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))]

    return add_struct(docs, text, free_name(docs, into), fields, work)


def decode(encoded: DataFrame, path: str, *, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its column of ids; null ids give null."""
    encoder = _encoders(load_vocabulary(encoded.sparkSession, path))
    at, name = [c.lower() for c in encoded.columns].index(ids.lower()), free_name(encoded, into)

    def run(batches):
        for batch in batches:
            texts = [None if v is None else encoder().decode(np.array(v, np.int64)) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(name, T.StringType())]))


def token_digest(docs: DataFrame, path: str, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    encoder = _encoders(load_vocabulary(docs.sparkSession, path))
    narrow = docs.select(doc_id, text)
    name = free_name(narrow, "digest")
    fields = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def work(column: pa.Array) -> list[pa.Array]:
        coder = encoder()
        coded = coder.encode(column.to_pylist())
        decoded = [hashlib.sha256(coder.decode(np.frombuffer(c, "<u4")).encode()).hexdigest() for c in coded]
        return [pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()), pa.array(decoded, pa.string())]

    return add_struct(narrow, text, name, fields, work).select(doc_id, f"{name}.*")
