"""Toxicity: a bidirectional gated recurrent network with attention pooling, over windows of words.

A word (a run of letters, digits and bytes above 0x7F, A-Z in lower case) enters as the vector of
its entry in a vocabulary, next to the scaled sum of vectors of its hashed byte sequences of ``GRAMS``
lengths, word edges included. Two gated recurrent units read each window of ``WINDOW`` words, one
from each end; attention over their states gives one vector and one logit. Windows begin every ``STRIDE``
words, so each word stands in two; a text scores as its most toxic window. All windows
of the whole text are scored. Input gates are computed once for each distinct word of a slice, and windows
step side by side in numpy.

Labels are known for documents only. Training first takes random windows of each labelled
document, then those that score highest so far: the most toxic window of a toxic document must
be toxic, and the most suspicious windows of others must not. It runs in one task on a bounded
sample: the ``sample`` documents outside fold 1 whose hashed ids come first, of each at most
``TRAIN_WINDOWS`` windows spread over the whole text.

Defined results: a null or empty text, or one without words, scores as a window without words; a
document labelled several times counts with its mean label; null labels are ignored; rows that repeat
an id are scored each and used for training once; a null id is in fold crc32(''). Without labelled documents
to train on the network is unfitted, and every score is 0.5. Clashing column names are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatt.llm.frames import Shared, add_struct, free_name, released, small_batches
from tidewatt.llm.words import ALNUM_BYTES, Words, hash_words, mixed, slices, split_words
from tidewatt.session import staged

WINDOW, STRIDE = 48, 24
GRAMS = (3, 5)
BUCKETS = 1 << 14
WORD_SIZE, GRAM_SIZE, STATES = 8, 12, 10
VOCABULARY, LEAST_TEXTS = 8192, 4
SAMPLE = 6_000
TRAIN_WINDOWS = 32
RANDOM_EPOCHS, EPOCHS, BATCH, RATE, DECAY = 3, 9, 128, 0.006, 1e-6
SIDE_BY_SIDE = 1024
THRESHOLD = 0.7
EDGE = np.uint64(256)  # stands before and after a word
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd constant of a published hash


def grams(words: Words, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte sequences of the words ``of``, and where each word's begin."""
    sizes = (words.ends - words.starts)[of]
    padded = sizes + 2
    begin = np.concatenate([[0], np.cumsum(padded)])
    letters = np.full(begin[-1], EDGE, np.uint64)
    inside = np.ones(begin[-1], bool)
    inside[begin[:-1]] = inside[begin[1:] - 1] = False
    source = np.repeat(words.starts[of] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    letters[inside] = words.data[source]
    found, owner = [], []
    for n in GRAMS:
        room = np.maximum(padded - (n - 1), 0)
        at = np.repeat(begin[:-1] - np.concatenate([[0], np.cumsum(room)[:-1]]), room) + np.arange(room.sum())
        value = np.full(len(at), np.uint64(n), np.uint64)
        for k in range(n):
            value = (value + letters[at + k]) * MULTIPLIER
        found.append((mixed(value) & np.uint64(BUCKETS - 1)).astype(np.int32))
        owner.append(np.repeat(np.arange(len(of)), room))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(of)))])


def windows_of(counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and number of words of every window; a text without words has one empty window."""
    number = np.maximum(-(-(counts - WINDOW) // STRIDE), 0) + 1
    text = np.repeat(np.arange(len(counts)), number)
    k = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    begin = np.minimum(k * STRIDE, np.maximum(counts - WINDOW, 0)[text])
    return text, first[text] + begin, np.minimum(counts[text], WINDOW)


class Network:
    """Parameters, and the passes that use them. Direction 0 reads from the first word, 1 from the last."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        inputs, h = WORD_SIZE + GRAM_SIZE, STATES

        def normal(scale: float, *shape: int) -> np.ndarray:
            return (r.normal(size=shape) * scale).astype(np.float32)

        self.vocabulary = vocabulary  # sorted hashes
        self.fitted = False
        self.values = {
            "word": normal(0.3, len(vocabulary) + 1, WORD_SIZE),
            "gram": normal(0.3, BUCKETS, GRAM_SIZE),
            "input": normal(inputs**-0.5, 2, inputs, 3 * h),
            "state": normal(h**-0.5, 2, h, 3 * h),
            "bias": np.zeros((2, 3 * h), np.float32),
            "look": normal(0.3, 2, h),
            "out": normal(0.3, 2, h),
            "level": np.zeros(1, np.float32),
        }

    def entry(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words in the vocabulary; the last is for all others."""
        size = len(self.vocabulary)
        if not size:
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), size - 1)
        return np.where(self.vocabulary[at] == hashes, at, size)

    def vectors(self, entry: np.ndarray, gram: np.ndarray, begin: np.ndarray) -> np.ndarray:
        p = self.values
        summed = np.add.reduceat(p["gram"][gram], begin[:-1], axis=0) if len(entry) else np.zeros((0, GRAM_SIZE), np.float32)
        return np.concatenate([p["word"][entry], summed / np.sqrt(np.diff(begin), dtype=np.float32)[:, None]], axis=1)

    def read(self, gates: np.ndarray, index: np.ndarray, sizes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows. ``gates``: input gates (word, direction, 3 h); ``index``: the words of each window."""
        p, h = self.values, STATES
        count, steps = index.shape
        position = np.arange(steps)
        live = position < sizes[:, None]
        back = np.where(live, sizes[:, None] - 1 - position, position)  # reading from the end; also its own inverse
        turned = np.take_along_axis(index, back, axis=1)
        kind = p["state"].dtype
        state = np.zeros((2, count, h), kind)
        states = np.empty((steps, 2, count, h), kind)
        kept = []
        for t in range(steps):
            x = np.stack([gates[index[:, t], 0], gates[turned[:, t], 1]])
            recurrent = state @ p["state"]
            rz = np.tanh((x[..., : 2 * h] + recurrent[..., : 2 * h]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
            r, z = rz[..., :h], rz[..., h:]
            n = np.tanh(x[..., 2 * h :] + r * recurrent[..., 2 * h :])
            new = n + z * (state - n)
            if not live[:, t].all():
                new = np.where(live[:, t, None], new, state)
            if keep:
                kept.append((state, r, z, n, recurrent[..., 2 * h :]))
            state = new
            states[t] = new
        # (window, position, direction, h): what each word is read as from both sides
        both = np.stack([states[:, 0].swapaxes(0, 1), np.take_along_axis(states[:, 1].swapaxes(0, 1), back[..., None], axis=1)], axis=2)
        look = np.where(live, np.tensordot(both, p["look"], 2), np.float32(-1e9))
        weight = np.exp(look - look.max(axis=1, keepdims=True)) * live if steps else look
        weight = weight / np.maximum(weight.sum(axis=1, keepdims=True), np.float32(1e-9))
        pooled = np.einsum("nt,ntdh->ndh", weight, both)
        return np.tensordot(pooled, p["out"], 2) + p["level"], {"both": both, "weight": weight, "pooled": pooled, "kept": kept, "live": live, "back": back, "turned": turned}

    def slopes(self, error: np.ndarray, index: np.ndarray, vectors: np.ndarray, entry: np.ndarray, gram: np.ndarray, begin: np.ndarray, run: dict) -> dict[str, np.ndarray]:
        """Gradients from the errors of the logits, back through attention, both units, and the inputs."""
        p, h = self.values, STATES
        both, weight, live, back = run["both"], run["weight"], run["live"], run["back"]
        count, steps = index.shape
        g = {"out": np.einsum("n,ndh->dh", error, run["pooled"]), "level": error.sum(keepdims=True)}
        pooled = error[:, None, None] * p["out"]
        by_weight = np.einsum("ndh,ntdh->nt", pooled, both)
        look = weight * (by_weight - (weight * by_weight).sum(axis=1, keepdims=True))
        g["look"] = np.einsum("nt,ntdh->dh", look, both)
        to_states = weight[..., None, None] * pooled[:, None] + look[..., None, None] * p["look"]
        outer = np.stack([to_states[:, :, 0], np.take_along_axis(to_states[:, :, 1], back[..., None], axis=1)])  # in the order read
        g["state"] = np.zeros_like(p["state"])
        kind = p["state"].dtype
        to_gates = np.empty((steps, 2, count, 3 * h), kind)
        later = np.zeros((2, count, h), kind)
        turned_state = p["state"].swapaxes(1, 2)
        for t in range(steps - 1, -1, -1):
            before, r, z, n, recurrent = run["kept"][t]
            total = later + outer[:, :, t]
            on = live[:, t, None]
            d = np.where(on, total, 0)
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (before - n) * z * (1 - z)
            dr = dn * recurrent * r * (1 - r)
            to_gates[t] = np.concatenate([dr, dz, dn], axis=-1)
            inner = np.concatenate([dr, dz, dn * r], axis=-1)
            g["state"] += before.swapaxes(1, 2) @ inner
            later = np.where(on, d * z + inner @ turned_state, total)
        gates = np.zeros((2, len(vectors), 3 * h))
        for direction, words in enumerate((index, run["turned"])):
            at, part = words.T[live.T], to_gates[:, direction][live.T]
            for k in range(3 * h):
                gates[direction, :, k] = np.bincount(at, part[:, k], len(vectors))
        gates = gates.astype(kind)
        g["bias"] = gates.sum(axis=1)
        g["input"] = vectors.T[None] @ gates
        into = sum(gates[d] @ p["input"][d].T for d in (0, 1))
        g["word"] = np.stack([np.bincount(entry, into[:, k], len(p["word"])) for k in range(WORD_SIZE)], axis=1)
        sizes = np.diff(begin)
        spread = np.repeat(into[:, WORD_SIZE:] / np.sqrt(sizes)[:, None], sizes, axis=0)
        g["gram"] = np.stack([np.bincount(gram, spread[:, k], BUCKETS) for k in range(GRAM_SIZE)], axis=1)
        return g

    def gates(self, vectors: np.ndarray) -> np.ndarray:
        return (np.einsum("ui,dig->udg", vectors, self.values["input"], optimize=True) + self.values["bias"]).astype(self.values["state"].dtype)

    def logits(self, gates: np.ndarray, word: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of every window: ``word`` numbers the distinct word at each place of the texts."""
        out = np.empty(len(begin), np.float32)
        order = np.argsort(sizes, kind="stable")
        for at in range(0, len(order), SIDE_BY_SIDE):
            rows = order[at : at + SIDE_BY_SIDE]
            out[rows] = self.read(gates, indices(word, begin[rows], sizes[rows]), sizes[rows])[0]
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        """The probability of each text."""
        if not self.fitted:
            return np.full(len(column), 0.5)
        words = split_words(column, ALNUM_BYTES, True)
        hashes, of, word = np.unique(hash_words(words), return_index=True, return_inverse=True)
        gates = np.concatenate([self.gates(self.vectors(self.entry(hashes[a : a + 65536]), *grams(words, of[a : a + 65536]))) for a in range(0, max(len(of), 1), 65536)])
        text, begin, sizes = windows_of(words.counts, words.first[:-1])
        logit = self.logits(gates, word, begin, sizes)
        most = np.full(len(column), -np.inf)
        np.maximum.at(most, text, logit)
        return 1 / (1 + np.exp(-np.clip(most, -30, 30)))

    def fit(self, texts: list[list[str]], label: np.ndarray, seed: int = 5) -> None:
        """``texts`` holds the windows of each document. Adam on the logistic loss of chosen windows."""
        r = np.random.default_rng(seed)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        column = pa.array([w for t in texts for w in t], pa.large_string())
        words = split_words(column, ALNUM_BYTES, True)
        hashes, of, word = np.unique(hash_words(words), return_index=True, return_inverse=True)
        entry, (gram, first_gram) = self.entry(hashes), grams(words, of)
        begin, sizes = words.first[:-1], words.counts
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        share = np.clip(label.mean(), 0.02, 0.98)
        importance = np.where(label > 0.5, min(0.3 / share, 6.0), 1.0)
        slope = {k: np.zeros_like(v) for k, v in self.values.items()}
        square = {k: np.zeros_like(v) for k, v in self.values.items()}
        step = 0
        for epoch in range(EPOCHS):
            if epoch < RANDOM_EPOCHS:
                chosen = first[:-1, None] + (r.random((len(texts), 3)) * np.diff(first)[:, None]).astype(np.int64)
                chosen = np.unique(chosen)
            else:
                gates = np.concatenate([self.gates(self.vectors(entry[a : a + 65536], gram[first_gram[a] : first_gram[min(a + 65536, len(of))]], first_gram[a : a + 65537] - first_gram[a])) for a in range(0, max(len(of), 1), 65536)])
                logit = self.logits(gates, word, begin, sizes)
                ranked = np.lexsort((-logit, owner))
                place = np.arange(len(owner)) - first[owner[ranked]]
                chosen = ranked[(place == 0) | ((place == 1) & (label[owner[ranked]] < 0.5))]
            for at, rows in enumerate(np.array_split(r.permutation(chosen), max(1, len(chosen) // BATCH))):
                step += 1
                index = indices(word, begin[rows], sizes[rows])
                used, local = np.unique(index, return_inverse=True)
                local = local.reshape(index.shape)
                pick, begins = picked(first_gram, used)
                vectors = self.vectors(entry[used], gram[pick], begins)
                logit, run = self.read(self.gates(vectors), local, sizes[rows], keep=True)
                error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label[owner[rows]]) * importance[owner[rows]] / len(rows)
                found = self.slopes(error.astype(np.float32), local, vectors, entry[used], gram[pick], begins, run)
                norm = np.sqrt(sum(float((v**2).sum()) for v in found.values()))
                rate = RATE * (1 - 0.9 * (epoch + at * BATCH / len(chosen)) / EPOCHS)
                for k, v in self.values.items():
                    g = found[k].astype(np.float32) * np.float32(min(1.0, 5.0 / max(norm, 1e-9))) + np.float32(DECAY) * v
                    slope[k] += np.float32(0.1) * (g - slope[k])
                    square[k] += np.float32(0.01) * (g * g - square[k])
                    v -= np.float32(rate / (1 - 0.9**step)) * slope[k] / (np.sqrt(square[k] / np.float32(1 - 0.99**step)) + np.float32(1e-8))
        self.fitted = True


def indices(word: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The distinct words of each window, a row each; what follows a window's end is word 0 and not read."""
    steps = int(sizes.max()) if len(sizes) else 0
    at = begin[:, None] + np.arange(steps)
    return np.where(np.arange(steps) < sizes[:, None], word[np.minimum(at, max(len(word) - 1, 0))] if len(word) else 0, 0)


def picked(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the entries of ``rows`` lie, and where each row's begin among them."""
    sizes = (first[1:] - first[:-1])[rows]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    return np.repeat(first[rows] - begins[:-1], sizes) + np.arange(begins[-1]), begins


def vocabulary_of(texts: list[list[str]]) -> np.ndarray:
    """Sorted hashes of the words that most documents have."""
    words = split_words(pa.array([" ".join(t) for t in texts], pa.large_string()), ALNUM_BYTES, True)
    pairs = np.unique(np.stack([hash_words(words), words.text_of_word().astype(np.uint64)], axis=1), axis=0) if len(words.starts) else np.zeros((0, 2), np.uint64)
    hashes, times = np.unique(pairs[:, 0], return_counts=True)
    order = np.lexsort((hashes, -times))[:VOCABULARY]
    return np.sort(hashes[order[times[order] >= LEAST_TEXTS]])


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def spread_windows(column: pa.Array) -> pa.Array:
    """At most TRAIN_WINDOWS windows of each text, spread over it, as strings of words."""
    words = split_words(column, ALNUM_BYTES, True)
    text, begin, sizes = windows_of(words.counts, words.first[:-1])
    first = np.searchsorted(text, np.arange(len(column) + 1))
    out = []
    for i in range(len(column)):
        n = first[i + 1] - first[i]
        take = first[i] + np.unique(np.linspace(0, n - 1, min(n, TRAIN_WINDOWS)).astype(np.int64))
        out.append([words.data[words.starts[begin[w]] : words.ends[begin[w] + sizes[w] - 1]].tobytes().decode() if sizes[w] else "" for w in take])
    return pa.array(out, pa.list_(pa.string()))


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Network:
    """A network from the labelled documents outside fold 1, at most ``sample`` of them; not fitted if there are none."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.avg(label).alias("label")).where(fold(F.col("id")) != 1)
    narrow = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    ids = staged(known.join(narrow.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample), "sample")  # bounded by its limit
    rows = narrow.join(F.broadcast(ids), "id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(2), spread_windows(part.column(1))], names=["id", "label", "windows"])

    extracted = small_batches(rows).mapInArrow(lambda batches: released(extract(batches)), "id string, label double, windows array<string>")
    extracted = extracted.groupBy("id", "label").agg(F.min("windows").alias("windows"))  # of a repeated id the smallest

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        texts = table.column("windows").to_pylist()
        network = Network(vocabulary_of(texts))
        network.fit(texts, table.column("label").to_numpy())
        out = io.BytesIO()
        np.savez(out, vocabulary=network.vocabulary, **network.values)
        return pa.table({"network": pa.array([out.getvalue()], pa.binary())})

    rows = extracted.withColumn("network", F.lit(0)).groupBy("network").applyInArrow(fit, "network binary").collect()  # the bounded sample in one task
    if not rows:
        return Network(np.zeros(0, np.uint64))
    stored = dict(np.load(io.BytesIO(rows[0]["network"])))
    network = Network(stored.pop("vocabulary"))
    network.values, network.fitted = stored, True
    return network


def scored(docs: DataFrame, network: Network, *, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct ``into`` that holds ``score``."""
    sent = Shared(docs.sparkSession, network)

    def work(column: pa.Array) -> list[pa.Array]:
        return [pa.array(sent.get().score(column), pa.float64())]

    return add_struct(docs, text, free_name(docs, into), T.StructType([T.StructField("score", T.DoubleType())]), work)


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = scored(docs.select(doc_id, text), train(docs, labels, text=text, doc_id=doc_id, **options), text=text)
    score = F.col(out.columns[-1])["score"]
    return out.select(doc_id, (fold(F.col(doc_id)) == 1).alias("held_out"), score.alias("score"), F.when(score >= threshold, 1).otherwise(0).alias("predicted"))
