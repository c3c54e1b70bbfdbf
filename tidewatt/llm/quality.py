"""Quality classifier: a factorisation machine over hashed words and structure statistics.

Inputs of a score come from the text alone: hashed words with normalised counts, and
standardised statistics of characters, words and lines. Every pair of inputs interacts
through low-rank factors; the sum over pairs is half the square of the sum less the sum of
squares, so a score takes time linear in the words of the text. Texts are scored whole.

The machine is trained on a bounded sample of the labelled documents: the ``sample`` of them
whose hashed ids come first. Fitting runs in one task, on features of bounded size.

Defined results: a null or empty text has the statistics of no words and gets a score; a
document labelled several times counts with its mean label; null labels are ignored; rows
that repeat an id are scored each and used for training once; a null id is in fold crc32('').
Without any labelled document to train on, the machine is not fitted: its scores say nothing, and
``keep_good`` keeps every document.
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
from tidewatt.llm.words import NON_SPACE_BYTES, Words, hash_words, slices, split_words, utf8
from tidewatt.session import staged

HASHED = 1 << 16
FACTORS = 8
SAMPLE = 10_000
EPOCHS, BATCH, RATE, DECAY = 8, 256, 0.02, 1e-5
THRESHOLD = 0.7

_byte = np.arange(256)
_marks = np.isin(_byte, [ord(c) for c in "#$%&*|<>=~^@\\{}[]_+"])
#: Byte classes whose share of the text is a statistic.
CLASSES = {
    "upper": (_byte >= 65) & (_byte <= 90),
    "lower": (_byte >= 97) & (_byte <= 122),
    "digit": (_byte >= 48) & (_byte <= 57),
    "mark": _marks,
    "stop": np.isin(_byte, [ord(c) for c in ".,;:?"]),
    "shout": _byte == ord("!"),
    "line": _byte == 10,
    "high": _byte >= 128,
}
STATISTICS = len(CLASSES) + 8


def structure(words: Words, hashes: np.ndarray, raw: np.ndarray, offsets: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Statistics of each text, a row each."""
    size = np.diff(offsets).astype(float)
    count = words.counts.astype(float)

    def total(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
        return sums[edges[1:]] - sums[edges[:-1]]

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return part / np.maximum(whole, 1)

    out = [share(total(member[raw], offsets), size) for member in CLASSES.values()]
    lengths = (words.ends - words.starts).astype(float)
    last = raw[words.ends - 1] if len(words.ends) else np.zeros(0, np.uint8)
    head = raw[words.starts] if len(words.starts) else np.zeros(0, np.uint8)
    same = np.zeros(len(hashes))
    if len(hashes) > 2:
        owner = words.text_of_word()
        same[2:] = (hashes[2:] == hashes[:-2]) & (owner[2:] == owner[:-2])
    lines = share(total(CLASSES["line"][raw], offsets) + 1, np.ones(len(size)))
    out += [
        np.log1p(size),
        np.log1p(share(count, lines)),
        share(total(lengths, words.first), count),
        share(total(lengths * lengths, words.first), count) ** 0.5,
        share(distinct, count),
        share(total(CLASSES["upper"][head], words.first), count),
        share(total(_marks[last] | CLASSES["shout"][last], words.first), count),
        share(total(same, words.first), count),
    ]
    return np.stack(out, axis=1)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words of each text: where its entries begin, their numbers and values; and its statistics."""
    words = split_words(column, NON_SPACE_BYTES, True)
    hashes = hash_words(words)
    entry = (words.text_of_word().astype(np.int64) << 16) | (hashes & np.uint64(HASHED - 1)).astype(np.int64)
    entry, times = np.unique(entry, return_counts=True)
    text = entry >> 16
    first = np.searchsorted(text, np.arange(len(column) + 1))
    weight = np.log1p(times)
    norm = np.sqrt(np.bincount(text, weight * weight, len(column)))
    raw, offsets = utf8(column)
    return first, (entry & (HASHED - 1)).astype(np.int32), weight / norm[text], structure(words, hashes, raw, offsets, np.diff(first))


class Machine:
    """Weights of single inputs and factors of their pairs; hashed words first, then statistics."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, seed: int = 7) -> None:
        inputs = HASHED + len(mean)
        self.mean, self.deviation = mean, deviation
        self.fitted = False
        self.bias = np.zeros(1)
        self.weight = np.zeros(inputs)
        self.factor = np.random.default_rng(seed).normal(0, 0.02, (inputs, FACTORS))

    def entries(self, first, number, value, statistics) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, input, value) of all inputs, statistics standardised and bounded."""
        texts = len(first) - 1
        scaled = np.clip((statistics - self.mean) / self.deviation, -5, 5) / np.sqrt(len(self.mean))
        text = np.concatenate([np.repeat(np.arange(texts), np.diff(first)), np.repeat(np.arange(texts), len(self.mean))])
        number = np.concatenate([number, np.tile(HASHED + np.arange(len(self.mean)), texts)])
        return text, number, np.concatenate([value, scaled.reshape(-1)])

    def margin(self, text, number, value, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """The machine's output, and the sums of factors that the gradient needs."""
        out = self.bias + np.bincount(text, self.weight[number] * value, texts)
        sums = np.empty((texts, FACTORS))
        for f in range(FACTORS):
            part = self.factor[number, f] * value
            sums[:, f] = np.bincount(text, part, texts)
            out = out + 0.5 * (sums[:, f] ** 2 - np.bincount(text, part * part, texts))
        return out, sums

    def score(self, first, number, value, statistics) -> np.ndarray:
        entries = self.entries(first, number, value, statistics)
        margin, _ = self.margin(*entries, len(first) - 1)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    def fit(self, first, number, value, statistics, label: np.ndarray, seed: int = 11) -> None:
        """Adam on the logistic loss, in batches of a fixed random order."""
        values = [self.bias, self.weight, self.factor]
        slope, square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
        random, step, inputs = np.random.default_rng(seed), 0, len(self.weight)
        sizes = np.diff(first)
        for epoch in range(EPOCHS):
            order = random.permutation(len(label))
            for at in range(0, len(order), BATCH):
                rows = np.sort(order[at : at + BATCH])
                pick = np.repeat(first[rows] - np.concatenate([[0], np.cumsum(sizes[rows])[:-1]]), sizes[rows]) + np.arange(sizes[rows].sum())
                begins = np.concatenate([[0], np.cumsum(sizes[rows])])
                text, n, x = self.entries(begins, number[pick], value[pick], statistics[rows])
                margin, sums = self.margin(text, n, x, len(rows))
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[rows]) / len(rows)
                push = error[text] * x
                by_factor = np.stack([np.bincount(n, push * (sums[text, f] - self.factor[n, f] * x), inputs) for f in range(FACTORS)], axis=1)
                step += 1
                for v, s, q, g in zip(values, slope, square, [np.array([error.sum()]), np.bincount(n, push, inputs), by_factor]):
                    g = g + DECAY * v
                    s += 0.1 * (g - s)
                    q += 0.01 * (g * g - q)
                    v -= RATE * (s / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-8)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Machine:
    """A machine from the labelled documents outside fold 2, at most ``sample`` of them; not fitted if there are none."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.avg(label).alias("label")).where(fold(F.col("id")) != 2)
    narrow = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    ids = staged(known.join(narrow.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample), "sample")  # bounded by its limit
    rows = narrow.join(F.broadcast(ids), "id").dropDuplicates(["id"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                first, number, value, statistics = features(part.column(1))
                numbers = [number[a:b].astype("<i4").tobytes() for a, b in zip(first[:-1], first[1:])]
                values = [value[a:b].astype("<f4").tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(2), pa.array(numbers, pa.binary()), pa.array(values, pa.binary()), pa.array([s.tobytes() for s in statistics], pa.binary())], names=["id", "label", "numbers", "values", "statistics"])

    extracted = small_batches(rows).mapInArrow(lambda batches: released(extract(batches)), "id string, label double, numbers binary, values binary, statistics binary")

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        numbers = [np.frombuffer(v.as_py(), "<i4") for v in table.column("numbers")]
        values = np.concatenate([np.frombuffer(v.as_py(), "<f4") for v in table.column("values")]).astype(float)
        statistics = np.stack([np.frombuffer(v.as_py(), float) for v in table.column("statistics")])
        first = np.concatenate([[0], np.cumsum([len(n) for n in numbers])])
        machine = Machine(statistics.mean(axis=0), statistics.std(axis=0) + 1e-6)
        machine.fit(first, np.concatenate(numbers), values, statistics, table.column("label").to_numpy())
        out = io.BytesIO()
        np.savez(out, mean=machine.mean, deviation=machine.deviation, bias=machine.bias, weight=machine.weight, factor=machine.factor)
        return pa.table({"machine": pa.array([out.getvalue()], pa.binary())})

    rows = extracted.withColumn("machine", F.lit(0)).groupBy("machine").applyInArrow(fit, "machine binary").collect()  # the bounded sample in one task
    machine = Machine(np.zeros(STATISTICS), np.ones(STATISTICS))
    if rows:
        machine.__dict__.update(np.load(io.BytesIO(rows[0]["machine"])), fitted=True)
    return machine


def scored(docs: DataFrame, machine: Machine, *, text: str = "text", into: str = "quality_score") -> DataFrame:
    """``docs`` with a struct ``into`` that holds ``score``."""
    sent = Shared(docs.sparkSession, machine)

    def work(column: pa.Array) -> list[pa.Array]:
        return [pa.array(sent.get().score(*features(column)))]

    return add_struct(docs, text, free_name(docs, into), T.StructType([T.StructField("score", T.DoubleType())]), work)


def quality_scores(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = scored(docs.select(doc_id, text), train(docs, labels, text=text, doc_id=doc_id, **options), text=text)
    score = F.col(out.columns[-1])["score"]
    return out.select(doc_id, (fold(F.col(doc_id)) == 2).alias("held_out"), score.alias("score"), F.when(score >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` without those that score below ``threshold``; all of them if there is nothing to train on."""
    machine = train(docs, labels, text=text, doc_id=doc_id, **options)
    if not machine.fitted:
        return docs
    out = scored(docs, machine, text=text)
    return out.where(F.col(out.columns[-1])["score"] >= threshold).select(docs.columns)
