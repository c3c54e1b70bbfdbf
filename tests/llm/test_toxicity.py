import zlib

import numpy as np
import pyarrow as pa
import pytest

from texts import ALNUM, lower, some_documents
from tidewatt.llm import toxicity as tx
from tidewatt.llm.words import ALNUM_BYTES, hash_words, split_words

SF_DIR = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = tx.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic == 1], [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(toxic) > 0.85  # some labelled texts have no toxic word
    assert np.mean(clean) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def fitted(seed=1):
    r = np.random.default_rng(seed)
    network = tx.Network(np.sort(hash_words(split_words(pa.array(["alpha beta gamma delta"]), ALNUM_BYTES, True))))
    network.values = {k: r.normal(size=v.shape) * 0.4 for k, v in network.values.items()}
    network.fitted = True
    return network


def plain_score(network, text):
    """Window by window, word by word."""
    p, h = network.values, tx.STATES
    words = [w.encode() for w in ALNUM.findall(lower(text))]

    def vector(word):
        column = split_words(pa.array([word.decode()]), ALNUM_BYTES, True)
        at = int(network.entry(hash_words(column))[0])
        found, _ = tx.grams(column, np.array([0]))
        assert len(found) == sum(max(len(word) + 3 - n, 0) for n in tx.GRAMS)
        return np.concatenate([p["word"][at], sum(p["gram"][b] for b in found) / len(found) ** 0.5])

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    def states(vectors, d):
        state, out = np.zeros(h), []
        for x in vectors:
            a, b = x @ p["input"][d] + p["bias"][d], state @ p["state"][d]
            r, z = sigmoid(a[:h] + b[:h]), sigmoid(a[h : 2 * h] + b[h : 2 * h])
            state = z * state + (1 - z) * np.tanh(a[2 * h :] + r * b[2 * h :])
            out.append(state)
        return np.array(out).reshape(-1, h)

    logits = []
    starts = sorted({min(s, max(len(words) - tx.WINDOW, 0)) for s in range(0, len(words) + 1, tx.STRIDE)})
    for s in starts:
        vectors = [vector(w) for w in words[s : s + tx.WINDOW]]
        both = np.stack([states(vectors, 0), states(vectors[::-1], 1)[::-1]], axis=1)
        look = np.einsum("tdh,dh->t", both, p["look"])
        weight = np.exp(look - look.max()) if len(look) else look
        pooled = np.einsum("t,tdh->dh", weight / weight.sum(), both) if len(look) else np.zeros((2, h))
        logits.append((pooled * p["out"]).sum() + p["level"][0])
    return sigmoid(max(logits))


def test_scores_as_word_by_word():
    r = np.random.default_rng(4)
    vocabulary = ["alpha", "Beta", "gamma!", "delta", "é", "x", "日本語", "a" * 60, "9"]
    texts = [" ".join(r.choice(vocabulary, n)) for n in (1, 2, 5, 47, 48, 49, 72, 73, 200)] + ["", " .. ", None]
    network = fitted()
    together = network.score(pa.array(texts, pa.string()))
    assert together == pytest.approx([plain_score(network, t) for t in texts], abs=1e-6)
    assert network.score(pa.array(texts[::-1], pa.string()))[::-1] == pytest.approx(together, abs=1e-6)


def test_windows_cover_every_word_and_overlap():
    counts = np.arange(0, 300)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    text, begin, sizes = tx.windows_of(counts, first)
    for i, n in enumerate(counts):
        mine = [(b - first[i], b - first[i] + s) for t, b, s in zip(text, begin, sizes) if t == i]
        assert mine[0][0] == 0 and mine[-1][1] == n
        assert all(0 < b[0] - a[0] <= tx.STRIDE and b[0] < a[1] for a, b in zip(mine, mine[1:]))


def test_gradient_by_differences():
    r = np.random.default_rng(6)
    network = fitted(2)
    column = pa.array(["alpha beta x", "gamma", "delta alpha y z w", ""])
    words = split_words(column, ALNUM_BYTES, True)
    hashes, of, word = np.unique(hash_words(words), return_index=True, return_inverse=True)
    gram, begin = tx.grams(words, of)
    entry, sizes = network.entry(hashes), words.counts
    index = tx.indices(word, words.first[:-1], sizes)
    label = np.array([1.0, 0.0, 0.0, 1.0])

    def loss():
        logit, _ = network.read(network.gates(network.vectors(entry, gram, begin)), index, sizes)
        return np.mean(np.log1p(np.exp(logit)) - label * logit)

    vectors = network.vectors(entry, gram, begin)
    logit, run = network.read(network.gates(vectors), index, sizes, keep=True)
    found = network.slopes((1 / (1 + np.exp(-logit)) - label) / 4, index, vectors, entry, gram, begin, run)
    for name, value in network.values.items():
        flat = value.reshape(-1)
        for at in [*r.integers(0, flat.size, 6), *np.argsort(-np.abs(found[name].reshape(-1)))[:6]]:
            kept = flat[at]
            flat[at] = kept + 1e-5
            up = loss()
            flat[at] = kept - 1e-5
            down = loss()
            flat[at] = kept
            assert found[name].reshape(-1)[at] == pytest.approx((up - down) / 2e-5, abs=1e-7)


@pytest.mark.parametrize("labelled", [True, False])
def test_hostile_rows(spark, docs_of, labelled):
    rows = some_documents(3, n=30)
    labels = [(d, i % 2) for i, (d, _) in enumerate(rows)] + [(10**9, 1), (rows[0][0], None), (None, 1)] if labelled else []
    made = tx.toxicity_scores(docs_of(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert sorted(repr(r.doc_id) for r in made) == sorted(repr(d) for d, _ in rows)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) for r in made)
    assert all(0 <= r.score <= 1 for r in made)
    if not labelled:
        assert {r.score for r in made} == {0.5}


def test_empty_table(spark, docs_of):
    assert tx.toxicity_scores(docs_of([]), spark.createDataFrame([], "doc_id bigint, toxic int")).count() == 0
