import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from texts import NON_SPACE, lower, some_documents
from tidewatt.llm import language_model


def model(rows, order, prior):
    """The fold of an id, tokens of a text, counts of n-grams, training tokens, and the probability of an n-gram's last word."""
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    tokens = lambda t: [*NON_SPACE.findall(lower(t)), None]
    grams = Counter()
    for d, t in rows:
        if not held(d):
            w = tokens(t)
            grams.update(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(c for g, c in grams.items() if len(g) == 1)
    distinct = sum(len(g) == 1 for g in grams)

    def p(gram):
        if len(gram) == 1:
            return (grams[gram] + 0.5) / (total + 0.5 * (distinct + 1))
        lower_p, context = p(gram[1:]), grams[gram[:-1]]
        return (grams[gram] + prior * lower_p) / (context + prior) if context else lower_p

    return held, tokens, grams, total, p


def brute(rows, order, prior):
    held, tokens, grams, total, p = model(rows, order, prior)
    out = []
    for d, t in rows:
        w = tokens(t)
        score = sum(math.log10(p(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w)))
        out.append((d, held(d), len(w), sum(grams[(x,)] > 0 for x in w), total, sum(math.log10(p((x,))) for x in w), score))
    return out


@pytest.mark.parametrize("order, owners, pack, piece", [(1, 400_000, 4 << 20, 512), (2, 40, 2000, 5), (3, 400_000, 4 << 20, 512), (3, 60, 3000, 1), (4, 60, 1000, 7)])
def test_against_brute_force(docs_of, order, owners, pack, piece):
    rows = some_documents(order, n=50)
    made = language_model.text_scores(docs_of(rows), order=order, keys_per_owner=owners, pack_bytes=pack, piece=piece).collect()
    key = lambda r: (repr(tuple(r)[:5]), tuple(r)[5])
    for a, b in zip(sorted(map(tuple, made), key=key), sorted(brute(rows, order, language_model.PRIOR), key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], abs=1e-9, rel=1e-12)


@pytest.mark.parametrize("context", [(), ("a",), ("b",), ("a", "b"), ("never", "a"), ("never",)])
def test_probabilities_sum_to_one(context):
    """Over all words of training and one unknown word: the model that the scores are compared with is a distribution."""
    _, _, grams, _, p = model([(d, t) for d, t in enumerate(["a b a c a b", "b a b", "c", "", "a a"] * 2)], 3, 7.0)
    words = {g[0] for g in grams if len(g) == 1} | {"unknown"}
    assert sum(p((*context, w)) for w in words) == pytest.approx(1)


def test_states_and_arcs():
    """One pack that holds all of training: the states are its contexts, failure arcs drop their first word."""
    tokens = language_model.Tokens(pa.array(["a b a", "x a b c"]))
    counts = language_model.Counts(tokens, tokens.text == 0)
    for _ in range(3):
        _, own, _ = counts.next_order()
        counts.learn(2 * own)
    machine = language_model.BackoffAutomaton(counts, 4, 3, 100.0)
    # contexts: none, a, b, end, a b, b a, a end; arcs: three words, three pairs, two triples
    assert machine.depth.tolist() == [0, 1, 1, 1, 2, 2, 2]
    unseen = len(counts.seen[0]) - 3  # words of the other text, which state 0 reads and stays
    assert (machine.target >= 0).sum() == 8 + unseen
    assert machine.depth[machine.failure].tolist() == [0, 0, 0, 0, 1, 1, 1]
    state, costs = np.zeros(1, np.int64), []
    for i in range(4, 9):
        state, cost = machine.step(state, np.array([i]))
        costs.append(cost[0])
    assert costs == pytest.approx(machine.traverse(tokens.first, 2)[4:])
    assert costs[0] == pytest.approx(math.log10(0.5 / 6)) and costs[1] == pytest.approx(math.log10(2.5 / 6))


def test_empty_table(docs_of):
    assert language_model.text_scores(docs_of([])).count() == 0
