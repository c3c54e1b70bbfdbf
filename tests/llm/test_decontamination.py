import hashlib
import random

import pytest

from texts import ALNUM, HOSTILE, lower, some_documents
from tidewatt.llm import decontamination
from tidewatt.llm.automaton import SuffixAutomaton


def brute(rows, items, window):
    pieces = set()
    for item, text in items:
        w = ALNUM.findall(lower(text))
        k = min(window, len(w))
        pieces |= {(item, tuple(w[i : i + k])) for i in range(len(w) - k + 1)} if w else set()
    out = []
    for doc, text in rows:
        w = ALNUM.findall(lower(text))
        hit, found = set(), set()
        for item, piece in pieces:
            for i in range(len(w) - len(piece) + 1):
                if tuple(w[i : i + len(piece)]) == piece:
                    hit |= set(range(i, i + len(piece)))
                    found.add(item)
        names = ",".join(sorted(str(i) for i in found if i is not None))
        n_items = len([i for i in found if i is not None])
        out.append((doc, len(w), len(hit), n_items, hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def items_from(rows, seed):
    r = random.Random(seed)
    texts = [t for _, t in rows if t]
    items = []
    for i in range(25):
        w = r.choice(texts).split(" ")
        a = r.randrange(len(w))
        items.append((i % 20, " ".join(w[a : a + r.choice([1, 2, 3, 5, 12, 30])]).upper()))
    return items + [(99, None), (98, ""), (97, "..."), (None, items[0][1]), items[1]]


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("window, block", [(10, 200_000), (4, 200_000), (4, 40), (1, 200_000)])
def test_against_brute_force(spark, docs_of, window, block):
    rows = some_documents(window, n=40)
    items = items_from(rows, window)
    made = decontamination.leak_digest(docs_of(rows), spark.createDataFrame(items, "item_id bigint, text string"), window=window, block_words=block)
    assert order(map(tuple, made.collect())) == order(brute(rows, items, window))


def test_items_longer_than_a_piece(spark, docs_of, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 7)
    rows = some_documents(5, n=30)
    items = [(1, max((t for _, t in rows if t), key=len)[:900]), (2, rows[0][1])]
    made = decontamination.leak_digest(docs_of(rows), spark.createDataFrame(items, "item_id bigint, text string"), window=5)
    assert order(map(tuple, made.collect())) == order(brute(rows, items, 5))


@pytest.mark.parametrize("documents, items", [([], [(1, "a b")]), (list(enumerate(HOSTILE)), []), ([], [])])
def test_empty_tables(spark, docs_of, documents, items):
    made = decontamination.leak_digest(docs_of(documents), spark.createDataFrame(items, "item_id bigint, text string"))
    assert order(map(tuple, made.collect())) == order(brute(documents, items, 10))


def test_spans_are_cut_and_copies_dropped(spark, docs_of):
    item = " ".join(f"q{i}" for i in range(12))
    long = " ".join(f"d{i}" for i in range(40))
    rows = [(1, long + "\n" + item.upper() + ", then  more."), (2, item), (3, "clean  text,\tkept as it is"), (4, None), (5, "")]
    df = docs_of(rows)
    kept = decontamination.decontaminate(df, spark.createDataFrame([(7, item)], "item_id bigint, text string"))
    assert kept.columns == df.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {1: long + "\nthen  more.", 3: rows[2][1], 4: None, 5: ""}


def test_automaton_holds_all_substrings():
    r = random.Random(1)
    strings = [[r.randrange(3) for _ in range(r.randrange(1, 12))] for _ in range(20)]
    machine = SuffixAutomaton()
    for s in strings:
        machine.add(s)
    inside = {tuple(s[a:b]) for s in strings for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    text = [r.randrange(3) for _ in range(400)]
    state = matched = 0
    for i, symbol in enumerate(text):
        state, matched = machine.move(state, matched, symbol)
        assert matched == max(n for n in range(13) if n <= i + 1 and (n == 0 or tuple(text[i + 1 - n : i + 1]) in inside))
        if matched:
            short = r.randint(1, matched)
            at = machine.at_length(state, short)
            assert machine.length[machine.link[at]] < short <= machine.length[at]
