import base64
import random

import public_tokenizers
import pytest
import tiktoken

from texts import HOSTILE, some_documents
from tidewatt.llm import token_counts

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
BITS = ["the ", "a", "  ", "\n", "\n\n   ", "'s", "'", "re", "word", "42", " 7", "!!", "é", "中", "😀", " ", "\t", ".", "ll", "   x"]


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@pytest.fixture(scope="module")
def whole(ranks):
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(coder.encode_ordinary(text))


def applied(text, start, stop, new):
    start = min(max(start, 0), len(text))
    return text[:start] + new + text[min(max(stop, start), len(text)) :]


def test_edits_of_a_tree(ranks, whole):
    counter, r = token_counts.Counter(ranks, PATTERN), random.Random(3)
    some = lambda sizes: "".join(r.choice(BITS) for _ in range(r.choice(sizes)))
    for _ in range(400):
        text = some([0, 1, 5, 50, 400, 2000])
        document = token_counts.Document(text, counter)
        for _ in range(r.randint(1, 8)):
            start, new = r.randint(-2, len(text) + 2), some([0, 1, 3, 40, 300])
            stop = start + r.choice([0, 0, 1, 3, 30, 500])
            document.edit(start, stop, new)
            text = applied(text, start, stop, new)
            assert document.text() == text
            assert document.tokens == whole(text)
            assert document.chars == len(text)


def test_an_edit_of_a_long_text_is_local(ranks, whole):
    text = "some words and more, " * 20_000
    document = token_counts.Document(text, token_counts.Counter(ranks, PATTERN))
    document.edit(200_000, 200_004, "other")
    assert document.tokens == whole(applied(text, 200_000, 200_004, "other"))
    assert document.encoded < 10


def test_query_form(spark, docs_of, whole):
    r = random.Random(5)
    rows = some_documents(6, n=25)
    edits = [(d, n, r.randint(-3, 200), r.randint(0, 220), r.choice([None, "", "new text", "\n\n", "é😀"])) for d in {d for d, _ in rows} | {12345} for n in (2, 1, 3) if r.random() < 0.7]
    edits += [(rows[0][0], None, 0, 3, "x"), (rows[1][0], 9, None, 3, "x"), (None, 1, 0, 1, "y")]
    made = token_counts.count_tokens(docs_of(rows), spark.createDataFrame(edits, "doc_id bigint, edit_no bigint, start bigint, stop bigint, replacement string"), PATH, PATTERN)
    expected = []
    for doc, text in rows:
        text = before = text or ""
        if doc is not None:
            mine = [e for e in edits if e[0] == doc and e[2] is not None]
            for _, _, start, stop, new in sorted(mine, key=lambda e: (e[1] is not None, e[1] or 0, e[2], e[3], e[4] or "")):
                text = applied(text, start, stop, new or "")
        expected.append((doc, whole(before), whole(text), len(text)))
    assert sorted(repr(tuple(m)[:4]) for m in made.collect()) == sorted(map(repr, expected))


def test_empty_tables(spark, docs_of, whole):
    none = spark.createDataFrame([], "doc_id bigint, edit_no bigint, start bigint, stop bigint, replacement string")
    assert token_counts.count_tokens(docs_of([]), none, PATH, PATTERN).count() == 0
    made = token_counts.count_tokens(docs_of(list(enumerate(HOSTILE))), none, PATH, PATTERN).collect()
    assert all(m.n_before == m.n_after == whole(HOSTILE[m.doc_id] or "") for m in made)
