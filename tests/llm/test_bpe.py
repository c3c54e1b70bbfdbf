import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from texts import HOSTILE, some_documents
from tidewatt.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
BITS = ["aab", "in", "ing", "a", "the", " ", "</w>", "<|endoftext|>", "<|startoftext|>", "é", "é", "Σ", "İ", "😀", "中文", "9", "12", "'re", "'S", "!!", "\n", "\t", " ", "=", "--", "xyz", "\x1c", "​"]


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.no_padding()
    made.no_truncation()
    return made


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    mixed = ["".join(r.choice(BITS) for _ in range(r.randint(0, 60))) for _ in range(500)]
    long = ["a" * 5000, "ab" * 3000, "the" * 2000, "ß" * 1500, "!?" * 900]
    return some_documents(2) + [(1000 + i, t) for i, t in enumerate(mixed + long)]


def test_as_the_library(docs_of, library, rows):
    def expected(doc, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        return doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    made = bpe.token_digest(docs_of(rows), PATH).collect()
    assert sorted(map(repr, map(tuple, made))) == sorted(repr(expected(*row)) for row in rows)


def test_encode_then_decode(docs_of, library):
    texts = [t for t in HOSTILE]
    coded = bpe.encode(docs_of(list(enumerate(texts))), PATH).selectExpr("doc_id", "tokens.ids AS ids")
    for row in bpe.decode(coded, PATH).collect():
        ids = library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert row.ids == ids
        assert row.decoded == library.decode(ids, skip_special_tokens=False)


def test_empty_table(docs_of):
    assert bpe.token_digest(docs_of([]), PATH).count() == 0


def test_all_code_points_as_the_library(library):
    import json

    with open(PATH) as file:
        encoder = bpe.Encoder(bpe.Vocabulary(json.load(file)))
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)}'s" for c in [*range(0xD800), *range(0xE000, 0x20000, 3)]]
    ours = encoder.encode(texts)
    theirs = library.encode_batch(texts, add_special_tokens=False)
    assert [t for t, a, b in zip(texts, ours, theirs) if np.frombuffer(a, "<u4").tolist() != b.ids] == []
