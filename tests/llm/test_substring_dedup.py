import hashlib

import pytest

from texts import NON_SPACE, some_documents
from tidewatt.llm import substring_dedup
from tidewatt.llm.substring_dedup import COVERS, cover_for


def brute(rows, window):
    least = {}
    large = 1 << 63
    split = [(large if d is None else d, NON_SPACE.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, large), d)
    out = []
    for (doc, _), (d, w) in zip(rows, split):
        gone = {j for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window, owners, pack", [(13, 400_000, 4 << 20), (13, 50, 2000), (5, 60, 3000), (2, 60, 3000), (50, 60, 3000)])
def test_against_brute_force(docs_of, window, owners, pack):
    rows = some_documents(window + pack, n=80, words=120)
    made = substring_dedup.substring_digest(docs_of(rows), window=window, keys_per_owner=owners, pack_bytes=pack).collect()
    assert sorted(map(repr, map(tuple, made))) == sorted(map(repr, brute(rows, window)))


def test_empty_table(docs_of):
    assert substring_dedup.substring_digest(docs_of([])).count() == 0


def test_texts_are_cut(docs_of):
    shared = " ".join(f"s{i}" for i in range(20))
    rows = [(1, f"first  {shared}\nend"), (2, f"Second, {shared}  rest\tof it"), (3, None), (4, "short  text"), (5, shared)]
    df = docs_of(rows)
    made = substring_dedup.dedup_substrings(df, window=13)
    assert made.columns == df.columns
    assert {r.doc_id: r.text for r in made.collect()} == {1: rows[0][1], 2: "Second, rest\tof it", 3: None, 4: "short  text", 5: ""}


@pytest.mark.parametrize("window", [1, 2, 5, 13, 50, 200])
def test_covers(window):
    period, cover = cover_for(window)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert COVERS[period] == cover
    assert period <= (window + 1) / 2 or period == 1
