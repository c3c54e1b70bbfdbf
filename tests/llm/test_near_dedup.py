import numpy as np
import pytest

from texts import NON_SPACE, lower, some_documents
from tidewatt.llm import near_dedup
from tidewatt.llm.components import components


def shingles(text):
    w = NON_SPACE.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= 75 * (len(a) + len(sets[j]) - common):
                label[top(i)] = top(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        component = doc if not sets[i] else min(ids, default=None)
        out.append((doc, len(sets[i]), component, doc == component))
    return out


@pytest.mark.parametrize("seed, block", [(1, 4096), (2, 4096), (3, 2)])
def test_against_brute_force(docs_of, seed, block):
    rows = some_documents(seed, n=70, words=80)
    made = near_dedup.find_groups(docs_of(rows), block=block).collect()
    assert sorted(map(repr, map(tuple, made))) == sorted(map(repr, brute(rows)))


def test_empty_table(docs_of):
    assert near_dedup.find_groups(docs_of([])).count() == 0


def test_one_document_of_each_group_stays(docs_of):
    rows = [(5, "a b c d e f g"), (2, "A b c d e f g"), (2, "A b c d e f g"), (9, None), (7, "other words here"), (8, "")]
    df = docs_of(rows)
    made = near_dedup.dedup_near(df)
    assert made.columns == df.columns
    assert sorted(r.doc_id for r in made.collect()) == [2, 7, 8, 9]


def test_rows_with_one_id_are_judged_each_by_its_text(docs_of):
    near = [f"n{i}" for i in range(40)]
    copy, other = " ".join(near), " ".join([*near[:39], "x"])
    rows = [(5, "a b c d e f g"), (5, "something else that nobody has"), (5, other), (3, copy), (5, ""), (5, ""), (5, None)]
    made = near_dedup.dedup_near(docs_of(rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in made), key=repr) == sorted({(5, "a b c d e f g"), (5, "something else that nobody has"), (3, copy), (5, ""), (5, None)}, key=repr)
    # near copies under one id that is the least of their component
    made = near_dedup.dedup_near(docs_of([(2, copy), (2, other), (2, copy), (2, "p q r s t"), (8, other)])).collect()
    assert len(made) == 2 and {r.doc_id for r in made} == {2} and "p q r s t" in {r.text for r in made}


def test_null_ids_do_not_keep_each_other(docs_of):
    near = [f"n{i}" for i in range(40)]
    copy, other = " ".join(near), " ".join([*near[:39], "x"])
    alone = [(None, "only null ids say this"), (None, "ONLY null ids say this"), (None, "Only null ids say this")]
    rows = [(7, copy), (None, other), (None, copy), *alone, (None, "a text of its own here"), (None, ""), (None, ""), (None, None)]
    df = docs_of(rows).withColumnRenamed("n_words", "node").withColumnRenamed("score", "kept_id")
    made = near_dedup.dedup_near(df)
    assert made.columns == df.columns
    texts = [((r.doc_id, (r.text or "").lower())) for r in made.collect()]
    assert sorted(texts, key=repr) == sorted([(7, copy), (None, "only null ids say this"), (None, "a text of its own here"), (None, ""), (None, ""), (None, "")], key=repr)


def test_a_chain_is_one_component(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)]
    made = {r.node: r.component for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert made == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_a_large_group_takes_few_proposals(docs_of, monkeypatch):
    base = " ".join(f"w{i}" for i in range(3000))  # so long that copies share their bands
    rows = [(i, f"{base} e{i}") for i in range(200)] + [(1000 + i, f"other text {i} of some words") for i in range(20)]
    proposed, confirmed = [], near_dedup.confirmed

    def counted(pairs, sets):
        proposed.append(pairs.count())
        return confirmed(pairs, sets)

    monkeypatch.setattr(near_dedup, "confirmed", counted)
    made = near_dedup.find_groups(docs_of(rows), block=10).collect()
    assert {r.doc_id for r in made if r.kept} == {0, *range(1000, 1020)}
    assert sum(proposed) < 10 * len(rows), proposed


def bucket_of(texts, group=None):
    column = near_dedup.pa.array(texts)
    sets = near_dedup.shingles_of(column)
    rows = np.arange(len(texts))
    odd = near_dedup.odd_sketches(sets, rows)
    group = rows if group is None else np.array(group)
    return near_dedup.Bucket(near_dedup.node_ids(sets, rows), group, sets.counts, np.ascontiguousarray(odd).view(np.uint64), near_dedup.short_key(near_dedup.band_keys(sets, rows).view(np.int64)), 0)


def edited(r, words, edits):
    out = list(words)
    for at in r.choice(len(words), edits, replace=False):
        out[at] = f"e{r.integers(10**9)}"
    return " ".join(out)


def test_forest_and_partners_propose_what_is_similar_and_no_more():
    r = np.random.default_rng(1)
    texts = [edited(r, [f"{k}w{i}" for i in range(600)], 2) for k in range(3) for _ in range(20)]
    bucket = bucket_of(texts)
    pairs = near_dedup.forest(bucket)
    assert len(pairs) == 57 and all(a // 20 == b // 20 for a, b in pairs)
    two = partners_of(bucket, 2)
    assert 60 <= len(two) <= 120 and all(a // 20 == b // 20 for a, b in two)
    assert len(partners_of(bucket, 99)) == 3 * 190
    assert any(more for *_, more in near_dedup.partners(bucket, 2)) and not any(more for *_, more in near_dedup.partners(bucket, 19))
    later = bucket._replace(band=near_dedup.BANDS - 1)
    met = (bucket.keys[:, None, :-1] == bucket.keys[:, :-1]).any(axis=2)
    assert all(not met[a, b] for a, b in partners_of(later, 99)) and met.sum() > 60
    assert partners_of(bucket_of(texts, np.repeat(np.arange(3), 20)), 99) == set()


def partners_of(bucket, k):
    return {(min(a, b), max(a, b)) for x, y, _ in near_dedup.partners(bucket, k) for a, b in zip(x.tolist(), y.tolist())}


def test_refused_partners_do_not_hide_others(docs_of):
    """Many members just below the threshold stand nearer to each other than the pairs that link."""
    r = np.random.default_rng(7)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, edited(r, base, 14)) for i in range(50)]
    rows += [(100 + i, rows[i][1] + " " + " ".join(f"t{i}x{k}" for k in range(5))) for i in range(0, 50, 7)]
    made = near_dedup.find_groups(docs_of(rows)).collect()
    assert sorted(map(repr, map(tuple, made))) == sorted(map(repr, brute(rows)))


def test_many_short_texts_in_one_batch(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "200000")
    try:
        docs = spark.range(70_000).selectExpr("id AS doc_id", "concat('w', id) AS text").coalesce(1)
        marked = near_dedup.signatures(docs, "doc_id", "text")
        assert marked.where("n_shingles <> 1").count() == 0
        assert marked.select("node").distinct().count() == 70_000
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("words", [6, 30, 200, 1000, 8000])
def test_sketches_pass_similar_sets_and_stop_others(words):
    """Pairs at the least similarity pass; pairs clearly below are mostly stopped where samples allow it."""
    r = np.random.default_rng(words)
    base = [f"w{i}" for i in range(words)]
    kept = max(1, round((words - 4) * 6 / 7) + 4)
    pairs = [(" ".join([f"a{i}x{k}" for i in range(words - kept)] + base[:kept]), " ".join(base[:kept] + [f"b{i}x{k}" for i in range(words - kept)])) for k in range(60)]
    apart = [bucket_of(list(p)).apart(slice(0, 1))[0, 1] for p in pairs]
    sets = [tuple(map(shingles, p)) for p in pairs]
    similar = [4 * len(a & b) >= 3 * len(a | b) for a, b in sets]
    assert all(d <= 1 for d, s in zip(apart, similar) if s)
    if words >= 1000:
        far = [bucket_of([edited(r, base, words // 12), edited(r, base, words // 12)]).apart(slice(0, 1))[0, 1] for _ in range(20)]
        assert min(far) > 1
