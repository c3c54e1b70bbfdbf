import numpy as np
import pytest

from tidewatt.llm import neighbours

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA)


def exact(rows, k, every):
    """The ids in order of inner product, then id, for each query."""
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array([i for i, _ in usable])
    x = np.array([np.array(v, np.float32) for _, v in usable], float)
    out = {}
    for i, v in usable:
        if i % every == 0:
            score = np.einsum("ij,j->i", x, np.array(v, np.float32).astype(float))
            other = ids != i
            order = np.lexsort((ids[other], -score[other]))[:k]
            out[i] = list(zip(ids[other][order].tolist(), score[other][order].tolist()))
    return out


def clusters(seed, n, width=16, copies=300):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, width))
    x = (centres[r.integers(0, 20, n)] + 0.3 * r.normal(size=(n, width))).astype(np.float32)
    x[:copies] = x[0]
    order = r.permutation(n)
    return [(int(i), x[i].tolist()) for i in order]


@pytest.mark.parametrize("blocks", [dict(), dict(candidate_block=50, query_block=7)])
def test_recall_and_scores(spark, blocks):
    """Results come from the probed parts alone, most of whose vectors the router was not fitted on."""
    rows = clusters(1, 3000)
    made = neighbours.search(frame(spark, rows), part_rows=60, sample=1000, **blocks).collect()
    truth, found = exact(rows, 20, 20), {}
    for r in made:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    assert set(found) == set(truth)
    hits = 0
    for query, got in found.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21))
        assert [(-g[2], g[1]) for g in got] == sorted((-g[2], g[1]) for g in got)
        assert all(g[2] == pytest.approx(x[query] @ x[g[1]], abs=1e-12) and g[1] != query for g in got)
        least = truth[query][-1][1]
        hits += sum(g[2] >= least - 1e-12 for g in got) / 20
    assert hits / len(truth) >= 0.9
    copies = {i for i in range(300)}
    assert all({v for _, v, _ in found[q]} <= copies for q in copies if q % 20 == 0 and truth[q][19][0] in copies)


def test_hostile_rows(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=4).tolist()) for i in range(60)]
    rows += [(100, None), (120, [0.0] * 4), (140, [1.0, None, 0.0, 0.0]), (160, [float("nan"), 1.0, 1.0, 1.0]), (180, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (200, []), (220, [1.0, 2.0]), rows[0], rows[7]]
    made = neighbours.search(frame(spark, rows), part_rows=1000).orderBy("query_id", "rank").collect()
    truth = exact([row for row in rows if row[1] is None or len(row[1]) == 4], 20, 20)
    assert [(m.query_id, m.vec_id) for m in made] == [(q, v) for q in sorted(truth) for v, _ in truth[q]]


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [2.0, 1.0])]])
def test_few_rows(spark, rows):
    made = neighbours.search(frame(spark, rows)).orderBy("query_id", "rank").collect()
    truth = exact(rows, 20, 20)
    assert [(m.query_id, m.vec_id) for m in made] == [(q, v) for q in sorted(truth) for v, _ in truth[q]]


def test_fewer_rows_in_a_part_than_results(spark):
    """Parts of a few rows: a query probes on until ``k`` rows other than its own are there."""
    r = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(400, 4)).astype(np.float32))]
    made = neighbours.search(frame(spark, [*rows, (0, [1.0, 1.0, 0.0, 0.0])]), part_rows=12, target=0.1).groupBy("query_id").count().collect()
    assert {(m.query_id, m["count"]) for m in made} == {(q, 40 if q == 0 else 20) for q in range(0, 400, 20)}


def test_parts_are_balanced():
    r = np.random.default_rng(3)
    x = r.normal(size=(640, 8))
    label = neighbours.balanced_parts(x, neighbours.nearest_of_sample(x, 5), 16)
    assert np.bincount(label, minlength=16).max() <= np.ceil(1.1 * 40)
