from fractions import Fraction

import numpy as np
import pytest

from tidewatt.llm import whitening

SF_DIR = "/root/testdata/sf0.01"
KIND = "vec_id bigint, embedding array<float>, n string, whitened string"


def integers(vector):
    return [int(np.floor(256 * float(np.float32(c)))) for c in vector]


def plain(vectors):
    """n, S, and the exact covariance from centred products of the distinct integer vectors."""
    fit = sorted(set(map(tuple, vectors)))
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    cov = [[Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), n**3) for j in range(d)] for i in range(d)]
    return n, sums, cov


def check(rows, given):
    used = [(i, integers(v)) for i, v in given]
    n, sums, cov = plain([x for _, x in used])
    v = np.array([[float(c) for c in row] for row in cov])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(4, len(sums))
    assert len(rows) == len(used) * k
    assert {r.n for r in rows} == {n}
    by_id = {(r.vec_id, r.component): r for r in rows}
    signs = {}
    for i, x in used:
        for c in range(k):
            r = by_id[(i, c + 1)]
            assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            assert r.explained == pytest.approx(e[c] / np.trace(v), rel=1e-9)
            want = sum(float(Fraction(n * a - s, n)) * u[j, c] for j, (a, s) in enumerate(zip(x, sums))) / e[c] ** 0.5
            sign = signs.setdefault(c, 1 if want * r.whitened >= 0 else -1)
            assert r.whitened == pytest.approx(sign * want, abs=1e-6)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_as_plain_products(spark):
    r = np.random.default_rng(1)
    base = r.normal(0, 0.3, (40, 6)) @ np.diag([3, 2, 1.5, 1, 0.5, 0.4]) + 0.7
    given = [(i, [float(np.float32(c)) for c in base[i % 37]]) for i in range(120)]
    rows = whitening.whiten(spark.createDataFrame([(i, v, "x", "y") for i, v in given], KIND).repartition(5)).collect()
    check(rows, given)


def test_hostile_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, -0.0, 0.25]), (2, [0.5, 0.0, 0.25]), (3, [-0.5, 1.0, 0.125]), (None, [2.0, -1.0, 0.0]), (3, [0.75, 0.5, -3.0]), (4, [0.1, 0.2, 0.3]), (9, [0.001, 0.9, -0.3])]
    bad = [(5, None), (6, [None, 1.0, 2.0]), (7, [nan, 1.0, 1.0]), (8, [inf, 0.0, 0.0]), (8, [-inf, 0.0, 0.0]), (10, []), (11, [1.0]), (12, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in good + bad], KIND)
    rows = whitening.whiten(df).collect()
    assert sorted(repr((r.vec_id, r.component)) for r in rows) == sorted(repr((i, c)) for i, _ in good for c in (1, 2, 3))
    distinct = [(i, v) for i, (_, v) in enumerate(good)]
    renamed = whitening.whiten(spark.createDataFrame([(i, v, "x", "y") for i, v in distinct], KIND)).collect()
    check(renamed, distinct)


def test_values_beyond_64_bit_squares(spark):
    r = np.random.default_rng(2)
    given = [(i, [float(np.float32(c)) for c in r.normal(0, 1, 4) * [1e9, 1e8, 1e8, 1e7]]) for i in range(30)]
    rows = whitening.whiten(spark.createDataFrame([(i, v, "x", "y") for i, v in given], KIND)).collect()
    n, sums, _ = plain([integers(v) for _, v in given])
    exact = {i: sum((n * a - s) ** 2 for a, s in zip(integers(v), sums)) for i, v in given}
    assert any(v >= 1 << 63 for v in exact.values())
    assert all(r.deviation == (exact[r.vec_id] if exact[r.vec_id] < 1 << 63 else None) for r in rows)
    assert rows[0].identity_error < 1e-9


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]] * 3, [[1.0, 2.0], [1.0, 3.0]]])
def test_components_without_variance(spark, vectors):
    rows = whitening.whiten(spark.createDataFrame([(i, v, "", "") for i, v in enumerate(vectors)], KIND)).collect()
    alike = len({tuple(v) for v in vectors}) == 1
    assert all((r.whitened is None) == (alike or r.component == 2) for r in rows)
    assert all((r.explained is None) == alike for r in rows)


def test_no_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], KIND)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, "", ""), (2, [], "", "")], KIND)).count() == 0


def test_given_table(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    rows = whitening.whiten(table).collect()
    check(rows, [(r.vec_id, r.embedding) for r in table.collect()])
