"""Whitened vectors against numpy on the whole matrix."""

import numpy as np
import pytest

from tracewell.llm import queries, whitening

BAD = [(1, None), (1, []), (2, [1.0, None, 2.0]), (3, [float("nan"), 0.0, 1.0]), (4, [float("inf"), 0.0, 1.0]), (5, [1.0])]


def expected(rows, k):
    """(x, deviation, whitened, explained) by numpy; exact integers by Python."""
    x = [[int(np.floor(1024 * float(c))) + 100000 for c in v] for v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return deviation, centred @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check(got, ids, rows, k):
    deviation, white, explained = expected(rows, k)
    assert len(got) == len(rows) * k and {r.n for r in got} == {len(rows)}
    by = {(r.vec_id, r.component): r for r in got}
    for j in range(k):
        mine = np.array([by[i, j + 1].whitened for i in ids])
        sign = np.sign((mine * white[:, j]).sum())
        np.testing.assert_allclose(mine * sign, white[:, j], atol=1e-9)
        assert [by[i, j + 1].deviation for i in ids] == deviation
        assert by[ids[0], j + 1].explained == pytest.approx(explained[j], rel=1e-9)
    assert max(r.identity_error for r in got) <= 1e-9


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding IS NOT NULL").collect()
    rows = [r.embedding for r in table]
    check(queries.op12(spark, sf).collect(), [r.vec_id for r in table], rows, 8)


def test_many_blocks_and_odd_rows(spark, monkeypatch):
    """Blocks of 7 rows, fewer dimensions than components, rows that do not count, columns with clashing names."""
    monkeypatch.setattr(whitening, "BLOCK_NUMBERS", 21)
    r = np.random.default_rng(5)
    rows = (r.normal(size=(100, 3)) @ r.normal(size=(3, 3)) + 5).astype(np.float32).tolist()
    table = spark.createDataFrame(list(enumerate(rows)) + BAD, "vec_id long, embedding array<float>")
    got = whitening.whiten(table.selectExpr("*", "1 AS x", "2 AS row", "3 AS index").repartition(4)).collect()
    check(got, list(range(100)), rows, 3)


def test_flat_and_empty(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 2.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(same).collect()
    assert len(got) == 6 and all((r.whitened is None) == (r.component == 2) for r in got)
    assert whitening.whiten(same.limit(1)).collect()[0].whitened is None
    huge = spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0])], "vec_id long, embedding array<float>")
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None}
    assert whitening.whiten(same.limit(0)).collect() == []
