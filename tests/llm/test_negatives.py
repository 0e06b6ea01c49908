"""Hard-negative mining against plain loops."""

import compare
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridobs.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, here int, good int, _b int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1, 2, 3) for i, v, y in rows], SCHEMA)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 9), st.integers(1, 9), st.integers(0, 9), st.integers(1, 3), st.integers(0, 2**32 - 1))
def test_strassen_is_exact(m, k, n, leaf, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(2**27), 2**27, (m, k)), rng.integers(-(2**27), 2**27, (k, n))
    assert (negatives.strassen(a, b, leaf) == a @ b).all()


def test_strassen_of_large_tiles():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-300, 300, (131, 65)), rng.integers(-300, 300, (65, 258))
    assert (negatives.strassen(a, b, 8) == a @ b).all() and negatives.strassen(a, b).dtype == np.int64


def test_first_of_a_heap():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 40, 200):
        score, ids = rng.integers(0, 5, n), rng.permutation(n)
        assert negatives.first(score, ids, 5).tolist() == sorted(range(n), key=lambda i: (-score[i], ids[i]))[:5]


def brute(rows, is_anchor, rule):
    rows = [(i, y, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v, y in rows]
    out = set()
    for i, y, v in rows:
        if not is_anchor(i):
            continue
        score = {j: int(v @ w) for j, _, w in rows if j != i}
        label = {j: z for j, z, _ in rows}
        rank = lambda js: sorted(js, key=lambda j: (-score[j], j))
        for g in rank(j for j in score if label[j] == y)[: rule.positives]:
            near = rank(j for j in score if label[j] != y and rule.low * score[g] <= 100 * score[j] <= rule.high * score[g])
            out |= {(i, g, k + 1, j, score[g], score[j]) for k, j in enumerate(near[: rule.negatives])}
    return out


@pytest.mark.parametrize("tile, anchor_tile", [(4096, 512), (7, 3)])
def test_mining_against_loops(spark, tile, anchor_tile):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 5) / 8], int(rng.choice([0, 0, 0, 1, 2, 3]))) for i in range(120)]  # few values: many ties
    rows += [(1000, [0.25, 0.25, 0.25, 0.25, 0.25], 77)]  # alone in its label
    rule = negatives.Mining(4, 3, 70, 100)
    got = negatives.mine(negatives.quantised(table(spark, rows)), F.col("vec_id") % 10 == 0, rule, tile, anchor_tile).collect()
    assert len(got) > 50 and {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got} == brute(rows, lambda i: i % 10 == 0, rule)
    assert len(got) == len(set(got))


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 0), (2, [1.0, None], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (5, [1.0, 1.0], None), (None, [1.0, 1.0], 0), (6, [], 0), (7, [1.0], 0), (8, [1e30, 1.0], 0)]
    fine = [(100, [1.0, 0.5], 0), (101, [0.5, 0.5], 0), (101, [0.5, 0.5], 0), (102, [0.5, 0.5], 1), (103, [0.0, 0.0], 1), (200, [-0.001, 0.0], 5)]
    q = negatives.quantised(table(spark, odd + fine))
    assert {(r.vec_id, r.label, tuple(r.vec)) for r in q.collect()} == {(100, 0, (256, 128)), (101, 0, (128, 128)), (102, 1, (128, 128)), (103, 1, (0, 0)), (200, 5, (-1, 0))}
    got = [tuple(r) for r in negatives.mine(q, F.col("vec_id") % 100 == 0).collect()]
    assert got == [(100, 101, 1, 102, 49152, 49152)]
    for none in (table(spark, []), table(spark, odd), table(spark, fine[1:4])):
        assert negatives.mine(negatives.quantised(none), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    con = compare.connect(f"/root/testdata/{sf}")
    n, m, wrong, n_wrong = compare.differences(queries.op13_hard_negatives(spark, f"/root/testdata/{sf}"), con, queries.oracle_sql()["op13_hard_negatives"])
    assert (n, n_wrong) == (m, 0), wrong
