import math
import os
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from statuta.llm import topk


def brute(q, own, v, ids, k):
    s = v @ q
    order = sorted((-int(s[i]), int(ids[i])) for i in range(len(ids)) if ids[i] != own)
    return [(i, -n) for n, i in order[:k]]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.integers(1, 6), st.integers(1, 25), st.integers(0, 2**31))
def test_one_query_equals_brute_force(n, dims, k, seed):
    r = np.random.default_rng(seed)
    v, ids = r.integers(-3, 4, (n, dims)).astype(float), r.permutation(n)
    q = r.integers(-3, 4, dims).astype(float)
    want = brute(q, 0, v, ids, k)
    at, score, _ = topk.threshold_search(q, 0, v, ids, topk.sorted_lists(v), k, first=2)
    assert list(zip(ids[at].tolist(), score.astype(int).tolist(), strict=True)) == want
    if want:  # a floor loses nothing that reaches it
        floor = want[len(want) // 2][1]
        at, score, _ = topk.threshold_search(q, 0, v, ids, topk.sorted_lists(v), k, first=2, floor=floor)
        got = list(zip(ids[at].tolist(), score.astype(int).tolist(), strict=True))
        assert [x for x in got if x[1] >= floor] == [x for x in want if x[1] >= floor]


def test_stops_early():
    r = np.random.default_rng(1)
    v = np.round(r.normal(size=(5000, 3)) * 20)
    *_, depth = topk.threshold_search(np.array([9.0, -5.0, 2.0]), -1, v, np.arange(5000), topk.sorted_lists(v), 5)
    assert depth < 2500


@pytest.mark.parametrize(("block", "query_block"), [(100, 20), (60, 10_000)])
def test_table_equals_brute_force(spark, block, query_block):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    rows = rows.union(rows.filter("vec_id % 3 = 0")).union(rows.filter("vec_id % 9 = 0")).union(rows.filter("vec_id % 7 = 0").selectExpr("vec_id", "reverse(embedding)"))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(rows, rows.filter("vec_id % 20 = 0"), block=block, query_block=query_block).collect()}
    data = rows.toPandas()
    v = np.floor(64 * np.stack(data.embedding).astype(np.float64)).astype(int)
    ids = data.vec_id.to_numpy()
    queries = {}
    for i, q in zip(ids, v, strict=True):
        if i % 20 == 0 and tuple(q) >= tuple(queries.get(i, q)):
            queries[i] = q
    want = {(int(i), n + 1): x for i, q in queries.items() for n, x in enumerate(brute(q, i, v, ids, 20))}
    assert got == want


def test_batches_are_read_and_released_one_by_one(spark, monkeypatch):
    """The driver holds one batch of queries at a time, and nothing but the result stays in the shared folder."""
    held, most, destroyed = [0], [0], [0]
    context = type(spark.sparkContext)
    plain = context.broadcast

    def broadcast(self, value):
        out = plain(self, value)
        held[0] += len(value[0])
        most[0] = max(most[0], held[0])
        kill = out.destroy

        def destroy(blocking=False):
            held[0] -= len(value[0])
            destroyed[0] += 1
            kill(blocking)

        out.destroy = destroy
        return out

    monkeypatch.setattr(context, "broadcast", broadcast)
    made = []
    fresh = topk.common.shared_dir
    monkeypatch.setattr(topk.common, "shared_dir", lambda s: made.append(fresh(s)) or made[-1])
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    out = topk.top_k(rows, rows.filter("vec_id % 20 = 0"), block=100, query_block=10)
    assert out.count() == 500 and destroyed[0] >= 3 and most[0] < 25 and held[0] == 0
    assert [os.path.exists(m.removeprefix("file://")) for m in made].count(True) == 1


BIG = [2.0**30, 2.0**45, 2.0**57, 2.0**100, 1e300]


@pytest.mark.parametrize("size", BIG)
def test_components_of_any_size_are_exact(spark, size):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(r.normal(size=3) * 8) * (size if i % 3 else 1.0) + np.round(r.normal(size=3) * 4)]) for i in range(60)]
    rows += [(100, [size]), (101, [1.0]), (102, [size, 1 / 64]), (103, [size, 2 / 64]), (104, [-size])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in topk.top_k(df, df, k=7, block=20, query_block=40).collect()}
    exact = {i: [math.floor(Fraction(x) * 64) for x in [*v, 0.0, 0.0][:3]] for i, v in rows}
    for q, a in exact.items():
        scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in exact.items() if i != q)
        for rank, (s, i) in enumerate(scores[:7], 1):
            assert got[q, rank] == (i, -s)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [-1.0, 0.0]), (None, [1.0, 1.0]), (20, [2.0]), (40, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "7 AS score", "1 AS rank")
    got = [tuple(r) for r in topk.top_k(df, df.filter("vec_id % 20 = 0"), k=3, block=4, query_block=2).orderBy("query_id", "rank").collect()]
    assert [r[2] for r in got if r[0] == 0] == [20, 1, 1] and [r[2] for r in got if r[0] == 40] == [0, 1, 1]
    assert {r[0] for r in got} == {0, 20, 40} and topk.top_k(df.limit(0), df.limit(0)).count() == 0
