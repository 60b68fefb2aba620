import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from statuta.llm import common, negatives


def clip(x):
    return max(common.LONG[0], min(common.LONG[1], x))


def brute(rows, is_anchor, scale=256, n_pos=5, n_neg=3):
    """rows: (vec_id, label, list of floats), usable ones."""
    whole = lambda x: int(x) * scale if abs(x) >= 2**53 else int(np.floor(scale * x))
    rows = [(i, label, [whole(x) for x in v]) for i, label, v in rows]
    out = set()
    for a, label, v in rows:
        if not is_anchor(a):
            continue
        scored = sorted((-clip(sum(x * y for x, y in zip(v, w))), i, other == label) for i, other, w in rows if i != a)
        for p_score, p, _ in [x for x in scored if x[2]][:n_pos]:
            bad = [(s, i) for s, i, same in scored if not same and 50 * -p_score <= 100 * -s <= 95 * -p_score][:n_neg]
            out |= {(a, p, rank, i, -p_score, -s) for rank, (s, i) in enumerate(bad, 1)}
    return out


@pytest.mark.parametrize(("block", "anchors", "members"), [(8192, 32_768, 64), (60, 25, 2)])
def test_table_equals_brute_force(spark, block, anchors, members):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = rows.union(rows.filter("vec_id % 2 = 0").selectExpr("vec_id + 1000", "transform(embedding, x -> cast(2 * x AS float))", "label")).union(rows.filter("vec_id % 5 = 0"))
    got = [tuple(r) for r in negatives.mine(rows, F.col("vec_id") % 20 == 0, members=members, block=block, anchor_block=anchors).collect()]
    data = {r.vec_id: (r.vec_id, r.label, r.embedding) for r in rows.collect()}
    want = brute(data.values(), lambda i: i % 20 == 0)
    assert len(got) == len(want) > 300 and set(got) == want


def walk(v, ids, anchor, k, low=common.LONG[0], high=common.LONG[1]):
    unit = negatives.directions(anchor)[0]
    full = lambda x: np.full((len(anchor), 1), x)
    return negatives.Walk(0, negatives.directions(unit.mean(axis=0)[None])[0][0], np.arange(len(anchor)) - len(anchor), anchor, full(low), full(high), k)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 80), st.integers(1, 5), st.integers(1, 6), st.integers(-30, 30), st.integers(0, 40), st.integers(0, 2**31))
def test_a_walk_finds_what_all_scores_would(n, dims, k, low, more, seed):
    r = np.random.default_rng(seed)
    v, ids, anchor = r.integers(-4, 5, (n, dims)).astype(float), r.permutation(n), r.integers(-4, 5, (4, dims)).astype(float)
    w = walk(v, ids, anchor, k, low, low + more)
    for part in (slice(0, n // 2), slice(n // 2, n)):
        if len(v[part]):
            w.over(v[part], ids[part], step=3)
    scores = (anchor @ v.T).astype(int)
    for m in range(4):
        want = sorted((-s, i) for s, i in zip(scores[m], ids) if low <= s <= low + more)[:k]
        own = w.found[0] == m
        assert list(zip(-w.found[1][own], w.found[2][own])) == want


def test_walks_end_early():
    r = np.random.default_rng(1)
    v = np.round(r.normal(size=(20_000, 3)) * 100)
    w = walk(v, np.arange(20_000), np.round(np.array([9.0, -5, 2]) + r.normal(size=(10, 3)) * 0.1), 5)
    w.over(v, np.arange(20_000))
    assert w.steps < 10 * 20_000 / 4


def test_edges(spark):
    nan, inf, big = float("nan"), float("inf"), 2.0**40
    rows = [
        (0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 1, [0.5]), (3, 2, [0.9, 0.3]), (4, 2, [0.9, 0.3]), (5, 3, [0.7]), (6, 3, []), (7, 2, [0.8, 0.1, 5.0]), (50, 2, [big, 1.0]), (51, 2, [big, 3.0]), (52, 1, [0.8 * big, 1.0]), (100, 9, [0.0, 0.0]), (101, 9, [-1.0]), (102, 1, [1e300, 1.0]), (150, 4, [-1e300, 2.0**60 + 1024]), (151, 4, [2.0**53 + 2, 1e200]),
    ]
    bad = [(8, None, [1.0]), (9, 2, None), (10, 2, [nan, 1.0]), (11, 2, [1.0, -inf]), (12, 2, [None, 1.0]), (None, 2, [1.0])]
    df = spark.createDataFrame(rows + bad + rows[:5], "vec_id long, label int, embedding array<double>").selectExpr("*", "7 AS score", "1 AS rank", "2 AS batch")
    got = [tuple(r) for r in negatives.mine(df, F.col("vec_id") % 50 == 0, block=5, members=1).collect()]
    pad = [(i, label, v + [0.0] * (3 - len(v))) for i, label, v in rows]
    assert set(got) == brute(pad, lambda i: i % 50 == 0) and len(got) == len(set(got))
    assert {r[0] for r in got} >= {0, 50} and any(r[4] == r[5] == 0 for r in got) is (0 in [r[4] for r in got])
    assert negatives.mine(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_a_repeated_id_is_one_row(spark):
    df = spark.createDataFrame([(0, 1, [1.0]), (0, 1, [2.0]), (1, 1, [1.0]), (2, 2, [0.9]), (2, 2, [0.5])], "vec_id long, label long, embedding array<float>")
    assert {tuple(r) for r in negatives.mine(df, F.col("vec_id") == 0).collect()} == {(0, 1, 1, 2, 512 * 256, 512 * 230)}
