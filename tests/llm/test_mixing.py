import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from statuta.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, share=Fraction(3, 2), most=2):
    """Targets of sources (in order) by exact fractions, resharing until none is above its cap."""
    w, capped = [(3, 1, 2)[i % 3] for i in range(len(sizes))], set()
    while True:
        left = share * sum(sizes) - sum(most * sizes[i] for i in capped)
        rest = sum(x for i, x in enumerate(w) if i not in capped)
        out = [most * s if i in capped else left * w[i] / rest for i, s in enumerate(sizes)]
        above = {i for i, (t, s) in enumerate(zip(out, sizes)) if t > most * s}
        if not above:
            return out
        capped |= above


def check(docs, rows):
    """rows against the contract, by source."""
    order = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    size = lambda t: len(WORD.findall(t or ""))
    totals = [sum(size(t) for _, t, s in docs if s == o) for o in order]
    want = dict(zip(order, water(totals), strict=True))
    assert Counter((r.doc_id, r.size, r.source_size) for r in rows) == Counter((i, size(t), totals[order.index(s)]) for i, t, s in docs)
    assert all(r.taken == r.size * r.copies and r.taken <= 2 * r.size and abs(r.copies - (r.target / r.source_size if r.size else 0)) < 1 for r in rows)
    ids = {i: s for i, _, s in docs}
    by = defaultdict(list)
    for r in rows:
        by[ids[r.doc_id]].append(r)
    for s, own in by.items():
        assert len({r.target for r in own}) == 1 and own[0].target == pytest.approx(float(want[s]))
        assert abs(sum(r.taken for r in own) - float(want[s])) <= max(r.size for r in own) + 1e-6


DOCS = [(i, " ".join(["w"] * (i * 7919 % 211)), (None, "", "a", "Z", "é", "😀", "｡", "b")[i * i % 8]) for i in range(600)]
DOCS += [(1000, None, "a"), (1001, "", "only empty"), (1002, "\x0b\x1c  x\x85y\n", "one"), (1003, "y " * 5_000, "long"), (1004, " \t\n", "a")]


@pytest.mark.parametrize("leaf", [1024, 4])
def test_contract(spark, monkeypatch, leaf):
    monkeypatch.setattr(mixing, "_LEAF", leaf)
    df = spark.createDataFrame(DOCS, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS target", "3 AS taken", "4 AS n", "5 AS at", "6 AS copies")
    rows = mixing.mix(df).collect()
    check(DOCS, rows)
    if leaf == 4:
        again = mixing.mix(df.repartition(13, F.col("text"))).collect()
        assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
        other = mixing.mix(df, seed=5).collect()
        assert sorted(map(tuple, rows)) != sorted(map(tuple, other))


def test_without_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "_BROADCAST", (0, 0))
    assert sorted(map(tuple, mixing.mix(df).collect())) == want


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check([(r.doc_id, r.text, r.source) for r in df.collect()], mixing.mix(df).collect())


def test_repeated_rows_ids_and_nothing(spark):
    docs = [(7, "a b c", "s")] * 301 + [(None, "x y", "s")] * 50 + [(8, "q", "t")] * 3 + [(9, "other text here now", "t")]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert len(rows) == len(docs) and {r.doc_id for r in rows} == {7, 8, 9, None}
    for source_size in {r.source_size for r in rows}:
        own = [r for r in rows if r.source_size == source_size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], empty.schema)).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in blank) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 500), st.floats(0.001, 0.999)), min_size=1, max_size=40), st.integers(0, 2**31))
def test_pivot_keeps_the_words_and_leaves_one_open(rows, seed):
    size, p = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out, open_ = mixing.pivot(size, p, np.random.default_rng(seed).random(len(rows)))
    assert abs((size * out).sum() - (size * p).sum()) < 1e-6 and all(x in (0, 1) for i, x in enumerate(out) if i != open_)


def test_expectations_stay():
    size, p, r = np.array([50, 20, 7, 3]), np.array([0.3, 0.6, 0.5, 0.9]), np.random.default_rng(3)
    mean = np.mean([mixing.pivot(size, p, r.random(4))[0] for _ in range(20_000)], axis=0)
    assert np.abs(mean - p).max() < 0.02
