"""Exact vector results without pairs of arrays."""

import random

import pytest
from pyspark.sql import functions as F
from statuta.functions import vectors as V
from statuta.operators import ann, search


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def odd_vectors(spark):
    r = random.Random(8)
    rows = [(f"v{i:02}", [r.uniform(-1, 1) for _ in range(5)]) for i in range(40)] + [("none", None), ("zero", [0.0] * 5), ("short", [1.0])]
    return spark.createDataFrame(rows, "id string, embedding array<double>")


def test_all_similarities_are_no_pairs_of_arrays(spark):
    """each pair's cosine was worked out from two arrays, with both norms."""
    rows = odd_vectors(spark)
    q = spark.createDataFrame([(1, [1.0, 0.5, -1.0, 2.0, 0.0]), (2, [0.0] * 5), (3, None)], "qid long, qvec array<double>")
    got = search.all_similarities(rows, q)
    want = rows.filter("embedding IS NOT NULL").crossJoin(q).select("qid", "id", V.cosine(F.col("embedding"), F.col("qvec")).alias("similarity"))
    assert {(r.qid, r.id): r.similarity for r in got.collect() if r.similarity is not None} == pytest.approx({(r.qid, r.id): r.similarity for r in want.collect() if r.similarity is not None})
    assert got.count() == want.count() == 42 * 3 and "Join" not in plan_of(got)
    assert search.all_similarities(rows, q.limit(0)).count() == 0


def test_exact_search_of_cells_makes_no_pairs(spark, tmp_path):
    """F16: a cell's rows were repeated for each of its queries and joined with them."""
    rows = odd_vectors(spark).filter("id <> 'short'")
    ann.CellIndex(rows, cells=4, parts=2).save(f"{tmp_path}/c")
    index = ann.CellIndex.load(spark, f"{tmp_path}/c")
    q = rows.filter("id LIKE 'v0%'").select(F.substring("id", 2, 2).cast("long").alias("qid"), F.col("embedding").alias("qvec"))
    got = index.search(q, 3, 4)
    best = lambda df: {(r.qid, r.rank): r.id for r in df.collect()}
    assert best(got) == best(search.vector_search(rows, q, 3)) and "Join" not in plan_of(got) and "Generate" not in plan_of(got)
    near = index._near(q, 1).join(index.rows, "cell").join(q, "qid").select("qid", "id", V.cosine(F.col("embedding"), F.col("qvec")).alias("similarity"))
    assert best(index.search(q, 3, 1)) == best(search.ranked(near, "similarity", 3))
