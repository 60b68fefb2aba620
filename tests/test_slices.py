"""Python functions over texts hold a slice of a batch as objects, never the whole batch."""

import pyarrow as pa
from pyspark.sql import functions as F
from statuta.functions import batches
from statuta.operators import segment


def test_lists_of_texts_are_bounded():
    texts = ["x" * 300, None, "", "y" * 900, "z" * 5000, *["w" * 100] * 40]
    got = list(batches.pieces_of(iter([pa.array(texts), pa.array([], pa.string())]), 1000))
    assert sum(got, []) == texts and len(got) > 6 and all(sum(map(len, filter(None, g))) <= 1900 for g in got if g != ["z" * 5000] and "z" * 5000 not in g)


def test_embedding_and_splitting_see_slices(spark):
    """a model and the splitter were given whole batches of 10,000 rows."""
    rows = spark.range(0, 300, 1, 1).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 50 != 3, F.repeat(F.lit("word. "), 4000)).alias("content"))
    size = lambda: lambda texts: [[len(texts), len(t)] for t in texts]
    got = segment.embed(rows, size, batch=10**6).collect()
    assert len(got) == 300 and max(r.embedding[0] for r in got) < 60 and sum(r.embedding[1] for r in got) == 24_000 * 294
    plan = segment.embed(rows)._jdf.queryExecution().executedPlan().toString() + rows.select(segment.split_long_text(F.col("content")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2
    parts = rows.select("id", segment.split_long_text(F.col("content")).alias("c")).collect()
    assert {r.id: r.c for r in parts} == {r.id: None if r.content is None else segment.split_text(r.content) for r in rows.collect()}
