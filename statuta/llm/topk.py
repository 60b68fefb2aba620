"""Exact top-k inner-product search by Fagin's threshold algorithm.

Candidates are dealt once into blocks of bounded size, by a hash of their rows, and written
with their sorted lists, one per dimension.  Queries come to the blocks in broadcast batches
of bounded size, so that what is shuffled grows with the candidates alone; a batch's result is
written and its broadcast destroyed before the next one is fetched.  A query walks all
lists of a block from the end that its sign prefers.  Every object met is scored in full
(random access).  The threshold is the score of an object that would stand at the current
place of every list; once it is below the k-th score found, no unseen object can enter, ties
included, and the walk stops.  A task takes the k-th score along from block to block.  The
tasks' winners are merged by windows over k rows a task.

Components are whole numbers of any size.  Each query is held against a block in the quickest
of float32, float64 and Python integers in which their products are exact; a score beyond the
range of a long counts as the nearest end of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

_BLOCK = "ids binary, copies binary, vectors binary, lists binary, dims int"
_FOUND = "query_id long, vec_id long, score long, copies long"
_OUT = "query_id long, rank int, vec_id long, score long"


def usable(vector: Column) -> Column:
    """Not null, and no component null or non-finite."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def sorted_lists(vectors: np.ndarray) -> np.ndarray:
    """Per dimension the rows in ascending order of that component."""
    return np.argsort(vectors.T, axis=1, kind="stable")


def threshold_search(query: np.ndarray, own: int, vectors: np.ndarray, ids: np.ndarray, lists: np.ndarray, k: int, first: int = 16, floor: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(places of one query's k best rows, their scores, depth reached).

    Rows with id ``own`` are left out, and rows that can't reach ``floor`` may be.
    """
    n = len(ids)
    walked = np.flatnonzero(query)
    down = query[walked] > 0
    score = np.zeros(n, dtype=np.int64)
    seen = np.zeros(n, dtype=bool)
    other = ids != own
    done, depth = 0, min(first, n)
    while True:
        if len(walked):
            rising, falling = lists[walked[~down], done:depth], lists[walked[down], n - depth : n - done]
            met = np.zeros(n, dtype=bool)
            met[rising.ravel()] = True
            met[falling.ravel()] = True
        else:
            met = np.ones(n, dtype=bool)
        new = np.flatnonzero(met & ~seen)
        seen[new] = True
        score[new] = common.product(vectors[new], query)
        if depth >= n:
            break
        last = np.where(down, lists[walked, n - depth], lists[walked, depth - 1])
        bound = min(int((query[walked] * vectors[last, walked]).sum()), common.LONG[1])
        some = score[seen & other]
        least = [x for x in (floor, int(np.partition(some, len(some) - k)[len(some) - k]) if len(some) >= k else None) if x is not None]
        if least and max(least) > bound:
            break
        done, depth = depth, min(n, 2 * depth)
    found = np.flatnonzero(seen & other)
    if len(found) > k:
        found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k]]
    best = found[np.lexsort((ids[found], ~score[found]))][:k]
    return best, score[best], depth


def pack(rows: pa.Table) -> pa.Table:
    """A block of candidates as one row: ids, copies, vectors (as they are) and sorted lists."""
    x = common.matrix(rows["x"])
    columns = (rows["vec_id"].to_numpy().astype(np.int64), rows["copies"].to_numpy().astype(np.int64), x, sorted_lists(x).astype(np.int32))
    return pa.table([*(pa.array([np.ascontiguousarray(c).tobytes()], type=pa.binary()) for c in columns), pa.array([x.shape[1]], type=pa.int32())], names=[c.split()[0] for c in _BLOCK.split(", ")])


def search_blocks(batches: Iterator[pa.RecordBatch], query_ids: np.ndarray, queries: np.ndarray, k: int, scale: float) -> Iterator[pa.RecordBatch]:
    """The k best rows (k ids of k scores, with their copies) of each query over all blocks of a task."""
    best: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 3] * len(query_ids)
    asked = common.whole(queries, scale)
    for batch in batches:
        for ids, copies, vectors, lists, dims in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids, copies = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64)
            v, lists = common.whole(np.frombuffer(vectors).reshape(len(ids), dims), scale), np.frombuffer(lists, np.int32).reshape(dims, len(ids))
            q = common.widened(asked[:, :dims], dims)
            forms: dict[type, np.ndarray] = {}
            most = np.abs(v).max(initial=0, keepdims=True).reshape(1, 1)
            for i, own in enumerate(query_ids.tolist()):
                kind = common.exact_kind(q[i], np.broadcast_to(most, (1, dims)))
                if kind not in forms:
                    forms[kind] = common.in_kind(v, kind)
                held = best[i]
                floor = int(held[1][-1]) if len(held[1]) == k else None
                at, score, _ = threshold_search(common.in_kind(q[i], kind), own, forms[kind], ids, lists, k, max(16, len(ids) // 64), floor)
                both = tuple(np.concatenate(x) for x in zip(held, (ids[at], score, copies[at]), strict=True))
                order = np.lexsort((both[0], ~both[1]))[:k]
                best[i] = tuple(x[order] for x in both)
    if best:
        own = np.repeat(query_ids, [len(b[0]) for b in best])
        found, score, copies = (np.concatenate(x) for x in zip(*best, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(found), pa.array(score), pa.array(copies)], names=["query_id", "vec_id", "score", "copies"])


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, block: int = 8192, query_block: int = 32_768) -> DataFrame:
    """Per query its k best candidates: query_id, rank int, vec_id, score long.

    ``embeddings`` and ``queries`` have vec_id long and embedding array of numbers; other columns
    are ignored, whatever their names.  Ties go to the smaller vec_id.  Unusable vectors and null
    ids take no part; a query with fewer than k candidates gets them all; a shorter vector counts
    as ending in zeros.  A repeated vec_id among the queries is one query (of its largest
    vector); candidates with the query's vec_id are left out, other repeated rows are candidates
    each.  An empty table gives no rows.

    Blocks hold about ``block`` different candidates, a broadcast about ``query_block``
    queries; each batch of queries reads the blocks anew.
    """
    spark = embeddings.sparkSession
    good = lambda df: df.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    c = common.written(good(embeddings).groupBy("vec_id", "x").agg(F.least(F.count("*"), F.lit(k)).alias("copies")))
    q = good(queries).groupBy("vec_id").agg(F.max("x").alias("x"))
    n_blocks, n_batches = max(1, -(-c.count() // block)), max(1, -(-q.count() // query_block))
    blocks = common.written(c.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(n_blocks))).groupBy("block").applyInArrow(pack, _BLOCK))
    common.discard(c)
    dealt = common.written(q.withColumn("batch", F.pmod(F.xxhash64("vec_id"), F.lit(n_batches))).repartition("batch"), "batch")
    target = common.shared_dir(spark)
    spark.createDataFrame([], _OUT).write.parquet(target)
    for i in range(n_batches):
        batch = dealt.filter(F.col("batch") == i).select("vec_id", "x").toArrow()
        if not batch.num_rows:
            continue
        shared = spark.sparkContext.broadcast((batch["vec_id"].to_numpy(), common.matrix(batch["x"])))
        found = blocks.mapInArrow(lambda rows, b=shared: search_blocks(rows, *b.value, k, scale), _FOUND)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        each = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        again = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = each.withColumn("rank", F.row_number().over(again)).filter(F.col("rank") <= k)
        ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(target)
        shared.destroy()
    common.discard(blocks, dealt)
    return spark.read.schema(_OUT).parquet(target)
