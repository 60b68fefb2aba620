"""Ranked lexical search: dense blocked matrix products of item weights and document impacts.

The items' terms are a compact vocabulary, in tiles of bounded size.  One pass over the texts
counts, for each document, its terms and those of the vocabulary among them; that table, far
smaller than the texts, is written once.  The statistics of the corpus are sums over it.  Then
each task lays out a tile of documents as a dense matrix of impacts (documents x terms), the
items as a matrix of weights (items x terms), and multiplies them by BLAS in float64.  A tile
of terms is so narrow that no partial sum reaches 2^53, so every sum is exact whatever the
order of addition; tiles of terms are added up as 64-bit integers.  A tile of scores keeps,
for each item, all that reach its k-th best so far (ties included) and then cuts by doc_id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Terms in UTF-8: digits, ASCII letters and all beyond ASCII, which is any byte from 0x80.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_COUNTS = "doc_id long, n long, terms array<int>, tfs array<int>"
_HITS = "item_id long, doc_id long, score long"
_DOCS, _ITEMS, _WIDTH, _TOP_IMPACT = 1024, 256, 4096, 10**6


def words(text: bytes, limit: int = 1 << 22) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about ``limit`` bytes of it; only A-Z is lower-cased."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, min(at + limit, len(text)))
        end = gap.end() if gap else len(text)
        yield _TERM.findall(text[at:end].lower())
        at = end


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small(batches, 1):
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for part in words((text or "").encode()):
                    found = list(set(part))
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(found, pa.binary())], names=["item_id", "term"])

    rows = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(split, "item_id long, term binary").distinct()


def count_terms(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Per document (doc_id, text): its number of terms, and the vocabulary's terms in it with their counts."""
    for batch in common.small(batches, 1):
        sizes, terms, tfs, ends = [], [], [], [0]
        for text in batch.column(1).to_pylist():
            seen, n = Counter(), 0
            for part in words((text or "").encode()):
                seen.update(part)
                n += len(part)
            found = vocabulary.keys() & seen.keys()
            terms.extend(vocabulary[w] for w in found)
            tfs.extend(seen[w] for w in found)
            sizes.append(n)
            ends.append(len(terms))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32())) for values in (terms, tfs)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The flat values of a list column and the row of each."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), sizes)


def _document_counts(batches: Iterator[pa.RecordBatch], n_terms: int) -> Iterator[pa.RecordBatch]:
    """A task's share of the statistics: documents of each term; under -1 documents with a term, under -2 all terms."""
    df, totals = np.zeros(n_terms, dtype=np.int64), [0, 0]
    for batch in batches:
        n = batch.column(1).to_numpy()
        totals = [totals[0] + int((n > 0).sum()), totals[1] + int(n.sum())]
        df += np.bincount(_lists(batch.column(2))[0], minlength=n_terms)
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], some]), pa.int32()), pa.array(np.concatenate([totals, df[some]]), pa.int64())], names=["term", "n"])


def weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


def impacts(n: np.ndarray, tf: np.ndarray, doc: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    """The impact of a term that occurs ``tf`` times in the ``doc``-th of documents with ``n`` terms each."""
    if 90 * int(n.max(initial=0)) * n_documents >= 1 << 63:
        m = np.array([10 + 90 * int(x) * n_documents // n_terms for x in n], dtype=np.int64)
    else:
        m = 10 + 90 * n.astype(np.int64) * n_documents // max(1, n_terms)
    tf = tf.astype(np.int64)
    return 10**9 * tf // (1000 * tf + 8 * m[doc])


@dataclass(frozen=True)
class Plan:
    """What scoring needs: statistics, and each (item, term, weight), by item; bounded by the tile's size."""

    n_documents: int
    n_terms: int
    items: np.ndarray  # ids
    row: np.ndarray  # of each pair, its item
    term: np.ndarray  # its term
    weight: np.ndarray
    docs: int = _DOCS  # in a tile
    block: int = _ITEMS
    most: int = _WIDTH

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of items: (first, last item, their vocabulary, and of each pair row, column, weight within the block)."""
        for lo in range(0, len(self.items), self.block):
            hi = min(lo + self.block, len(self.items))
            own = slice(*np.searchsorted(self.row, [lo, hi]))
            vocabulary, column = np.unique(self.term[own], return_inverse=True)
            yield lo, hi, vocabulary, self.row[own] - lo, column, self.weight[own]

    @property
    def width(self) -> int:
        """Terms in a tile: so few that a sum of weight times impact stays below 2^53."""
        return max(1, min(self.most, ((1 << 53) - 1) // (max(1, int(self.weight.max(initial=1))) * _TOP_IMPACT)))


def score_tiles(batches: Iterator[pa.RecordBatch], plan: Plan, k: int) -> Iterator[pa.RecordBatch]:
    """The k best documents of each item among a task's documents."""
    blocks = list(plan.blocks())
    n_vocabulary = int(plan.term.max(initial=-1)) + 1
    best = [[np.empty(0, np.int64)] * 3 for _ in blocks]  # item within the block, score, document
    floor = [np.ones(hi - lo, dtype=np.int64) for lo, hi, *_ in blocks]  # an item's k-th best score; below it nothing enters
    for whole in batches:
        for at in range(0, whole.num_rows, plan.docs):
            batch = whole.slice(at, plan.docs)
            ids, n = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            (terms, doc), (tfs, _) = _lists(batch.column(2)), _lists(batch.column(3))
            impact = impacts(n, tfs, doc, plan.n_documents, plan.n_terms)
            for b, (lo, hi, vocabulary, row, column, weights) in enumerate(blocks):
                place = np.full(n_vocabulary, -1, dtype=np.int64)
                place[vocabulary] = np.arange(len(vocabulary))
                to = place[terms]
                scores = np.zeros((hi - lo, len(ids)), dtype=np.int64)
                for left in range(0, len(vocabulary), plan.width):
                    right = min(left + plan.width, len(vocabulary))
                    here, there = (to >= left) & (to < right), (column >= left) & (column < right)
                    x = np.zeros((len(ids), right - left))
                    x[doc[here], to[here] - left] = impact[here]
                    w = np.zeros((hi - lo, right - left))
                    w[row[there], column[there] - left] = weights[there]
                    scores += (w @ x.T).astype(np.int64)
                item, found = np.nonzero(scores >= floor[b][:, None])
                if len(item):
                    both = [np.concatenate(x) for x in zip(best[b], (item, scores[item, found], ids[found]), strict=True)]
                    kept = common.best_rows(*both, k)
                    best[b] = [x[kept] for x in both]
                    counts = np.bincount(best[b][0], minlength=hi - lo)
                    full = np.flatnonzero(counts >= k)
                    floor[b][full] = best[b][1][np.cumsum(counts)[full] - 1]
    for (lo, *_), (item, score, doc) in zip(blocks, best, strict=True):
        yield pa.RecordBatch.from_arrays([pa.array(plan.items[item + lo], pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])


def _tile_of(item: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(item, F.lit(n)), F.lit(n))


def _tiles(pairs: DataFrame, most: int) -> list[DataFrame]:
    """The items in tiles of at most ``most`` pairs; an item of more terms is a tile of its own."""
    n = -(-pairs.count() // most)
    while True:
        dealt = pairs.withColumn("tile", _tile_of(F.col("item_id"), max(1, n)))
        over = dealt.groupBy("tile").agg(F.count("*").alias("n"), F.min("item_id").alias("a"), F.max("item_id").alias("b")).filter((F.col("n") > most) & (F.col("a") < F.col("b"))).limit(1)
        if over.count() == 0:
            return [dealt.filter(F.col("tile") == i).drop("tile") for i in range(n)]
        n *= 2


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, tile: int = 1_000_000) -> DataFrame:
    """Per item its k highest-scoring documents: item_id, rank int (from 1), doc_id, score long.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored,
    whatever their names.  Texts are taken whole, however long (terms are counted some
    megabytes at a time); null and empty ones have no term, match nothing and don't count as
    documents.  Every row of ``docs`` is a document, repeated ones too; a row without an id
    counts in the statistics but isn't returned.  Several rows with one item_id are one item of
    all their terms, and an item without an id takes no part.  Equal scores go by doc_id;
    only scores above 0 count.  Empty tables give no rows.

    ``tile`` bounds the (item, term) pairs broadcast at once: each tile of items is a pass over
    the texts.  The tables between the passes are left in the shared folder until ``k`` rows an
    item are written, then deleted.
    """
    spark = docs.sparkSession
    pairs = common.written(_item_terms(items))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    target = common.shared_dir(spark)
    spark.createDataFrame([], "item_id long, rank int, doc_id long, score long").write.parquet(target)
    for part in _tiles(pairs, tile):
        known = part.toArrow()
        vocabulary, term = np.unique(np.array(known["term"].to_pylist(), dtype=object), return_inverse=True)
        shared = spark.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary.tolist())})
        counts = common.written(texts.mapInArrow(lambda b, v=shared: count_terms(b, v.value), _COUNTS))
        shared.destroy()
        sums = counts.mapInArrow(lambda b, n=len(vocabulary): _document_counts(b, n), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        df = dict(zip(sums["term"].to_pylist(), sums["n"].to_pylist(), strict=True))
        n_documents, n_terms = df.get(-1, 0), df.get(-2, 0)
        item_ids, row = np.unique(known["item_id"].to_numpy(), return_inverse=True)
        weights = np.array([weight(n_documents, df.get(t, 0)) for t in range(len(vocabulary))], dtype=np.int64)
        order = np.lexsort((term, row))
        plan = spark.sparkContext.broadcast(Plan(n_documents, n_terms, item_ids, row[order], term[order], weights[term[order]], _DOCS, _ITEMS, _WIDTH))
        found = counts.filter("doc_id IS NOT NULL AND size(terms) > 0").mapInArrow(lambda b, p=plan: score_tiles(b, p.value, k), _HITS)
        # Two steps, so that what meets in one task is neither all tasks' winners of an item nor many items.
        for keys in (["item_id", F.pmod(F.xxhash64("doc_id"), F.lit(64))], ["item_id"]):
            order = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
            found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found.select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(target)
        plan.destroy()
        common.discard(counts)
    common.discard(pairs)
    return spark.read.schema("item_id long, rank int, doc_id long, score long").parquet(target)
