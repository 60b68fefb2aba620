"""Latent semantic vectors: a distributed randomised singular value decomposition over tf-idf."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Documents laid out densely at a time.
_ROWS = 128


def weighted(words: list[list[str] | None], places: dict[str, int], idf: np.ndarray) -> np.ndarray:
    """Rows (1 + ln tf) * idf over the vocabulary, at unit length; zero without a known word."""
    out = np.zeros((len(words), len(idf)))
    for i, own in enumerate(words):
        at = [places[w] for w in own or () if w in places]
        if at:
            terms, tf = np.unique(at, return_counts=True)
            out[i, terms] = (1 + np.log(tf)) * idf[terms]
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-300)[:, None]


def _slices(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS):
            part = batch.slice(lo, _ROWS)
            yield part, part.column(place).to_pylist()


class SemanticVectors:
    """An embedding learned from a corpus (id, content): the ``dim`` leading right singular vectors of its tf-idf matrix.

    Learned from a bounded sample of about ``sample_rows`` rows, drawn by a hash of the id, over the
    ``vocabulary`` most frequent lower-cased words that at least ``least`` and at most half of the sample
    hold.  Each round multiplies the matrix and its transpose with a thin block of ``dim + extra``
    vectors, task by task; the driver sees the block alone (vocabulary x (dim + extra)).  Null and
    empty texts, and such without a known word, have the zero vector.
    """

    def __init__(self, corpus: DataFrame, dim: int = 64, vocabulary: int = 8192, sample_rows: int = 50_000, least: int = 2, rounds: int = 3, extra: int = 16, seed: int = 1) -> None:
        share = min(1.0, sample_rows / max(1, corpus.count()))
        sample = corpus.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20)).select(_words(F.col("content")).alias("words"))
        n = max(1, sample.count())
        counts = sample.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        top = counts.filter((F.col("df") >= least) & (F.col("df") <= max(least, n // 2))).orderBy(F.desc("df"), "term").limit(vocabulary).collect()
        self.places = {r["term"]: i for i, r in enumerate(top)}
        self.idf = np.log(n / np.array([r["df"] for r in top], dtype=float)) if top else np.empty(0)
        width = min(dim + extra, len(top))
        block = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(top), width)))[0] if width else np.zeros((0, 0))
        values = np.empty(0)
        for _ in range(rounds if width else 0):
            product = self._multiplied(sample, block)
            values, turn = np.linalg.eigh(block.T @ product)
            block = np.linalg.qr(product @ turn[:, ::-1])[0]
        sign = np.sign(block[np.abs(block).argmax(axis=0), np.arange(block.shape[1])]) if width else 1.0
        self.vectors = np.zeros((len(top), dim))
        self.vectors[:, : min(dim, width)] = (block * sign)[:, :dim]

    def _multiplied(self, sample: DataFrame, block: np.ndarray) -> np.ndarray:
        """The matrix's transpose times the matrix times ``block``, summed over tasks."""
        shared = sample.sparkSession.sparkContext.broadcast((self.places, self.idf, block))

        def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places, idf, q = shared.value
            total = np.zeros_like(q)
            for _, words in _slices(batches, 0):
                a = weighted(words, places, idf)
                total += a.T @ (a @ q)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        def summed(rows: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(r) for r in sorted(rows["part"].to_pylist()))
            return pa.table([pa.array([total.tobytes()], pa.binary())], names=["part"])

        parts = sample.mapInArrow(share, "part binary").withColumn("slot", F.pmod(F.xxhash64("part"), F.lit(4)))
        rows = parts.groupBy("slot").applyInArrow(summed, "part binary").collect()
        shared.unpersist()
        return sum((np.frombuffer(r["part"]) for r in sorted(rows, key=lambda r: bytes(r["part"]))), np.zeros(block.size)).reshape(block.shape)

    def embed(self, rows: DataFrame, content: str = "content", name: str = "embedding") -> DataFrame:
        """Adds the vector of ``content``, at unit length, as a column."""
        shared = rows.sparkSession.sparkContext.broadcast((self.places, self.idf, self.vectors))
        worded = rows.withColumn("_words", _words(F.col(content)))
        names = rows.columns
        place = len(names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places, idf, v = shared.value
            for part, words in _slices(batches, place):
                out = weighted(words, places, idf) @ v
                out /= np.maximum(np.linalg.norm(out, axis=1), 1e-300)[:, None]
                yield pa.RecordBatch.from_arrays([*part.columns[:place], pa.array(out.tolist(), pa.list_(pa.float64()))], names=[*names, name])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return worded.mapInArrow(run, f"{fields}, `{name}` array<double>")


def _words(content: Column) -> Column:
    return F.coalesce(text.tokens(F.lower(content)), F.array().cast("array<string>"))
