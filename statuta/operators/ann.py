"""Approximate vector search: an inverted file over k-means cells, with product codes of the residuals.

A vector is at home in the cell of its nearest centre.  What it differs by from the centre is
coded in a few bytes, one for each part of the vector: the nearest of 256 codewords learned for
that part.  A query's distance to a coded vector is a sum of one table entry a byte, so a batch
scans codes alone and reads, and scores exactly, only a short list for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors
from .batch import by_parts, held
from .search import DIGITS, nearest as best_of, ranked
from .substring import CANDIDATES

_CODEWORDS = 256


def _unit(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / vectors.norm(v))


def codewords(parts: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Up to 256 codewords of some part of the sampled residuals, by Lloyd's rounds from evenly spaced distinct rows."""
    distinct = np.unique(parts, axis=0)
    words = distinct[np.linspace(0, len(distinct) - 1, min(_CODEWORDS, len(distinct))).astype(int)]
    for _ in range(rounds):
        own = nearest(parts, words)
        sums, counts = np.zeros_like(words), np.bincount(own, minlength=len(words))
        np.add.at(sums, own, parts)
        words = np.where(counts[:, None] > 0, sums / np.maximum(1, counts)[:, None], words)
    return words


def nearest(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((words**2).sum(axis=1) - 2 * rows[i : i + 4096] @ words.T, axis=1) for i in range(0, len(rows), 4096)])


def code_distances(codes: np.ndarray, query: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances of coded residuals to a query's residual: a table of each part's codewords, summed along the codes."""
    table = ((books - query.reshape(len(books), 1, -1)) ** 2).sum(axis=2)
    return table[np.arange(len(books)), codes].sum(axis=1)


class CellIndex:
    """Every vector with its cell and code; centres and codewords come from a bounded sample, all rows are indexed.

    Vectors are indexed by direction: null and zero ones, and such with a null or non-finite component,
    have none and are left out.  ``save`` writes vectors and codes in a folder a cell, by as many tasks as
    ``task_rows`` asks for, and a loaded index reads the folders of the cells that a batch probes.
    """

    def __init__(self, corpus: DataFrame, cells: int = 100, parts: int = 16, sample_rows: int = 50_000, seed: int = 1) -> None:
        length = vectors.norm(F.col("embedding"))
        rows = corpus.filter("embedding IS NOT NULL").select("id", "embedding").filter(F.coalesce((length > 0) & (length < float("inf")), F.lit(False)))
        self.n = rows.count()
        share = min(1.0, sample_rows / max(1, self.n))
        spark, vector = corpus.sparkSession, array_to_vector(_unit(F.col("embedding"))).alias("features")
        sample = rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20)).select(vector)
        if not sample.take(1):
            sample = rows.select(vector)
        model = KMeans(k=max(1, min(cells, self.n)), seed=seed, maxIter=10).fit(sample)
        self.centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell long, centre array<double>")
        placed = model.transform(rows.withColumn("features", vector)).select("id", "embedding", F.col("prediction").cast("long").alias("cell"))
        dim = len(model.clusterCenters()[0])
        parts = max(1, min(parts, dim))
        wide = -(-dim // parts)
        centres = np.zeros((len(model.clusterCenters()), parts * wide))
        centres[:, :dim] = model.clusterCenters()
        self.books = self._books(model.transform(sample), centres, parts, wide)
        shared = spark.sparkContext.broadcast((centres, self.books))

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            middle, books = shared.value
            for batch in batches:
                unit, cell = _units(batch.column(1), middle.shape[1]), batch.column(2).to_numpy()
                residual = (unit - middle[cell]).reshape(len(unit), len(books), -1)
                codes = np.stack([nearest(residual[:, p], books[p]) for p in range(len(books))], axis=1).astype(np.uint8) if len(unit) else np.empty((0, len(books)), np.uint8)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "embedding", "cell", "code"])

        kind = placed.schema["embedding"].dataType.simpleString()
        self.rows = placed.mapInArrow(code, f"id {placed.schema['id'].dataType.simpleString()}, embedding {kind}, cell long, code binary")

    @staticmethod
    def _books(assigned: DataFrame, centres: np.ndarray, parts: int, wide: int) -> np.ndarray:
        """(part, codeword, values), each part's words learned in a task of its own."""
        shared = assigned.sparkSession.sparkContext.broadcast(centres)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                residual = (_units(batch.column(0), parts * wide) - shared.value[batch.column(1).to_numpy()]).reshape(-1, parts, wide)
                for p in range(parts):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(residual), p), pa.int32()), pa.array([r.tobytes() for r in residual[:, p]], pa.binary())], names=["part", "value"])

        def learn(rows: pa.Table) -> pa.Table:
            values = np.frombuffer(b"".join(sorted(rows["value"].to_pylist()))).reshape(-1, wide)
            return pa.table([rows["part"].slice(0, 1), pa.array([codewords(values).tobytes()], pa.binary())], names=["part", "words"])

        rows = assigned.select(vector_to_array("features").alias("v"), F.col("prediction").cast("long").alias("cell"))
        found = rows.mapInArrow(cut, "part int, value binary").groupBy("part").applyInArrow(learn, "part int, words binary").collect()
        out = np.full((parts, _CODEWORDS, wide), np.inf)
        for r in found:
            words = np.frombuffer(r["words"]).reshape(-1, wide)
            out[r["part"], : len(words)] = words
            out[r["part"], len(words) :] = words[:1]
        return out

    def save(self, path: str, task_rows: int = 2_000_000) -> None:
        spark = self.centres.sparkSession
        self.centres.write.parquet(f"{path}/centres")
        spark.createDataFrame([(i, b.tobytes(), b.shape[1]) for i, b in enumerate(self.books)], "part int, words binary, wide int").coalesce(1).write.parquet(f"{path}/books")
        salts = max(1, self.n // max(1, self.centres.count()) // task_rows + 1)
        dealt = self.rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(salts)))
        dealt.write.partitionBy("cell").parquet(f"{path}/rows")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CellIndex:
        out = cls.__new__(cls)
        out.centres = spark.read.parquet(f"{path}/centres")
        out.books = np.stack([np.frombuffer(r["words"]).reshape(-1, r["wide"]) for r in spark.read.parquet(f"{path}/books").orderBy("part").collect()])
        out.rows = spark.read.parquet(f"{path}/rows").withColumn("cell", F.col("cell").cast("long"))
        return out

    def _near(self, q: DataFrame, probe: int) -> DataFrame:
        """(qid, cell): each query's nearest cells, by direction."""
        near = q.crossJoin(F.broadcast(self.centres)).withColumn("d", vectors.squared_distance(F.col("centre"), _unit(F.col("qvec"))))
        near = near.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.round("d", DIGITS), "cell")))
        return near.filter(F.col("n") <= probe).select("qid", "cell")

    def search(self, queries: DataFrame, k: int, probe: int, shortlist: int | None = None) -> DataFrame:
        """(qid, id, similarity, rank) from each query's ``probe`` nearest cells.

        With ``shortlist`` the cells' codes are scanned and so many vectors a query are read and scored
        exactly; without, all vectors of the cells are.  Without a shortlist and with all cells it's exact.
        """
        usable = queries.select("qid", "qvec").filter("qvec IS NOT NULL").filter(F.coalesce(vectors.norm(F.col("qvec")) > 0, F.lit(False)))
        return by_parts(usable, lambda part: self._exact(part, k, probe) if shortlist is None else self._coded(part, k, probe, shortlist))

    def _exact(self, q: DataFrame, k: int, probe: int) -> DataFrame:
        near = self._near(q, probe).toArrow().to_pandas()
        own = q.select("qid", F.col("qvec").cast("array<double>").alias("qvec")).toArrow()
        place = {qid: i for i, qid in enumerate(own["qid"].to_pylist())}
        of_cell = {int(c): [place[qid] for qid in g["qid"].tolist()] for c, g in near.groupby("cell")}
        shared = q.sparkSession.sparkContext.broadcast((own, of_cell))
        rows = self.rows.filter(F.col("cell").isin(list(of_cell))).select(F.col("id").cast("string").alias("id"), "embedding", "cell")
        # A task multiplies a cell's vectors with the cell's queries and keeps k a query: no pair is made or shuffled.
        return ranked(rows.mapInArrow(lambda batches: best_of(batches, shared.value[0], k, of_cell=shared.value[1]), "qid long, id string, similarity double"), "similarity", k)

    def shortlist(self, q: DataFrame, probe: int, most: int) -> DataFrame:
        """(qid, id, distance): by their codes the nearest ``most`` rows of each query's cells."""
        near = self._near(q, probe).toArrow().to_pandas()
        centres = {r["cell"]: np.array(r["centre"]) for r in self.centres.collect()}
        own = q.toArrow()
        width = self.books.shape[0] * self.books.shape[2]
        asked = dict(zip(own["qid"].to_pylist(), _units(own["qvec"].combine_chunks(), width), strict=True))
        by_cell = {int(c): g["qid"].tolist() for c, g in near.groupby("cell")}
        shared = q.sparkSession.sparkContext.broadcast((by_cell, asked, centres, self.books))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_cell, asked, centres, books = shared.value
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                ids, cells = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(2).to_numpy()
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(ids), len(books))
                for cell in np.unique(cells).tolist():
                    at = np.flatnonzero(cells == cell)
                    middle = np.zeros(books.shape[0] * books.shape[2])
                    middle[: len(centres[cell])] = centres[cell]
                    for qid in by_cell.get(cell, ()):
                        distance = np.round(code_distances(codes[at], asked[qid] - middle, books), DIGITS)
                        old = best.get(qid, (np.empty(0), np.empty(0, dtype=object)))
                        d, names = np.concatenate([old[0], distance]), np.concatenate([old[1], ids[at]])
                        if len(d) > most:
                            keep = np.flatnonzero(d <= np.partition(d, most - 1)[most - 1])
                            keep = sorted(keep.tolist(), key=lambda i: (d[i], names[i]))[:most]  # noqa: B023
                            d, names = d[keep], names[keep]
                        best[qid] = d, names
            sizes = [len(d) for d, _ in best.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(list(best), dtype=np.int64), sizes)), pa.array([x for _, n in best.values() for x in n], pa.string()), pa.array(np.concatenate([np.empty(0), *(d for d, _ in best.values())]))], names=["qid", "id", "distance"]
            )

        rows = self.rows.filter(F.col("cell").isin(list(by_cell))).select(F.col("id").cast("string").alias("id"), "code", "cell")
        return ranked(rows.mapInArrow(scan, "qid long, id string, distance double"), "distance", most, descending=False).select("qid", "id", "distance")

    def _coded(self, q: DataFrame, k: int, probe: int, most: int) -> DataFrame:
        few, _ = held(self.shortlist(q, probe, most).select("qid", "id"), CANDIDATES)
        hits = self.rows.select("id", "embedding").join(few, "id").join(q, "qid")
        return ranked(hits.select("qid", "id", vectors.cosine(F.col("embedding"), F.col("qvec")).alias("similarity")), "similarity", k)


def _units(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column at unit length, zeros behind them up to ``width``."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = v
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-300)[:, None]
