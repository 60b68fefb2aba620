"""Hard-negative mining by lists that all anchors of a cluster share.

Anchors of one label are clustered by direction.  Over a block of candidates, a cluster has one
list: the candidates in the order of an upper bound on their inner product with any member of
unit length, |c| cos(max(0, angle(c, centre) - spread)), where the spread is the widest angle
between a member and the centre.  The list is sorted once; every member walks it until its
own length times the bound at the current place is below all that it still looks for, which
certifies that nothing behind can count.  Members walk together, a stretch of the list at a
time, as one matrix product.

A first walk over candidates of the anchor's label finds its positives, a second one over the
others finds, for the band of scores of each positive, the best within it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, topk

_BLOCK = "ids binary, labels binary, vectors binary, dims int"
_CLUSTER = "batch long, label long, centre binary, ids binary, vectors binary, dims int"
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_FOUND = "anchor_id long, slot_score long, found_id long, score long"


def pack(rows: pa.Table) -> pa.Table:
    """A block of candidates as one row."""
    x = common.matrix(rows["x"])
    columns = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), x
    return pa.table([*(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns), pa.array([x.shape[1]], pa.int32())], names=[c.split()[0] for c in _BLOCK.split(", ")])


def directions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero for zero) and lengths."""
    length = np.linalg.norm(v, axis=1)
    return v / np.where(length > 0, length, 1)[:, None], length


def clusters(unit: np.ndarray, size: int, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Unit centres of about ``size`` rows each, and the centre of each row: spherical k-means from evenly spaced rows."""
    centres = unit[np.linspace(0, len(unit) - 1, -(-len(unit) // size)).astype(int)]
    for _ in range(rounds):
        own = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        centres = directions(sums)[0]
    return centres, np.argmax(unit @ centres.T, axis=1)


def cluster_rows(rows: pa.Table, size: int) -> pa.Table:
    """A batch of anchors as one row per cluster; the members of a cluster have one label."""
    rows = rows.sort_by("vec_id")
    x, ids, labels, out = common.matrix(rows["x"]), rows["vec_id"].to_numpy(), rows["label"].to_numpy(), []
    unit = directions(x / np.maximum(1.0, np.abs(x).max(axis=1))[:, None])[0]
    for label in np.unique(labels):
        at = np.flatnonzero(labels == label)
        centres, own = clusters(unit[at], size)
        for c in np.unique(own):
            some = at[own == c]
            out.append((rows["batch"][0].as_py(), int(label), centres[c].tobytes(), ids[some].tobytes(), x[some].tobytes(), x.shape[1]))
    kinds = pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _CLUSTER.split(", ")])


def shared_list(centre: np.ndarray, spread: float, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, bounds) of candidates in falling order of the bound; margins are above the rounding of the angles."""
    unit, length = directions(v)
    angle = np.arccos(np.clip(unit @ centre, -1, 1))
    bound = length * np.cos(np.maximum(0, angle - spread - 1e-6))
    bound += 1e-9 * np.abs(bound)
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


@dataclass
class Walk:
    """The members of a cluster with their slots: the bands of scores (low to high, ends included)
    in which each looks for its k best, and what has been found."""

    label: int
    centre: np.ndarray
    ids: np.ndarray
    v: np.ndarray  # whole numbers, as doubles or Python integers
    low: np.ndarray  # members x slots, longs
    high: np.ndarray
    k: int
    found: list[np.ndarray] = field(default_factory=lambda: [np.empty(0, np.int64)] * 3)  # member * slots + slot, score, id
    steps: int = 0

    def __post_init__(self) -> None:
        self.floor = np.where(self.low <= self.high, self.low, common.LONG[1])  # what a slot still looks for
        self.empty = self.low > self.high
        if self.v.dtype != object:
            unit, self.length = directions(self.v)
            self.spread = float(np.arccos(np.clip(unit[self.length > 0] @ self.centre, -1, 1)).max(initial=0))

    def over(self, v: np.ndarray, ids: np.ndarray, step: int = 512) -> None:
        """Walks the shared list of a block of candidates."""
        kind = common.exact_kind(v, self.v)
        if object in (kind, v.dtype, self.v.dtype):  # beyond the exact range of doubles no bound certifies: to the end
            order, bound, kind = np.arange(len(v)), np.full(len(v), np.inf), object
            length = np.ones(len(self.v))
        else:
            order, bound = shared_list(self.centre, self.spread, v)
            length = self.length
        own, all_, at, slots = common.in_kind(self.v, kind), common.in_kind(v, kind), 0, self.low.shape[1]
        while at < len(order):
            active = np.flatnonzero((length * bound[at] >= self.floor.min(axis=1)) & ~self.empty.all(axis=1))
            if not len(active):
                break
            some = order[at : at + step]
            self.steps += len(active) * len(some)
            score = common.product(own[active], all_[some].T)
            other = self.ids[active][:, None] != ids[some]
            for slot in range(slots):
                good = (score >= self.floor[active, slot, None]) & (score <= self.high[active, slot, None]) & other & ~self.empty[active, slot, None]
                member, place = np.nonzero(good)
                if len(member):
                    self._add(active[member] * slots + slot, score[member, place], ids[some[place]])
            at, step = at + step, 2 * step

    def _add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        both = [np.concatenate(x) for x in zip(self.found, (row, score, ids), strict=True)]
        kept = common.best_rows(*both, self.k)
        self.found = [x[kept] for x in both]
        counts = np.bincount(self.found[0], minlength=self.low.size)
        full = np.flatnonzero(counts == self.k)
        self.floor.ravel()[full] = self.found[1][np.cumsum(counts)[full] - 1]


def mine_blocks(batches: Iterator[pa.RecordBatch], walks: list[Walk], slot_scores: list[np.ndarray], same: bool, scale: float) -> Iterator[pa.RecordBatch]:
    """The finds of all members of a batch's clusters over a task's blocks; ``same``: among rows of their label, else among the others."""
    for batch in batches:
        for ids, labels, vectors, dims in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids, labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
            x = np.frombuffer(vectors).reshape(len(ids), dims)
            for label in {w.label for w in walks}:
                some = np.flatnonzero((labels == label) == same)
                v = common.whole(x[some], scale)
                for w in walks:
                    if w.label == label:
                        most = max(dims, w.v.shape[1])  # the shorter side ends in zeros
                        w.v, w.centre = common.widened(w.v, most), common.widened(w.centre, most)
                        w.over(common.widened(v, most), ids[some])
    for w, slots in zip(walks, slot_scores, strict=True):
        row, score, found = w.found
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (w.ids[row // w.low.shape[1]], slots.ravel()[row], found, score)], names=["anchor_id", "slot_score", "found_id", "score"])


def _walks(rows: pa.Table, bands: dict[int, list[int]] | None, scale: float, k: int, low: tuple[int, int], high: tuple[int, int], slots: int) -> tuple[list[Walk], list[np.ndarray]]:
    """Walks of a batch's clusters: for the best at all, or within the bands below the scores known for each anchor."""
    out, known = [], []
    for r in rows.to_pylist():
        ids = np.frombuffer(r["ids"], np.int64)
        v = common.whole(np.frombuffer(r["vectors"]).reshape(len(ids), r["dims"]), scale)
        score, lo, hi = np.zeros((len(ids), slots), np.int64), np.full((len(ids), slots), common.LONG[0]), np.full((len(ids), slots), common.LONG[1])
        if bands is not None:
            lo, hi = hi, lo  # no slot, unless it has a score
            for i, anchor in enumerate(ids.tolist()):
                for j, p in enumerate(bands.get(anchor, [])):
                    score[i, j], lo[i, j], hi[i, j] = p, -(-low[0] * p // low[1]), high[0] * p // high[1]
        out.append(Walk(r["label"], np.frombuffer(r["centre"]), ids, v, lo, hi, k))
        known.append(score)
    return out, known


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each key over all tasks, in two steps: no task gets all tasks' finds of one key at once."""
    for by in ([*keys, F.pmod(F.xxhash64("found_id"), F.lit(16))], keys):
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "found_id")
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found


def mine(
    embeddings: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: tuple[int, int] = (50, 100),
    high: tuple[int, int] = (95, 100),
    scale: float = 256.0,
    members: int = 64,
    block: int = 8192,
    anchor_block: int = 32_768,
) -> DataFrame:
    """Hard negatives of each anchor and positive: anchor_id, positive_id, rank int (from 1),
    negative_id, positive_score, negative_score.

    ``embeddings`` has vec_id long, label and embedding array of numbers; other columns are
    ignored, whatever their names.  Scores are integer inner products of floor(scale * x); one
    beyond a long's range counts as the nearest end of it.  An anchor's positives are its best
    rows of the same label, and its negatives those best rows of other labels whose score is
    within low and high (fractions, ends included) of the positive's; ties go to the smaller
    vec_id, and where there are fewer, all are taken.  Rows with a null id, label or vector, or
    a null or non-finite component take no part; an empty vector is a zero one, and a shorter
    vector counts as ending in zeros.  A repeated vec_id is one row, that of its greatest label
    and vector; rows that differ in their id alone are rows each.  An empty table gives no rows.

    Blocks hold about ``block`` candidates, a broadcast about ``anchor_block`` anchors, in
    clusters of about ``members``; each batch of anchors reads the blocks twice, and its result
    is written before the next is broadcast.
    """
    spark = embeddings.sparkSession
    good = embeddings.filter(topk.usable(F.col("embedding")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("x")).alias("r"))
    rows = common.written(rows.groupBy("vec_id").agg(F.max("r").alias("r")).select("vec_id", "r.*"))
    anchors = rows.filter(is_anchor)
    n_blocks, n_batches = max(1, -(-rows.count() // block)), max(1, -(-anchors.count() // anchor_block))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(n)), F.lit(n))
    blocks = common.written(rows.withColumn("block", deal(n_blocks)).groupBy("block").applyInArrow(pack, _BLOCK))
    grouped = common.written(anchors.withColumn("batch", deal(n_batches)).groupBy("batch").applyInArrow(lambda t: cluster_rows(t, members), _CLUSTER), "batch")
    common.discard(rows)
    target, columns = common.shared_dir(spark), _OUT
    spark.createDataFrame([], columns).write.parquet(target)
    for i in range(n_batches):
        batch = grouped.filter(F.col("batch") == i).toArrow()

        def walked(k: int, same: bool, bands: dict[int, list[int]] | None, slots: int, batch: pa.Table = batch) -> DataFrame:
            shared = spark.sparkContext.broadcast((batch, bands))
            found = blocks.mapInArrow(lambda b: mine_blocks(b, *_walks(*shared.value, scale, k, low, high, slots), same, scale), _FOUND)
            kept = common.written(_ranked(found, ["anchor_id", "slot_score"], k))
            shared.destroy()
            return kept

        best = walked(positives, True, None, 1)
        bands: dict[int, list[int]] = {}
        for anchor, score in best.select("anchor_id", "score").distinct().toArrow().to_pandas().itertuples(index=False):
            bands.setdefault(anchor, []).append(score)
        hard = walked(negatives, False, bands, positives)
        pairs = best.select("anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
        pairs = pairs.join(hard.select("anchor_id", F.col("slot_score").alias("positive_score"), "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor_id", "positive_score"])
        pairs.select(*(c.split()[0] for c in columns.split(", "))).write.mode("append").parquet(target)
        common.discard(best, hard)
    common.discard(blocks, grouped)
    return spark.read.schema(columns).parquet(target)
