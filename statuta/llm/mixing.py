"""Mixing sources to target weights by pivotal dependent rounding in a reduction tree.

Each source has a target of words; its documents are wanted at one rate, so each document has a
whole number of copies for certain and one more with a probability.  Rounding is dependent: of
two documents with fractional probabilities, one gives words' worth of probability to the
other until one of them is certain; who gives is drawn such that each document's expectation
stays.  The words expected of the two together don't change, so a source ends within one
document of its target.  Documents are dealt to leaves by hashes of their own, each leaf
goes from large to small documents and leaves one open, and the open ones of up to a thousand
leaves meet on the next level, until a source has one, which is drawn by its probability.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_SPACE = r"\x20\x09-\x0D"
_LEAF = 1024
_ROW = "source_at long, doc_id long, size long, n long, base long, sure long, p double, leaf long, more long"
#: Up to so many sources, of so many characters, are broadcast to the documents.
_BROADCAST = 50_000, 8_000_000


def word_count(text: Column) -> Column:
    """Words between ASCII white space, without a list of them: each word with the space around it becomes one letter."""
    marked = F.regexp_replace(text, f"[{_SPACE}]*+[^{_SPACE}]++[{_SPACE}]*+", "w")
    return F.coalesce(F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def _numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds ``at``, from 0, in a total order: a sort by ranges, and each range's offset from the counts of those before."""
    placed = common.written(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for p, n in counts:
        starts.append((p, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "part int, start long")
    out = placed.withColumn("part", part.cast("int")).join(F.broadcast(offsets), "part")
    return out.withColumn("at", F.col("start") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("part", "start", "_id")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds ``target`` to (source, source_size, at): shares of ``share`` times all sizes by weight, in turn by ``at``,
    none above ``most`` times its source's size; what is above is shared anew by weight among the others."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("at") % len(weights) + 1).cast("int"))
    rows = sources.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    total, w = rows.agg(F.sum("source_size"), F.sum("w")).first()
    left, w, n_capped = share * (total or 0), w or 0.0, 0
    while w:  # a source above its cap stays there, as the others' shares only grow
        above = F.col("cap") < F.lit(left) * F.col("w") / F.lit(w)
        n, capped, still = rows.agg(F.count_if(above), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("w")))).first()
        if n == n_capped:
            break
        left, w, n_capped = share * total - (capped or 0.0), still or 0.0, n
    fair = F.lit(left) * F.col("w") / F.lit(w) if w else F.col("cap")
    return rows.withColumn("target", F.least("cap", fair)).drop("w", "cap")


def pivot(size: np.ndarray, p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """(each document's extra copy, 0 or 1, or its probability where it is still open; place of the open one or -1).

    Documents come in order; ``u`` are uniform draws.  The sum of size times p doesn't change.
    """
    p, open_ = p.tolist(), -1
    size = size.tolist()
    for j, draw in enumerate(u.tolist()):
        if not 0 < p[j] < 1:
            continue
        if open_ < 0:
            open_ = j
            continue
        i, a, b = open_, size[open_], size[j]
        up, down = min(a * (1 - p[i]), b * p[j]), min(a * p[i], b * (1 - p[j]))
        # With the chance down / (up + down) words of j go to i, so that neither's expectation moves.
        if draw * (up + down) < down:
            full, empty = a * (1 - p[i]) <= b * p[j], a * (1 - p[i]) >= b * p[j]
            p[i], p[j] = 1.0 if full else p[i] + up / a, 0.0 if empty else p[j] - up / b
        else:
            empty, full = a * p[i] <= b * (1 - p[j]), a * p[i] >= b * (1 - p[j])
            p[i], p[j] = 0.0 if empty else p[i] - down / a, 1.0 if full else p[j] + down / b
        open_ = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    return np.clip(p, 0, 1), open_


def _round(last: bool, rows: pa.Table) -> pa.Table:
    """One node of the tree: decided rows with ``more`` 0 or 1, the open one (if any) with ``more`` null."""
    order = np.lexsort((rows["n"].to_numpy(), rows["doc_id"].fill_null(0).to_numpy(), rows["u"].to_numpy(), -rows["size"].to_numpy()))
    rows = rows.take(pa.array(order))
    u = rows["u"].to_numpy()
    p, open_ = pivot(rows["size"].to_numpy(), rows["p"].to_numpy(), u)
    if last and open_ >= 0:
        p[open_], open_ = float(u[open_] < p[open_]), -1
    more = pa.array(np.floor(p).astype(np.int64), mask=np.arange(len(p)) == open_)
    return rows.drop_columns(["u", "p"]).append_column("more", more).append_column("p", pa.array(p)).select([c.split()[0] for c in _ROW.split(", ")])


def _node(last: bool) -> Callable[[pa.Table], pa.Table]:
    return lambda rows: _round(last, rows)


def _draws(rows: DataFrame, seed: int, level: int) -> DataFrame:
    """Adds ``u``, uniform below 1 by a hash of the document, and other on each level."""
    return rows.withColumn("u", F.shiftrightunsigned(F.xxhash64("doc_id", "size", "n", F.lit(seed), F.lit(level)), 11) / float(1 << 53))


def round_copies(rows: DataFrame, leaves: int, seed: int) -> list[DataFrame]:
    """Tables (as ``_ROW``, a level of the tree each) of the rows with ``more`` 0 or 1 instead of their ``p``
    between 0 and 1; a source has up to ``leaves`` of them, numbered from 0."""
    level, out = 0, []
    while True:
        last = leaves <= 1
        out.append(common.written(_draws(rows, seed, level).groupBy("source_at", "leaf").applyInArrow(_node(last), _ROW)))
        if last:
            return out
        rows = out[-1].filter("more IS NULL").withColumn("leaf", F.floor(F.col("leaf") / _LEAF).cast("long")).drop("more")
        level, leaves = level + 1, -(-leaves // _LEAF)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """Per document: doc_id, size long, source_size long, target double (its source's), copies long, taken long (copies times size).

    ``docs`` has doc_id, text and source; other columns are ignored, whatever their names.  A
    size is a text's number of words, of whole texts however long; null and empty ones have none
    and take none.  Sources in code point order, null last, have ``weights`` in turn; they share
    ``share`` times all sizes, none above ``most`` times its own.  A document is taken in whole
    copies, the two numbers next to its source's rate (target / source_size) at most apart from
    it by one, and a source's taken words differ from its target by less than one document, as
    a rule a small one.  The result depends on the rows and the seed alone, not on how they are
    dealt.  Of repeated rows (same id, source and size) each is a document; which of them has
    the extra copy makes no difference to the result.  Rows without an id are documents too.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    units = common.written(sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")))
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units"))
    sources = common.written(targets(_numbered(totals, F.col("source").asc_nulls_last()), weights, share, most))
    n_sources, chars, largest = sources.agg(F.count("*"), F.sum(F.length("source")), F.max("units")).first()
    few = n_sources <= _BROADCAST[0] and (chars or 0) <= _BROADCAST[1]
    leaves = -(-(largest or 0) // _LEAF)
    known = sources.withColumnsRenamed({"source": "_source", "at": "source_at"})
    rows = units.join(F.broadcast(known) if few else known, F.col("source").eqNullSafe(F.col("_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # Of n equal rows floor(n * fraction) have the extra copy for certain; the remainder is one row's probability.
    rows = rows.withColumn("rate", rate).withColumn("base", F.floor("rate").cast("long")).withColumn("sum", F.col("n") * (F.col("rate") - F.col("base")))
    rows = rows.withColumn("sure", F.floor("sum").cast("long")).withColumn("p", F.col("sum") - F.col("sure"))
    leaf = F.pmod(F.xxhash64("doc_id", "size", "n", F.lit(seed)), F.ceil(F.col("units") / _LEAF).cast("long"))
    rows = common.written(rows.select("source_at", "doc_id", "size", "n", "base", "sure", "p", leaf.alias("leaf")))
    fractional = (F.col("size") > 0) & (F.col("p") > 0)
    levels = round_copies(rows.filter(fractional), leaves, seed)
    decided = rows.filter(~fractional).withColumn("more", F.lit(0).cast("long"))
    for level in levels:
        decided = decided.unionByName(level.filter("more IS NOT NULL"))
    # The n equal rows of a unit, in stretches: sure + more of them have the extra copy.
    wide = 1 << 16
    each = decided.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(wide).cast("long"))))
    each = each.withColumn("nth", F.explode(F.sequence("from", F.least(F.col("from") + wide, F.col("n")) - 1)))
    copies = F.when(F.col("size") > 0, F.col("base") + (F.col("nth") < F.col("sure") + F.col("more")).cast("long")).otherwise(F.lit(0).cast("long"))
    facts = sources.select(F.col("at").alias("source_at"), "source_size", "target")
    out = each.join(F.broadcast(facts) if few else facts, "source_at").select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    out = common.written(out)
    common.discard(units, sources, rows, *levels)
    return out
