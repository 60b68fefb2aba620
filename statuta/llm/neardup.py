"""MinHash near-duplicate linking through a multi-index Hamming join.

Method.  A document's set of word shingles gets a signature of ``chunks * size``
symbols, each the low bits of one MinHash.  Two signatures at Hamming distance
(in symbols) below ``chunks * (errors + 1)`` have, by the pigeonhole principle,
at least one chunk with no more than ``errors`` differing symbols.  The allowed
errors of a chunk are enumerated by leaving out each choice of ``errors``
symbols; equal remainders make an index entry, so every pair under the distance
threshold meets in some entry.

Links are confirmed on full sets.  An entry may hold thousands of documents, so
its pairs are never enumerated:

1. documents with equal sets collapse into one representative;
2. in each entry every member is confirmed against one hub, its most central one;
3. members not linked to their hub may still be linked to one another.  For two
   members x, y of a hub h the symmetric differences X = x ^ h, Y = y ^ h
   satisfy ``|x ^ y| = |X| + |Y| - 2 |X & Y|``; a link asks ``|x ^ y| <=
   rate * (|x| + |y|)``, hence a minimum overlap of X and Y.  Prefixes of the
   differences, ordered with the elements foreign to the hub first, then form
   the keys of an exact prefix-filter join.  Copies of one text with private
   edits share no foreign element, so this join stays near linear.  Two members
   both linked to the hub need no comparison: they are in one component.  Nor
   do two that other hubs have already brought into one component.

Component ids come from large-star/small-star rounds.  All intermediate results
are written tables; none reaches the driver.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import fresh
from .shingle import WordHasher, minhash, mix, set_digest, shingle_set


@dataclass(frozen=True)
class Params:
    width: int = 5
    #: A link: 100 * intersection >= percent * union.
    percent: int = 85
    chunks: int = 6
    size: int = 4
    errors: int = 1
    bits: int = 32
    seed: int = 20_011

    def seeds(self) -> np.ndarray:
        return mix(np.arange(1, self.chunks * self.size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed))

    @property
    def distance(self) -> int:
        """Signature distance up to which every pair is found."""
        return self.chunks * (self.errors + 1) - 1


def index_keys(signatures: np.ndarray, p: Params) -> np.ndarray:
    """The index entries of signatures, a row each: a 64-bit key per chunk and choice of left-out symbols."""
    low = signatures & np.uint64((1 << p.bits) - 1)
    out, n = [], 0
    for c in range(p.chunks):
        for kept in itertools.combinations(range(p.size), p.size - p.errors):
            n += 1
            key = np.full(len(low), n, dtype=np.uint64)
            for j in kept:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low[:, c * p.size + j])
            out.append(key)
    return np.stack(out, axis=1).view(np.int64)


_SIGNED = "doc_id long, n_shingles long, digest binary, entries array<long>"


def signed(docs: DataFrame, p: Params) -> DataFrame:
    """Per document: set size, set digest (null for an empty set) and index entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seeds = WordHasher(), p.seeds()
        width = p.chunks * len(list(itertools.combinations(range(p.size), p.errors)))
        for batch in common.small(batches, 1):
            data, at = common.text_bytes(batch.column(1))
            n = batch.num_rows
            sizes, digests = np.zeros(n, dtype=np.int64), [None] * n
            found, rows = [], []
            for i in range(n):
                s = shingle_set(hasher.words(data[at[i] : at[i + 1]]), p.width)
                sizes[i] = len(s)
                if len(s):
                    digests[i] = set_digest(s)
                    found.append(minhash(s, seeds))
                    rows.append(i)
            ends = np.zeros(n + 1, dtype=np.int32)
            ends[1:][rows] = width
            entries = index_keys(np.stack(found), p).ravel() if found else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(digests, type=pa.binary()), pa.ListArray.from_arrays(np.cumsum(ends, dtype=np.int32), pa.array(entries))],
                names=["doc_id", "n_shingles", "digest", "entries"],
            )

    return docs.mapInArrow(run, _SIGNED)


def _sets(hasher: WordHasher, column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The shingle sets of a column's texts; equal neighbours are made once."""
    data, at = common.text_bytes(column)
    last, made = b"", shingle_set(np.empty(0, dtype=np.uint64))
    for i in range(len(at) - 1):
        own = data[at[i] : at[i + 1]].tobytes()
        if own != last:
            last, made = own, shingle_set(hasher.words(np.frombuffer(own, dtype=np.uint8)), width)
        yield made


def star_pairs(reps: DataFrame) -> DataFrame:
    """(a = hub, b = member) over all index entries of (rep, entries), each pair once, as a written table.

    An entry's hub is its most central member: the one whose entries hold the most
    documents in all, then the least id.  Of copies with private edits that is the
    least edited one, so the others differ from it by little but their own edits.
    """
    entries = reps.select(F.col("rep").alias("b"), F.explode("entries").alias("entry"))
    held = entries.groupBy("entry").agg(F.count("*").alias("n")).filter("n > 1")
    shared = common.written(entries.join(held.hint("merge"), "entry"))
    weight = shared.groupBy("b").agg(F.sum("n").alias("weight"))
    hubs = shared.join(weight.hint("merge"), "b").groupBy("entry").agg((-F.max(F.struct("weight", (-F.col("b")).alias("b")))["b"]).alias("a"))
    pairs = common.written(shared.join(hubs.hint("merge"), "entry").filter("a <> b").select("a", "b").distinct())
    common.discard(shared)
    return pairs


def named_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The texts that some (a, b) pair names, written once: (b, b_text).

    Both sides are shuffled at every size: the ids grow with the corpus, so they
    are not broadcast.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    kept = docs.join(ids.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return common.written(kept.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")))


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, both texts, the pairs' other columns)."""
    hubs = texts.select(F.col("b").alias("a"), F.col("b_text").alias("a_text"))
    return pairs.join(texts.hint("merge"), "b").join(hubs.hint("merge"), "a").select("a", "b", "a_text", "b_text", *(c for c in pairs.columns if c not in ("a", "b")))


def confirmed(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """(a, b, linked) for candidate pairs, decided on full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in common.small(batches, 2, 3):
            linked = [
                100 * (both := len(np.intersect1d(x, y, assume_unique=True))) >= p.percent * (len(x) + len(y) - both)
                for x, y in zip(_sets(hasher, batch.column(2), p.width), _sets(hasher, batch.column(3), p.width), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, type=pa.bool_())], names=["a", "b", "linked"])

    return _with_texts(pairs, texts).mapInArrow(run, "a long, b long, linked boolean")


_DELTA = "hub long, x long, linked boolean, part long, size long, delta long, element long, place long, small boolean, large boolean"


def difference_keys(stars: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Prefix keys of every member's symmetric difference to its hub.

    ``stars`` has (a = hub, b = member, linked, part = the member's component so far).  A key row says whether it
    serves where the member has the smaller difference of a pair, the larger,
    or either.  With rate r = (100 - percent) / (100 + percent), a link of x and
    y means |X ^ Y| <= r (|x| + |y|) and |y| <= 100 / percent |x|.
    """
    r, most = (100 - p.percent) / (100 + p.percent), (100 - p.percent) / p.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in common.small(batches, 2, 3):
            out: list[list] = [[] for _ in range(10)]
            hub, member, linked, part = (batch.column(i).to_pylist() for i in (0, 1, 4, 5))
            for i, (h, x) in enumerate(zip(_sets(hasher, batch.column(2), p.width), _sets(hasher, batch.column(3), p.width), strict=True)):
                foreign, missing = np.setdiff1d(x, h, assume_unique=True), np.setdiff1d(h, x, assume_unique=True)
                delta = np.concatenate([foreign, missing])
                n, bound = len(delta), most * len(x)
                if linked[i]:  # only a member that isn't linked to the hub matters as the other one
                    small = n - int(np.floor((n + r * (len(h) - len(x))) / 2 - 1e-9)) if n else 0
                    large = int(bound) + 1 if n >= r * (p.percent / 100 * len(x) + len(h)) - 1e-9 else 0
                else:
                    small, large = int(bound / 2) + 2, int(bound) + 2
                keep = min(n, max(small + 1, large))
                place = np.arange(keep)
                for column, values in zip(
                    out,
                    (np.full(keep, hub[i]), np.full(keep, member[i]), np.full(keep, linked[i]), np.full(keep, part[i]), np.full(keep, len(x)), np.full(keep, n), delta[:keep].view(np.int64), place, place <= small, place < large),
                    strict=True,
                ):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=[c.split()[0] for c in _DELTA.split(", ")])

    return _with_texts(stars.select("a", "b", "linked", "part"), texts).mapInArrow(run, _DELTA)


def meetings(keys: DataFrame, p: Params) -> DataFrame:
    """Rows of keys (s_ the smaller difference's, l_ the larger one's) that meet under one (hub, element), in two components so far.

    Members of one component never meet: keys whose rows are all of one component go, and components
    meet before their members do, so that a family of m linked members costs m rows under a key, not m^2.
    """
    mixed = keys.groupBy("hub", "element").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("hub", "element")
    mixed = common.written(keys.join(mixed.hint("merge"), ["hub", "element"]))
    cols = ("x", "part", "size", "delta", "place")
    sides = [mixed.filter(kind).select("hub", "element", *(F.col(c).alias(f"{side}_{c}") for c in cols)) for kind, side in (("small", "s"), ("large", "l"))]
    # Of each component its least and greatest figures: a pair of components stays if some pair of members could fit.
    s, g = (
        rows.groupBy("hub", "element", f"{k}_part").agg(
            *(f(f"{k}_{c}").alias(f"{k}_{c}_{name}") for c in ("size", "delta") for f, name in ((F.min, "least"), (F.max, "most"))), F.max(F.col(f"{k}_delta") - F.col(f"{k}_place")).alias(f"{k}_room")
        )
        for rows, k in zip(sides, "sl", strict=True)
    )
    r = (100 - p.percent) / (100 + p.percent)
    need = F.greatest(F.lit(1.0), F.ceil((F.col("s_delta_least") + F.col("l_delta_least") - r * (F.col("s_size_most") + F.col("l_size_most"))) / 2 - 1e-9))
    near = (100 * F.col("l_size_most") >= p.percent * F.col("s_size_least")) & (100 * F.col("s_size_most") >= p.percent * F.col("l_size_least"))
    near &= (F.col("s_delta_least") <= F.col("l_delta_most")) & (F.col("s_room") >= need) & (F.col("l_room") >= need)
    pairs = s.join(g.hint("merge"), ["hub", "element"]).filter((F.col("s_part") != F.col("l_part")) & near)
    # A member meets the other component's bounds before its members.
    need = F.greatest(F.lit(1.0), F.ceil((F.col("s_delta") + F.col("l_delta_least") - r * (F.col("s_size") + F.col("l_size_most"))) / 2 - 1e-9))
    near = (100 * F.col("l_size_most") >= p.percent * F.col("s_size")) & (100 * F.col("s_size") >= p.percent * F.col("l_size_least"))
    near &= (F.col("s_delta") <= F.col("l_delta_most")) & (F.col("s_delta") - F.col("s_place") >= need) & (F.col("l_room") >= need)
    pairs = pairs.select("hub", "element", "s_part", "l_part", *(f"l_{c}" for c in ("size_least", "size_most", "delta_least", "delta_most", "room")))
    met = pairs.join(sides[0].hint("merge"), ["hub", "element", "s_part"]).filter(near).select("hub", "element", "l_part", *(f"s_{c}" for c in cols))
    out = met.join(sides[1].hint("merge"), ["hub", "element", "l_part"])
    out._written_at = mixed._written_at
    return out


def difference_pairs(keys: DataFrame, p: Params) -> DataFrame:
    """Candidate pairs, as a written table: members of one hub, in two components so far, whose differences overlap enough."""
    r = (100 - p.percent) / (100 + p.percent)
    need = F.greatest(F.lit(1.0), F.ceil((F.col("s_delta") + F.col("l_delta") - r * (F.col("s_size") + F.col("l_size"))) / 2 - 1e-9))
    ordered = (F.col("s_delta") < F.col("l_delta")) | ((F.col("s_delta") == F.col("l_delta")) & (F.col("s_x") < F.col("l_x")))
    sizes = (100 * F.least("s_size", "l_size") >= p.percent * F.greatest("s_size", "l_size"))
    fits = (F.col("s_delta") - F.col("s_place") >= need) & (F.col("l_delta") - F.col("l_place") >= need)
    met = meetings(keys, p)
    out = common.written(met.filter(ordered & sizes & fits).select(F.least("s_x", "l_x").alias("a"), F.greatest("s_x", "l_x").alias("b")).distinct())
    common.discard(met)
    return out


def _state(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge table: equal for equal tables."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, by large-star and small-star rounds.

    Each round writes its edges to the shared folder; the driver sees counts only.
    Nodes without a link don't occur.
    """
    spark = links.sparkSession
    edges = common.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    if not edges.take(1):
        return spark.createDataFrame([], "node long, component long")
    state = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        old, edges = edges, common.written(small.filter("u <> v").distinct())
        common.discard(old)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def numbered(documents: DataFrame, row: str) -> tuple[DataFrame, bool]:
    """The rows with a number in column ``row`` for each different (doc_id, text), null without
    an id: the doc_id itself or, if some id has several texts (then True), the place in their order."""
    text = fresh(documents, "_digest")
    named = documents.withColumn(text, F.coalesce(F.md5("text"), F.lit("")))
    several = named.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(text).alias("low"), F.max(text).alias("high")).filter("low <> high")
    if not several.take(1):
        return documents.withColumn(row, F.col("doc_id").cast("long")), False
    order = ["doc_id", text]
    numbers = named.filter("doc_id IS NOT NULL").select(order).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    numbers = common.written(numbers.withColumn(row, F.monotonically_increasing_id()))
    return common.written(named.join(numbers, order, "left").drop(text)), True


def near_duplicates(documents: DataFrame, p: Params = Params()) -> DataFrame:
    """Per row of ``documents`` (doc_id long, text string; more columns are ignored):
    doc_id, n_shingles long, component_id long, kept boolean.

    A null or empty text, or one of white space only, has an empty set, is linked
    with nothing and is kept.  Exact copies are linked (their ids tie-break: the
    least stays).  Rows with a null doc_id are their own component (null) and
    kept; repeated rows (equal doc_id and text) each get a row with one result.
    Different texts under one doc_id are documents of their own, of which no more than
    one in a component is kept.  An empty table gives no rows.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, several = numbered(docs, "row")
    found = _components_of(rows.select(F.col("row").alias("doc_id"), "text"), p)
    if not several:
        return found
    names = rows.filter("row IS NOT NULL").select("row", "doc_id").distinct()
    found = found.withColumnsRenamed({"doc_id": "row", "component_id": "least"}).join(names, "row", "left")
    least = names.select(F.col("row").alias("least"), F.col("doc_id").alias("component_id"))
    return found.join(least, "least", "left").select("doc_id", "n_shingles", "component_id", "kept")


def without_copies(documents: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``documents``, all columns: of each component the document with the least
    id (repeated rows of it all stay), and every row without an id."""
    row = fresh(documents, "_row")
    rows, _ = numbered(documents, row)
    gone = _components_of(rows.select(F.col(row).alias("doc_id"), "text"), p).filter("NOT kept").select(F.col("doc_id").alias(row)).distinct()
    return rows.join(gone, row, "left_anti").select(documents.columns)


def _components_of(docs: DataFrame, p: Params) -> DataFrame:
    """``near_duplicates`` of documents whose ids name one text each."""
    signs = common.written(signed(docs, p))
    full = signs.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    reps = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("entries", "doc_id").alias("entries"))
    reps = common.written(reps)

    pairs = star_pairs(reps)
    texts = named_texts(pairs, docs)
    found = common.written(confirmed(pairs, texts, p))
    common.discard(pairs)
    parts = common.written(components(found.filter("linked")))

    label = parts.select(F.col("node").alias("b"), "component")
    stars = common.written(found.join(label.hint("merge"), "b", "left").select("a", "b", "linked", F.coalesce("component", "b").alias("part")))
    open_hubs = stars.groupBy("a").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("a")
    keys = common.written(difference_keys(stars.join(open_hubs, "a", "left_semi"), texts, p))
    near = difference_pairs(keys, p)
    rest = common.written(near.join(stars, ["a", "b"], "left_anti"))
    common.discard(found, keys, near)
    more = confirmed(rest, texts, p).filter("linked").select("a", "b")

    first, parts = parts, components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    common.discard(first, stars, texts, rest)
    reps = reps.select("digest", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    grouped = signs.select("doc_id", "n_shingles", "digest").join(reps, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return grouped.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
