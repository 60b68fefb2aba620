"""Benchmark decontamination by canonical templates, with DataFrame functions only.

Numbers, units that follow a number and capitalised words become typed
placeholders (0, 1, 2), the rest becomes lower case; whatever is no letter, mark
or number parts words.  The hashes of all windows of eight template words are hash-joined with those of
the benchmark items.  Matches of a document and an item that lie on one diagonal
are aligned word by word, and the fillers of their placeholders compared: a copy
fills them alike, a re-parameterised question renames them consistently (one
filler for each original, and back), while a chance match doesn't.

A second hash join looks for exact copies whatever their case, slots or length: it
takes windows of eight words that only lose their case, and of a shorter item all its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Unit words.
UNITS = "km m cm mm mi ft in kg g mg lb oz l ml s ms min h hr hours hour minutes minute seconds second days day weeks week months month years year percent dollars dollar euros euro usd eur cents"


@dataclass(frozen=True)
class Params:
    #: Words of a window, a power of two.
    window: int = 8
    #: Windows of an item with fewer words that are no placeholder are not used.
    literals: int = 3
    #: A hit covers this share of the item's windows, or has this many windows.
    coverage: float = 0.3
    windows: int = 12
    consistency: float = 0.7
    #: Up to so many benchmark windows (16 bytes and two ids each) are broadcast; more are shuffled.
    broadcast_windows: int = 400_000


_OUTSIDE = r"[^\p{L}\p{M}\p{N}]"
_INSIDE = r"[\p{L}\p{M}\p{N}]"


def words(text: Column) -> Column:
    """The words of a text, in source or template form; a text that begins or ends
    with punctuation has an empty first or last word in both."""
    return F.split(text, _OUTSIDE + "+")


def template(text: Column) -> Column:
    """The canonical form of a text, word for word in the same places.

    Each pattern begins with the character it looks for, and looks behind only there.
    """
    numbers = F.regexp_replace(text, "[0-9]+", "0")
    units = F.regexp_replace(numbers, rf"0(?<!{_INSIDE}0){_OUTSIDE}+(?:" + "|".join(UNITS.split()) + rf")(?!{_INSIDE})", "0 1")
    return F.lower(F.regexp_replace(units, rf"\p{{Lu}}(?<!{_INSIDE}\p{{Lu}})[\p{{L}}\p{{M}}]*", "2"))


def plain(text: Column) -> Column:
    """The text without case; ß is ss, as in capitals."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def with_window_hashes(rows: DataFrame, tokens: str, window: int) -> DataFrame:
    """Adds ``h``: for every place the hash of the window that starts there (those past
    the end match nothing).  Widths double from step to step; each step is a projection
    of its own, since an expression that names its operand twice would be worked out
    anew for each mention.  Explode ``h`` with an outer form: the plain one infers a
    filter on its operand, in which all steps would be folded into one expression."""
    rows, n = rows.withColumn("h", F.transform(tokens, lambda t: F.xxhash64(t))), 1
    while n < window:
        rows = rows.withColumn("h", F.zip_with("h", F.slice("h", n + 1, 1 << 30), lambda a, b: F.xxhash64(a, b)))
        n *= 2
    return rows


def item_windows(benchmark: DataFrame, p: Params) -> DataFrame:
    """(h, item_id, item_at) of the usable windows of the items."""
    items = benchmark.filter("item_id IS NOT NULL").select("item_id", words(template(F.col("text"))).alias("t"))
    items = items.filter(F.size("t") >= p.window)
    placed = with_window_hashes(items, "t", p.window).select("item_id", "t", F.posexplode_outer("h").alias("item_at", "h")).filter(F.col("item_at") <= F.size("t") - p.window)
    window = F.slice("t", F.col("item_at") + 1, p.window)
    literal = F.size(F.filter(window, lambda t: ~t.isin("0", "1", "2")))
    return placed.filter((literal >= p.literals) & ~F.array_contains(window, "")).select("h", "item_id", "item_at").distinct()


def with_plain_windows(rows: DataFrame, tokens: str, p: Params, lengths: list[int]) -> DataFrame:
    """Adds ``plain_h``: an array of (width, h), h as in ``with_window_hashes``, for the
    full window and each of ``lengths`` below it.  A width between powers of two joins
    two windows that overlap."""
    rows, n = rows.withColumn("w1", F.transform(tokens, lambda t: F.xxhash64(t))), 1
    while n < p.window:
        rows = rows.withColumn(f"w{2 * n}", F.zip_with(f"w{n}", F.slice(f"w{n}", n + 1, 1 << 30), lambda a, b: F.xxhash64(a, b)))
        n *= 2
    held = []
    for width in [*lengths, p.window]:
        low = 1 << (width.bit_length() - 1)
        h = F.col(f"w{low}") if low == width else F.zip_with(f"w{low}", F.slice(f"w{low}", width - low + 1, 1 << 30), lambda a, b: F.xxhash64(a, b, F.lit(width)))
        held.append(F.struct(F.lit(width).alias("width"), h.alias("h")))
    return rows.withColumn("plain_h", F.array(*held))


def plain_windows(benchmark: DataFrame, p: Params) -> DataFrame:
    """(width, h, item_id, item_at): the different windows of the items without case, each
    at its first place; of an item below the window, all its words."""
    items = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", F.array_remove(words(plain(F.col("text"))), "").alias("t")).filter(F.size("t") > 0)
    placed = with_plain_windows(items, "t", p, list(range(1, p.window))).select("item_id", F.size("t").alias("n"), F.explode_outer("plain_h").alias("x"))
    placed = placed.filter(F.col("x.width") == F.least("n", F.lit(p.window))).select("item_id", "n", F.col("x.width").alias("width"), F.posexplode_outer("x.h").alias("item_at", "h"))
    return placed.filter(F.col("item_at") <= F.col("n") - F.col("width")).groupBy("width", "h", "item_id").agg(F.min("item_at").alias("item_at"))


def exact_copies(docs: DataFrame, benchmark: DataFrame, p: Params) -> DataFrame:
    """(doc_id, item_id, n, item_windows) by plain windows: so many of the item's
    different windows are in the document."""
    windows = common.written(plain_windows(benchmark, p))
    total = windows.groupBy("item_id").agg(F.count("*").alias("item_windows"))
    lengths = sorted(r["width"] for r in windows.filter(F.col("width") < p.window).select("width").distinct().collect())
    probe = F.broadcast(windows) if windows.count() <= p.broadcast_windows else windows
    hashed = with_plain_windows(docs.select("doc_id", words(plain(F.col("text"))).alias("t")), "t", p, lengths)
    hashed = hashed.select("doc_id", F.explode_outer("plain_h").alias("x")).select("doc_id", F.col("x.width").alias("width"), F.explode_outer("x.h").alias("h"))
    found = hashed.join(probe, ["width", "h"]).select("doc_id", "item_id", "item_at").distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("n"))
    return found.join(total, "item_id")


def _slots(p: Params) -> Column:
    """Aligned fillers (item's, document's) of the places that are placeholders in both."""
    at = F.sequence(F.col("lo"), F.col("hi") + p.window - 1)
    place = F.filter(at, lambda i: F.get("item_t", i).isin("0", "1", "2") & (F.get("item_t", i) == F.get("doc_t", i + F.col("shift"))))
    return F.transform(place, lambda i: F.struct(F.lower(F.get("item_w", i)).alias("a"), F.lower(F.get("doc_w", i + F.col("shift"))).alias("b")))


def contaminated(documents: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id,
    windows and item_windows long, coverage double, slots and changed_slots long,
    consistency double (1: fillers equal or renamed one to one).

    Null and empty texts hold nothing; items with a null id or without a word are not
    looked for; one with fewer words than a window, whole and exact but for case and
    punctuation.  Where only plain windows show an item, the figures count these (each
    different one once) and there are no slots.  Rows that share a doc_id count
    as one document (of null ids too); equal items are each reported.  Empty
    tables give no rows; more columns are ignored.
    """
    docs = documents.select("doc_id", "text")
    windows = item_windows(benchmark, p)
    n_windows = windows.groupBy("item_id").agg(F.count("*").alias("item_windows"))
    probe = F.broadcast(windows) if windows.count() <= p.broadcast_windows else windows
    hashed = docs.select("doc_id", words(template(F.col("text"))).alias("t"))
    hashed = with_window_hashes(hashed, "t", p.window).select("doc_id", F.posexplode_outer("h").alias("at", "h"))
    hits = hashed.join(probe, "h").groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
    runs = common.written(hits.agg(F.count_distinct("item_at").alias("n"), F.min("item_at").alias("lo"), F.max("item_at").alias("hi")))

    own = runs.select("doc_id").distinct()
    texts = docs.join(own.hint("merge"), docs["doc_id"].eqNullSafe(own["doc_id"]), "left_semi").dropDuplicates(["doc_id"])
    texts = texts.select("doc_id", words(F.col("text")).alias("doc_w"), words(template(F.col("text"))).alias("doc_t"))
    items = benchmark.filter("item_id IS NOT NULL").dropDuplicates(["item_id"]).select("item_id", words(F.col("text")).alias("item_w"), words(template(F.col("text"))).alias("item_t"))
    texts = texts.withColumnRenamed("doc_id", "d")
    aligned = runs.join(texts, F.col("doc_id").eqNullSafe(F.col("d"))).drop("d").join(items, "item_id").select("doc_id", "item_id", "n", _slots(p).alias("slots"))
    pairs = F.array_distinct("slots")
    least = F.least(F.size(F.array_distinct(F.transform("slots", lambda s: s["a"]))), F.size(F.array_distinct(F.transform("slots", lambda s: s["b"]))))
    judged = aligned.select(
        "doc_id", "item_id", "n", F.size("slots").alias("slots"), F.size(F.filter("slots", lambda s: s["a"] != s["b"])).alias("changed"), F.when(F.size("slots") == 0, 1.0).otherwise(least / F.size(pairs)).alias("consistency")
    )
    found = judged.filter(F.col("consistency") >= p.consistency).groupBy("doc_id", "item_id")
    found = found.agg(F.sum("n").alias("n"), F.sum("slots").alias("slots"), F.sum("changed").alias("changed_slots"), F.min("consistency").alias("consistency")).join(n_windows, "item_id")
    exact = exact_copies(docs, benchmark, p).withColumns({"slots": F.lit(0), "changed_slots": F.lit(0), "consistency": F.lit(1.0), "by_template": F.lit(False)})
    share = F.least(F.lit(1.0), F.col("n") / F.col("item_windows"))
    hit = found.withColumn("by_template", F.lit(True)).unionByName(exact).withColumn("coverage", share).filter((share >= p.coverage) | (F.col("n") >= p.windows))
    figures = F.max(F.struct("by_template", F.col("n").alias("windows"), "item_windows", "coverage", F.col("slots").cast("long").alias("slots"), F.col("changed_slots").cast("long").alias("changed_slots"), "consistency")).alias("x")
    return hit.groupBy("doc_id", "item_id").agg(figures).select("doc_id", "item_id", *(f"x.{c}" for c in ("windows", "item_windows", "coverage", "slots", "changed_slots", "consistency")))


def clean(documents: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents that hold no benchmark item, all columns.

    Each row is judged by its own text, whether its doc_id is null or repeated.
    """
    row = common.fresh(documents, "_row")
    rows = documents.withColumn(row, F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5("text")))
    found = contaminated(rows.select(F.col(row).alias("doc_id"), "text"), benchmark, p).select(F.col("doc_id").alias(row)).distinct()
    return rows.join(found, row, "left_anti").select(documents.columns)
