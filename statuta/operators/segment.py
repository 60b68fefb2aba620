"""From statute text to articles, paragraphs and chunks."""

from __future__ import annotations

import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import batches, text, vectors
from . import corpus

#: A mark that no text holds: it is drawn anew for each session.
_CUT = f"\x01{uuid.uuid4().hex}\x01"


def page_text(pages: DataFrame, doc: str, order: str, content: str) -> DataFrame:
    """(doc, text): the pages of a document in order, each followed by a newline."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, content))), lambda p: F.concat(p[content], F.lit("\n")))
    joined = F.array_join(parts, "")
    return pages.filter(F.col(content).isNotNull()).groupBy(doc).agg(joined.alias("text"))


def articles(laws: DataFrame, keep: str = "first", least: int = 10, most: int = 2000) -> DataFrame:
    """(law_id, article_number, title, content) of texts (law_id, text).

    An article goes from its head to the next head, repeated ones included.  Of
    repeated numbers the first (or, by choice, the longest) stays; only then do
    contents of ``least`` characters or fewer go.  Long ones are cut before they are
    shuffled, their length goes along.
    """
    pieces = F.split(F.regexp_replace("text", f"({text.ARTICLE_HEAD})", f"{_CUT}$1"), _CUT)
    rows = laws.select("law_id", F.posexplode(pieces).alias("at", "piece")).filter("at > 0")
    head = f"^{text.ARTICLE_HEAD}"
    rows = rows.select(
        "law_id",
        "at",
        F.concat(F.lit("제"), F.regexp_extract("piece", head, 1), F.lit("조")).alias("article_number"),
        F.trim(F.regexp_extract("piece", head, 2)).alias("title"),
        F.trim(F.regexp_replace("piece", head, ""), F.lit(" \n\r\t")).alias("content"),
    )
    rows = rows.withColumn("n", F.length("content")).withColumn("content", text.truncated(F.col("content"), most))
    order = F.struct(-F.col("at")) if keep == "first" else F.struct("n", -F.col("at"))
    best = rows.groupBy("law_id", "article_number").agg(F.max_by(F.struct("title", "content", "at", "n"), order).alias("a")).select("law_id", "article_number", "a.*")
    return best.filter(F.col("n") > least).drop("n")


def paragraphs(rows: DataFrame, key: str, content: str, starts: str = f"^[{text.CIRCLED}]", lead: str = f"^([{text.CIRCLED}])") -> DataFrame:
    """(key, number, content): a line that begins with a marker opens a paragraph, later
    lines join it by a space, blank lines and lines before the first marker go."""
    lines = rows.select(key, F.posexplode(F.split(content, "\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    grouped = lines.withColumn("grp", F.sum(F.col("line").rlike(starts).cast("long")).over(w)).filter("grp > 0")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ")
    return grouped.groupBy(key, "grp").agg(joined.alias("all")).select(key, "grp", F.regexp_extract("all", lead, 1).alias("number"), F.trim(F.regexp_replace("all", lead, "")).alias("content"))


_BOUNDARY = re.compile(r"[.\n]")


def windows(value: str, size: int = 512, overlap: int = 50) -> Iterator[tuple[int, int]]:
    """Bounds of the windows over a text.

    The ends of all full stops and newlines are listed once.  A window ends at the last
    of them that is within ``size`` of its start, provided that the next window, which
    begins ``overlap`` before that end, begins later than this one; else it has full size.
    """
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the window")
    ends, start = [m.end() for m in _BOUNDARY.finditer(value)], 0
    while start + size < len(value):
        nearest = bisect_right(ends, start + size) - 1
        end = ends[nearest] if nearest >= 0 and ends[nearest] > start + overlap else start + size
        yield start, end
        start = end - overlap
    if value:
        yield start, len(value)


def split_text(value: str, size: int = 512, overlap: int = 50) -> list[str]:
    """The windows' texts without white space around them; blank ones go."""
    stripped = (value[a:b].strip() for a, b in windows(value, size, overlap))
    return [t for t in stripped if t]


def split_long_text(content: Column, size: int = 512, overlap: int = 50) -> Column:
    """``split_text`` as an Arrow function: each cut depends on the one before it."""

    @F.arrow_udf("array<string>")
    def split(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches.pieces_of(arrays):
            yield pa.array([None if v is None else split_text(v, size, overlap) for v in values], pa.list_(pa.string()))

    return split(content)


def chunks(rows: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """(chunk_id, law_id, article_number, title, content, chunk_type, part) of articles
    (law_id, article_number, title, content, paragraphs array of (number, content)).

    Short articles are one chunk; long ones one per paragraph or, without any,
    the windows of their text.
    """
    rows = rows.withColumn("whole", F.length("content") < size).withColumn("n_par", F.coalesce(F.greatest(F.size("paragraphs"), F.lit(0)), F.lit(0)))
    base = F.concat_ws("_", "law_id", "article_number")
    kind = F.when(text.is_definition(F.col("title")), "definition").otherwise("article")
    cols = ("law_id", "article_number", "title")
    one = rows.filter("whole").select(base.alias("chunk_id"), *cols, "content", kind.alias("chunk_type"), F.lit(None).cast("long").alias("part"))
    par = rows.filter("NOT whole AND n_par > 0").select(*cols, F.posexplode("paragraphs").alias("i", "p"))
    number = F.coalesce(F.nullif(F.col("p.number"), F.lit("")), (F.col("i") + 1).cast("string"))
    par = par.select(F.concat_ws("_", base, number).alias("chunk_id"), *cols, F.col("p.content").alias("content"), F.lit("paragraph").alias("chunk_type"), F.col("i").cast("long").alias("part"))
    cut = rows.filter("NOT whole AND n_par = 0").select(*cols, F.posexplode(split_long_text(F.col("content"), size, overlap)).alias("i", "content"))
    cut = cut.select(F.concat(base, F.lit("_part"), F.col("i").cast("string")).alias("chunk_id"), *cols, "content", F.lit("text_split").alias("chunk_type"), F.col("i").cast("long").alias("part"))
    return one.unionByName(par).unionByName(cut)


def full_text_chunks(rows: DataFrame, size: int = 512) -> DataFrame:
    """The other chunking: number, title and content as one text, or one per paragraph;
    a long article without paragraphs yields none."""
    whole = F.concat(F.col("article_number"), F.lit(" "), F.coalesce("title", F.lit("")), F.lit("\n"), F.col("content"))
    rows = rows.withColumn("whole", whole)
    one = rows.filter(F.length("whole") < size).select("law_id", "article_number", F.col("whole").alias("content"), F.lit("full_article").alias("chunk_type"), F.lit(0).cast("long").alias("part"))
    par = rows.filter(F.length("whole") >= size).select("law_id", "article_number", F.posexplode("paragraphs").alias("i", "p"))
    body = F.concat(F.col("article_number"), F.lit(" "), F.col("p.number"), F.lit("\n"), F.col("p.content"))
    return one.unionByName(par.select("law_id", "article_number", body.alias("content"), F.lit("paragraph").alias("chunk_type"), F.col("i").cast("long").alias("part")))


def table_chunks(tables: DataFrame) -> DataFrame:
    """Appendix chunks of (law_id, n, title, content)."""
    n = F.col("n").cast("string")
    return tables.select(F.concat_ws("_", "law_id", F.lit("table"), n).alias("chunk_id"), "law_id", F.concat(F.lit("별표"), n).alias("article_number"), "title", "content", F.lit("table").alias("chunk_type"), F.lit(True).alias("is_table"))


def reference_edges(rows: DataFrame) -> DataFrame:
    """(law_id, src, dst, resolved): distinct references between articles of one law, no self-references."""
    refs = rows.select("law_id", F.col("article_number").alias("src"), F.explode(text.distinct_refs(F.col("content"))).alias("ref"))
    refs = refs.select("law_id", "src", F.regexp_extract("ref", "^제[0-9]+조", 0).alias("dst")).distinct().filter("src <> dst")
    known = rows.select("law_id", F.col("article_number").alias("dst")).distinct().withColumn("known", F.lit(True))
    return refs.join(known, ["law_id", "dst"], "left").select("law_id", "src", "dst", F.coalesce("known", F.lit(False)).alias("resolved"))


def degrees(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(law_id, article_number, n_out, n_in) of every article: resolved references it makes, and such to it."""
    known = edges.filter("resolved")
    out, into = (known.groupBy("law_id", F.col(c).alias("article_number")).agg(F.count("*").alias(n)) for c, n in (("src", "n_out"), ("dst", "n_in")))
    key = ["law_id", "article_number"]
    nodes = rows.select(*key).distinct().join(out, key, "left").join(into, key, "left")
    return nodes.select(*key, F.coalesce("n_out", F.lit(0)).cast("long").alias("n_out"), F.coalesce("n_in", F.lit(0)).cast("long").alias("n_in"))


def related_articles(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(law_id, article_number, related, distance): what a seed (law_id, article_number) reaches by up to
    ``hops`` resolved references, itself left out, with the least number of them.

    Breadth first: each hop joins the frontier, those reached for the first time, with the edges.
    Beyond three hops each hop's finds are written to the shared folder, so plans don't grow.
    """
    steps = edges.filter("resolved").select("law_id", F.col("src").alias("at"), F.col("dst").alias("related")).distinct()
    own = seeds.select("law_id", "article_number").distinct()
    seen = own.select("law_id", "article_number", F.col("article_number").alias("related"), F.lit(0).cast("long").alias("distance"))
    frontier, key = seen, ["law_id", "article_number", "related"]
    for hop in range(1, hops + 1):
        reached = frontier.select("law_id", "article_number", F.col("related").alias("at")).join(steps, ["law_id", "at"]).select(key).distinct()
        frontier = reached.join(seen.select(key), key, "left_anti").withColumn("distance", F.lit(hop).cast("long"))
        if hops > 3:
            folder = corpus.scratch_folder(edges.sparkSession)
            frontier.write.parquet(folder)
            frontier = edges.sparkSession.read.parquet(folder)
        seen = seen.unionByName(frontier)
    return seen.filter("distance > 0")


def load_rules(nested: DataFrame) -> DataFrame:
    """(business_type, law, article_number) of nested rules (business_type, required_laws array of (law, articles))."""
    return nested.select("business_type", F.explode("required_laws").alias("r")).select("business_type", F.col("r.law").alias("law"), F.explode("r.articles").alias("article_number"))


def compliance(rules: DataFrame, aliases: DataFrame, rows: DataFrame) -> DataFrame:
    """Rules with law_name and whether the article is in the corpus (law_name, article_number)."""
    have = rows.select("law_name", "article_number").distinct().withColumn("have", F.lit(True))
    return rules.join(aliases, "law", "left").join(have, ["law_name", "article_number"], "left").withColumn("matched", F.coalesce("have", F.lit(False))).drop("have")


def hashing_model(dim: int = 64):
    """A deterministic stand-in for an embedding model: signed feature hashing of words."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
            out.append(v)
        return out

    return encode


class WordVectors:
    """An embedding model trained on the corpus (id, content): a text is the mean of its words' vectors, at unit length.

    The word vectors are learned by skip-gram from a bounded sample of rows, about
    ``sample_rows`` drawn by a hash of the id; words under ``least`` occurrences have none.
    Null and empty texts, and such without a known word, give the zero vector.
    """

    def __init__(self, texts: DataFrame, dim: int = 64, sample_rows: int = 20_000, least: int = 5, seed: int = 1) -> None:
        share = min(1.0, sample_rows / max(1, texts.count()))
        sample = texts.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20))
        words = sample.select(F.coalesce(text.tokens(F.lower("content")), F.array().cast("array<string>")).alias("words"))
        self.model = Word2Vec(vectorSize=dim, minCount=least, seed=seed, maxIter=1, numPartitions=8, inputCol="words", outputCol="vector").fit(words)

    def embed(self, rows: DataFrame, content: str = "content", name: str = "embedding") -> DataFrame:
        words = rows.withColumn("words", F.coalesce(text.tokens(F.lower(content)), F.array().cast("array<string>")))
        mean = self.model.transform(words).withColumn(name, vector_to_array("vector")).drop("words", "vector")
        length = vectors.norm(F.col(name))
        return mean.withColumn(name, F.when(length > 0, F.transform(name, lambda x: x / length)).otherwise(F.col(name)))


def embed(rows: DataFrame, model=hashing_model, batch: int = 32, content: str = "content", name: str = "embedding") -> DataFrame:
    """Adds a vector column by a model function (list of texts -> list of vectors), made once
    per worker by calling ``model()`` and given texts in batches; a null text counts as empty."""

    @F.arrow_udf("array<double>")
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = model()
        for values in batches.pieces_of(arrays):
            texts = [v or "" for v in values]
            yield pa.array([list(map(float, v)) for i in range(0, len(texts), batch) for v in encode(texts[i : i + batch])], pa.list_(pa.float64()))

    return rows.withColumn(name, run(F.col(content)))


def embed_query(queries: DataFrame, model=hashing_model) -> DataFrame:
    """A batch of queries (qid, query) with ``qvec`` by the model that embeds documents."""
    return embed(queries, model, content="query", name="qvec")
