"""Search arms, fusion and re-ranking over batches of queries.

Query batches are small tables of (qid long, query string [, qvec]).  A batch within a
checked bound is held as a local table and broadcast; a larger one is worked off in parts
of that bound where no key joins it.  Contents and vectors stay out of every stage that
ranks, and contents are fetched for what is left of each query's candidates.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from .batch import BROADCAST_QUERIES, TEXT_QUERIES, by_parts, held
from .corpus import scratch_folder
from .postings import PostingIndex
from .substring import CANDIDATES, TrigramIndex, scan

DIGITS = 9


def valid_queries(queries: DataFrame) -> DataFrame:
    return queries.filter(F.length(F.trim("query")) > 0)


def rejected_queries(queries: DataFrame) -> DataFrame:
    return queries.filter(F.coalesce(F.length(F.trim("query")) == 0, F.lit(True)))


def ranked(rows: DataFrame, score: str, k: int, rank: str = "rank", descending: bool = True) -> DataFrame:
    """The k best of each query by the rounded score, ties by id, with their rank."""
    rounded = F.round(score, DIGITS)
    order = rounded.desc_nulls_last() if descending else rounded.asc_nulls_last()
    w = Window.partitionBy("qid").orderBy(order, "id")
    return rows.withColumn(rank, F.row_number().over(w).cast("long")).filter(F.col(rank) <= k)


def keyword_hits(corpus: DataFrame, queries: DataFrame, factor: float = 1.0, index: TrigramIndex | None = None, k: int | None = None) -> DataFrame:
    """(qid, id, score) of documents that contain a query's text literally; with k, those beyond a query's k best may be missing.

    The batch is one automaton, so each text is read once; with an index, only the texts that
    hold a selective query's rarest trigrams are.
    """
    asked = valid_queries(queries).select("qid", "query")
    k = k if factor >= 1e-6 else None  # smaller factors may round different counts to one score
    found = scan(corpus, asked, k) if index is None else index.hits(corpus, asked, k=k)
    asked, few = held(asked)
    return found.join(asked, "query").select("qid", "id", (F.col("n").cast("double") * factor).alias("score"))


def keyword_search(corpus: DataFrame, queries: DataFrame, k: int = 100, factor: float = 1.0, index: TrigramIndex | None = None) -> DataFrame:
    return ranked(keyword_hits(corpus, queries, factor, index, k), "score", k)


def _rows_by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length, those with a null or non-finite component left out."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.diff(column.offsets.to_numpy())
    sizes[~column.is_valid().to_numpy(zero_copy_only=False)] = 0
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        rows = flat[starts[at][:, None] + np.arange(n)]
        good = np.isfinite(rows).all(axis=1)
        if good.any():
            yield at[good], rows[good]


def nearest(batches: Iterator[pa.RecordBatch], queries: pa.Table, k: int, metric: str = "cosine", of_cell: dict[int, list[int]] | None = None) -> Iterator[pa.RecordBatch]:
    """The k best of each query among a task's rows (id, embedding), as (qid, id, similarity).

    With ``of_cell`` the rows are (id, embedding, cell), and the queries at the places given there for a cell are held against its rows alone.
    """
    qids, wanted = queries["qid"].to_numpy(), list(_rows_by_length(queries["qvec"].combine_chunks()))
    best = {i: (np.empty(0), np.empty(0, dtype=object)) for i in range(len(qids))}
    for batch, chosen in _by_cell(batches, wanted, of_cell):
        ids = np.array(batch.column(0).to_pylist(), dtype=object)
        for at, rows in _rows_by_length(batch.column(1)):
            for q_at, q in chosen:
                if q.shape[1] != rows.shape[1]:
                    continue
                for lo in range(0, len(q_at), 256):
                    part = q[lo : lo + 256]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        if metric == "cosine":
                            value = part @ rows.T / (np.linalg.norm(part, axis=1)[:, None] * np.linalg.norm(rows, axis=1))
                        else:
                            value = 1 - ((part**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1) - 2 * part @ rows.T)
                    value[~np.isfinite(value)] = -np.inf  # a zero vector has no cosine
                    order = np.round(value, DIGITS)
                    bound = np.partition(order, max(0, len(rows) - k), axis=1)[:, max(0, len(rows) - k)]
                    for i, row, keep in zip(q_at[lo : lo + 256].tolist(), value, (order >= bound[:, None]) & (order > -np.inf), strict=True):
                        some = np.flatnonzero(keep)
                        scores, names = np.concatenate([best[i][0], row[some]]), np.concatenate([best[i][1], ids[at[some]]])
                        chosen = sorted(range(len(scores)), key=lambda j: (-round(scores[j], DIGITS), names[j]))[:k] if len(scores) > k else slice(None)
                        best[i] = scores[chosen], names[chosen]
    own = np.repeat(qids, [len(best[i][0]) for i in range(len(qids))])
    values = np.concatenate([best[i][0] for i in range(len(qids))]) if best else np.empty(0)
    names = np.concatenate([best[i][1] for i in range(len(qids))]) if best else np.empty(0, dtype=object)
    yield pa.RecordBatch.from_arrays([pa.array(own, type=pa.int64()), pa.array(names.tolist(), type=pa.string()), pa.array(values, type=pa.float64())], names=["qid", "id", "similarity"])


_Matrices = list[tuple[np.ndarray, np.ndarray]]


def _by_cell(batches: Iterator[pa.RecordBatch], wanted: _Matrices, of_cell: dict[int, list[int]] | None) -> Iterator[tuple[pa.RecordBatch, _Matrices]]:
    """Rows with the queries that are held against them."""
    for batch in batches:
        if of_cell is None:
            yield batch, wanted
            continue
        cells = batch.column(2).to_numpy()
        for cell in np.unique(cells).tolist():
            on = [np.isin(at, of_cell.get(cell, [])) for at, _ in wanted]
            chosen = [(at[m], q[m]) for m, (at, q) in zip(on, wanted, strict=True) if m.any()]
            if chosen:
                yield batch.filter(pa.array(cells == cell)), chosen


def vector_search(corpus: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """(qid, id, similarity, rank): exact search over (id, embedding).

    Each task multiplies its vectors with the broadcast queries' and keeps k a query, so
    only those are shuffled.  Null vectors, such with a null or non-finite component, of
    another length than the query's, or (for cosine) of norm zero take no part.
    """
    rows = corpus.filter("embedding IS NOT NULL").select(F.col("id").cast("string").alias("id"), "embedding")

    def of_part(part: DataFrame) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(part.toArrow())
        return ranked(rows.mapInArrow(lambda batches: nearest(batches, shared.value, k, metric), "qid long, id string, similarity double"), "similarity", k)

    return by_parts(queries.select("qid", "qvec"), of_part)


def all_similarities(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, similarity): the cosine of every query with every row (id, embedding), null where there is none.

    Every pair is a row of the result, so it grows as queries times rows; tasks multiply slices of their vectors
    with the broadcast queries' and give the pairs out at once: none is held or shuffled.
    """
    rows = corpus.filter("embedding IS NOT NULL").select(F.col("id").cast("string").alias("id"), "embedding")

    def of_part(part: DataFrame) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(part.toArrow())
        return rows.mapInArrow(lambda batches: _all_pairs(batches, shared.value), "qid long, id string, similarity double")

    return by_parts(queries.select("qid", "qvec"), of_part)


def _all_pairs(batches: Iterator[pa.RecordBatch], queries: pa.Table, most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """(qid, id, similarity) of each row of (id, embedding) with each query, about ``most`` pairs at a time."""
    qids = queries["qid"].to_numpy()
    wanted = list(_rows_by_length(queries["qvec"].combine_chunks())) if len(qids) else []
    step = max(1, most // max(1, len(qids)))
    for batch in batches:
        for lo in range(0, batch.num_rows if len(qids) else 0, step):
            own = batch.slice(lo, step)
            value = np.full((own.num_rows, len(qids)), np.nan)
            for at, rows in _rows_by_length(own.column(1)):
                for q_at, q in wanted:
                    if q.shape[1] == rows.shape[1]:
                        with np.errstate(divide="ignore", invalid="ignore"):
                            value[np.ix_(at, q_at)] = rows @ q.T / (np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(q, axis=1))
            similarity = pa.array(value.ravel(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(qids, own.num_rows), pa.int64()), own.column(0).take(pa.array(np.repeat(np.arange(own.num_rows), len(qids)))), similarity], names=["qid", "id", "similarity"])


def term_statistics(corpus: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """(term, df, n, avgdl, idf) of a corpus (id, content) without an index, in one pass over the texts.

    A negative idf is replaced by ``epsilon`` times the mean over all terms, negative ones included.
    """
    spark, folder = corpus.sparkSession, scratch_folder(corpus.sparkSession)
    words = corpus.select(F.coalesce(text.tokens(F.col("content")), F.array().cast("array<string>")).alias("words"))
    # Each document counts once under each of its terms and once, with its length, under null.
    seen = words.select(F.size("words").cast("long").alias("dl"), F.explode(F.array_append(F.array_distinct("words"), F.lit(None).cast("string"))).alias("term"))
    seen.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("length")).write.parquet(folder)
    counted = spark.read.parquet(folder)
    n, length = counted.filter("term IS NULL").select("df", "length").first() or (0, 0)
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = counted.filter("term IS NOT NULL").select("term", "df", raw.alias("raw"))
    mean = terms.agg(F.avg("raw")).first()[0] or 0.0
    return terms.select("term", "df", F.lit(n).cast("long").alias("n"), F.lit(length / n if n else 0.0).alias("avgdl"), F.when(F.col("raw") < 0, epsilon * mean).otherwise(F.col("raw")).alias("idf"))


class Bm25Index:
    """BM25 over a saved posting index: ``build`` it once from a corpus (id, content), ``load`` it, search any number of batches."""

    def __init__(self, index: PostingIndex) -> None:
        self.index = index

    @classmethod
    def build(cls, corpus: DataFrame, path: str | None = None, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> Bm25Index:
        """Without a path the index lies in a fresh folder of the shared store."""
        return cls(PostingIndex.build(corpus, path or scratch_folder(corpus.sparkSession), text.tokens, k1=k1, b=b, epsilon=epsilon))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bm25Index:
        return cls(PostingIndex(spark, path))

    @staticmethod
    def _words(queries: DataFrame) -> DataFrame:
        """(qid, term, times): every query token counts, repeats too."""
        return valid_queries(queries).select("qid", F.explode(text.tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))

    def matches(self, queries: DataFrame) -> DataFrame:
        """(qid, id, term, times, tf, dl, idf, avgdl) of every posting of a query's term."""
        return by_parts(queries.select("qid", "query"), self._matches, TEXT_QUERIES)

    def _matches(self, part: DataFrame) -> DataFrame:
        words = self._words(part)
        asked = self.index.known(words).join(F.broadcast(words), "term").groupBy("term", "idf").agg(F.collect_list(F.struct("qid", "times")).alias("asked"))
        local = asked.toArrow()
        # A slice of a term's documents meets the term's queries once, not each of its documents.
        asked = F.broadcast(part.sparkSession.createDataFrame(local, asked.schema))
        found = self.index.sliced(dict(zip(local["term"].to_pylist(), pc.list_value_length(local["asked"]).to_pylist(), strict=True)))
        rows = found.join(asked, "term").select("term", "idf", "asked", F.inline("documents").alias("id", "tf", "dl"))
        rows = rows.select("id", "term", "tf", "dl", "idf", F.inline("asked").alias("qid", "times"))
        return rows.select("qid", "id", "term", "times", "tf", "dl", "idf", F.lit(self.index.facts.avgdl).alias("avgdl"))

    def scores(self, queries: DataFrame, within: DataFrame | None = None, k: int | None = None, digits: int | None = None) -> DataFrame:
        """(qid, id, score) of all matches, or those of the ids in ``within``, rounded if ``digits`` are given, or of each task's documents the k best; statistics stay those of the whole corpus."""
        return by_parts(queries.select("qid", "query"), lambda part: self.index.top(self._words(part), k, within, False, digits), TEXT_QUERIES)

    def search(self, queries: DataFrame, k: int, within: DataFrame | None = None) -> DataFrame:
        """The k best with scores above 0, of all documents or of the ids in ``within``: by block maxima, without scoring all matches."""
        return by_parts(queries.select("qid", "query"), lambda part: ranked(self.index.top(self._words(part), k, within), "score", k), TEXT_QUERIES)


def text_index(corpus: DataFrame, path: str | None = None) -> PostingIndex:
    """A saved index of lexemes with their places, for ``text_rank``."""
    return PostingIndex.build(corpus, path or scratch_folder(corpus.sparkSession), text.lexemes, places=True)


def text_rank(corpus: DataFrame, queries: DataFrame, index: PostingIndex | None = None, k: int | None = None, digits: int | None = None) -> DataFrame:
    """(qid, id, score) of full-text search: documents with all lexemes of the query, scores rounded if ``digits`` are given; with an index and k, of each task's documents the k best.

    One lexeme: 0.1 * sum of 1/j^2 over its n occurrences, over pi^2/6.  Several:
    one minus the product over pairs of positions of distinct lexemes, at most 100
    apart, of 1 - 0.1 sqrt(1 / (1.005 + 0.05 e^(d/1.5 - 2))).

    With an index, only the postings of the queries' lexemes are read, and scored shard by shard.
    Without one the corpus is split into words once; a document's places of a query's words are one
    row.  No more than 100 places follow within 100 words, so there each place is held against the next 100.
    """
    if index is not None:
        lex = F.array_distinct(text.lexemes(F.col("query"))).alias("lex")
        return by_parts(valid_queries(queries).select("qid", "query"), lambda part: index.ranked_by_places(part.select("qid", lex).filter(F.size("lex") > 0), k, digits), TEXT_QUERIES)
    queries, few = held(valid_queries(queries).select("qid", "query"))
    q = queries.select("qid", F.array_distinct(text.lexemes(F.col("query"))).alias("lex")).filter(F.size("lex") > 0)
    wanted = q.select("qid", F.size("lex").alias("need"), F.posexplode("lex").alias("nth", "term"))
    mark = F.broadcast if few else (lambda df: df)
    words = corpus.select("id", F.posexplode_outer(text.lexemes(F.col("content"))).alias("at", "term"))
    hits = words.join(mark(wanted), "term")
    found = hits.groupBy("qid", "id", "need").agg(F.sort_array(F.collect_list(F.struct("at", "nth"))).alias("places"))
    found = found.filter(F.size(F.array_distinct(F.transform("places", lambda p: p["nth"]))) == F.col("need"))
    harmonic = F.aggregate(F.sequence(F.lit(1), F.size("places")), F.lit(0.0), lambda acc, j: acc + 1.0 / (j * j))
    joint = _proximity(F.col("places.at"), F.col("places.nth"))
    score = F.when(F.col("need") == 1, 0.1 * harmonic / 1.64493406685).otherwise(joint)
    return found.select("qid", "id", (score if digits is None else F.round(score, digits)).alias("score"))


def _proximity(at: Column, nth: Column) -> Column:
    """The score of several lexemes' places, in order (an Arrow function: of each place and
    its next 100, by whole arrays, which higher-order functions only do one by one)."""

    @F.pandas_udf("double")
    def joint(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        part = np.log(1 - 0.1 * np.sqrt(1 / (1.005 + 0.05 * np.exp(np.arange(101) / 1.5 - 2))))
        for places, words in batches:
            out = np.empty(len(places))
            for i, (a, w) in enumerate(zip(places, words, strict=True)):
                total = 0.0
                for k in range(1, min(101, len(a))):
                    d = a[k:] - a[:-k]
                    if d.min() > 100:
                        break
                    total += part[d[(d <= 100) & (w[k:] != w[:-k])]].sum()
                out[i] = 1 - np.exp(total)
            yield pd.Series(out)

    return joint(at, nth)


def fuse_by_sum(vector_arm: DataFrame, keyword_arm: DataFrame, k: int = 60, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """(qid, id, fused, vector_rank, keyword_rank): weighted reciprocal ranks; an absent arm adds nothing."""
    v = vector_arm.select("qid", "id", (weights[0] / (k + F.col("rank"))).alias("part"), F.col("rank").alias("vector_rank"), F.lit(None).cast("long").alias("keyword_rank"))
    t = keyword_arm.select("qid", "id", (weights[1] / (k + F.col("rank"))).alias("part"), F.lit(None).cast("long").alias("vector_rank"), F.col("rank").alias("keyword_rank"))
    return v.unionByName(t).groupBy("qid", "id").agg(F.sum("part").alias("fused"), F.max("vector_rank").alias("vector_rank"), F.max("keyword_rank").alias("keyword_rank"))


def fuse_full_outer(semantic: DataFrame, keyword: DataFrame, k: int = 60, weights: tuple[float, float] = (0.7, 0.3), absent: int = 999_999) -> DataFrame:
    """(qid, id, relevance, semantic_rank, keyword_rank): ranks times 100; an absent arm ranks ``absent``."""
    s = semantic.select("qid", "id", F.col("rank").alias("semantic_rank"))
    t = keyword.select("qid", "id", F.col("rank").alias("keyword_rank"))
    rank = lambda c: k + F.coalesce(c, F.lit(absent))
    value = 100 * (weights[0] / rank(F.col("semantic_rank")) + weights[1] / rank(F.col("keyword_rank")))
    return s.join(t, ["qid", "id"], "full_outer").select("qid", "id", "semantic_rank", "keyword_rank", value.alias("relevance"))


def rule_boost(query: Column, title: Column, kind: Column, definition: Column, boosts: Mapping[str, float]) -> Column:
    """10 if a query word is in the title, the kind's boost, 3 for a definition."""
    in_title = F.exists(text.tokens(query), lambda w: F.contains(title, w))
    by_kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in boosts.items() for x in (kv[0], float(kv[1])))), kind), F.lit(0.0))
    return F.when(F.coalesce(in_title, F.lit(False)), 10.0).otherwise(0.0) + by_kind + F.when(definition, 3.0).otherwise(0.0)


def rerank(fused: DataFrame, corpus: DataFrame, queries: DataFrame, boosts: Mapping[str, float], flags: DataFrame | None = None) -> DataFrame:
    """Adds the corpus's other columns and final (fused plus boosts), and orders by it, then by fused, then id.

    ``fused`` holds a few candidates a query: it is broadcast to the corpus if it has no more than
    ``CANDIDATES`` rows, so the corpus is read once and not shuffled.  Where
    is_definition is in a table of its own (id, is_definition), that is ``flags``.
    """
    queries, few = held(queries.select("qid", "query"))
    mark = F.broadcast if few else (lambda df: df)
    fused, small = held(fused, CANDIDATES)
    rows = corpus.join(fused, "id")
    if flags is not None:
        ids = fused.select("id").distinct()
        own = flags.join(F.broadcast(ids) if small else ids, "id")
        rows = rows.join(own, "id", "left").withColumn("is_definition", F.coalesce("is_definition", F.lit(False)))
    final = F.col("fused") + rule_boost(F.col("query"), F.col("title"), F.col("chunk_type"), F.col("is_definition"), boosts)
    w = Window.partitionBy("qid").orderBy(F.round("final", DIGITS).desc(), F.round("fused", DIGITS).desc(), "id")
    return rows.join(mark(queries), "qid").withColumn("final", final).withColumn("rank", F.row_number().over(w).cast("long"))


def hybrid_search(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    boosts: Mapping[str, float],
    index: Bm25Index | None = None,
    vectors: DataFrame | None = None,
    flags: DataFrame | None = None,
    where: Column | None = None,
    filter_scope: str = "both",
    cut: int | None = None,
) -> DataFrame:
    """Vector and BM25 arms of 2k each, fused by sum, re-ranked by rules, cut to k, contents highlighted.

    The corpus has id, content, law_name, title, chunk_type, and is_definition and embedding
    unless ``flags`` and ``vectors`` (id, embedding) hold them.  ``where`` is a condition on the
    corpus for both arms, or (``filter_scope`` "vector") for the vector arm alone; BM25's
    statistics are the index's in any case.  ``cut`` keeps another number than k of the
    up to 4k candidates.  Without an index one is built for this batch alone; give a saved one.
    """
    if filter_scope not in ("both", "vector"):
        raise ValueError("filter_scope is 'both' or 'vector'")
    queries, _ = held(queries.select("qid", "query", "qvec"))
    index = index or Bm25Index.build(corpus)
    allowed = None if where is None else corpus.filter(where)
    if vectors is None:
        rows = corpus if allowed is None else allowed
    else:
        rows = vectors if allowed is None else vectors.join(allowed.select("id"), "id", "left_semi")
    fused = fuse_by_sum(vector_search(rows, queries, 2 * k), index.search(queries, 2 * k, allowed if filter_scope == "both" else None))
    payload = corpus.select("id", "content", "law_name", "title", "chunk_type", *([] if flags is not None else ["is_definition"]))
    best = rerank(fused, payload.drop("content"), queries, boosts, flags).filter(F.col("rank") <= (cut or k))
    best = _fetched(payload.select("id", "content"), best)
    return best.withColumn("highlighted", text.highlight(F.col("content"), text.keywords_by_space(F.col("query"))))


def hybrid_search_sql(corpus: DataFrame, queries: DataFrame, k: int, vectors: DataFrame | None = None, index: PostingIndex | None = None) -> DataFrame:
    """Cosine and full-text arms of 2k each, full outer join, cut to k."""
    queries, _ = held(queries.select("qid", "query", "qvec"))
    fused = fuse_full_outer(vector_search(corpus if vectors is None else vectors, queries, 2 * k), ranked(text_rank(corpus, queries, index, 2 * k), "score", 2 * k))
    return ranked(fused, "relevance", k)


def with_share(hits: DataFrame) -> DataFrame:
    """Adds each query's greatest score (0.0001 at least) and the score as percent of it."""
    most = F.greatest(F.max("score").over(Window.partitionBy("qid")), F.lit(1e-4))
    return hits.withColumn("max_score", most).withColumn("share", 100 * F.col("score") / F.col("max_score"))


#: Fixed values of the response: the law named where a document has none, and the marks' style.
DEFAULT_LAW = "수소경제육성및수소안전관리에관한법률"
MARK_STYLE = "background-color: #fef08a; padding: 2px 4px; border-radius: 2px;"


def _fetched(corpus: DataFrame, hits: DataFrame) -> DataFrame:
    """The corpus's rows of hits (id, ...): hits are broadcast if they are no more than ``CANDIDATES``."""
    hits, _ = held(hits, CANDIDATES)
    return corpus.join(hits, "id")


def web_search(corpus: DataFrame, queries: DataFrame, k: int = 100, index: TrigramIndex | None = None, default_law: str = DEFAULT_LAW, style: str = MARK_STYLE) -> DataFrame:
    """Keyword search with the fields of a response, a row for each hit: qid, query, rank, id, law_name,
    article_number, title, content, highlighted_content, relevance_score, article_type, score, keywords.

    Missing or empty values have defaults: the number is the id's part after the first underscore.
    Scores are percent of the query's best.  Marks ignore case and keep the text as it is written.
    ``corpus`` has id, content, law_name, title, chunk_type and, if it likes, article_number.
    """
    hits = with_share(keyword_search(corpus, queries, k, index=index))
    named, _ = held(queries.select("qid", "query"))
    number = F.get(F.split("id", "_"), F.lit(1))
    if "article_number" in corpus.columns:
        number = F.coalesce(F.nullif("article_number", F.lit("")), number)
    rows = corpus.select("id", "content", "law_name", "title", "chunk_type", number.alias("article_number"))
    rows = _fetched(rows, hits).join(named, "qid")
    filled = lambda name, default: F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default)).alias(name if name != "chunk_type" else "article_type")
    marked = text.normalized_newlines(text.highlight_ignoring_case(F.col("content"), text.keywords_by_comma(F.col("query")), style))
    return rows.select(
        "qid", "query", "rank", "id", filled("law_name", default_law), "article_number", filled("title", ""), "content", marked.alias("highlighted_content"),
        F.col("share").alias("relevance_score"), filled("chunk_type", "article"), "score", text.keywords_by_space(F.col("query")).alias("keywords"),
    )


#: The fields of an article in a response.
ARTICLE_FIELDS = ("rank", "id", "law_name", "article_number", "title", "content", "highlighted_content", "relevance_score", "article_type", "related_articles")


def responses(hits: DataFrame, method: str = "keyword", related: DataFrame | None = None, weights: tuple[float, float] | None = None) -> DataFrame:
    """One row per query: qid, query, total_found, keywords, relevant_laws (in order of their first hit, none
    empty), articles (``ARTICLE_FIELDS``, by rank) and metadata.

    ``hits`` is the result of ``web_search``, or has its columns; ``related`` (id, related_articles array of
    strings) are a hit's related articles, an empty array where it has none.
    """
    none = F.array().cast("array<string>")
    rows = hits.withColumn("related_articles", none) if related is None else hits.join(related, "id", "left").withColumn("related_articles", F.coalesce("related_articles", none))
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ARTICLE_FIELDS if c not in rows.columns})
    grouped = rows.groupBy("qid").agg(F.first("query").alias("query"), F.first("keywords").alias("keywords"), F.count("*").alias("total_found"), F.sort_array(F.collect_list(F.struct(*ARTICLE_FIELDS))).alias("articles"))
    laws = F.array_distinct(F.filter(F.transform("articles", lambda a: a["law_name"]), lambda name: F.coalesce(name != "", F.lit(False))))
    v, b = weights or (None, None)
    facts = F.struct(F.lit(False).alias("llm_used"), F.lit(method).alias("search_method"), F.lit(v).cast("double").alias("vector_weight"), F.lit(b).cast("double").alias("bm25_weight"))
    return grouped.select("qid", "query", "total_found", "keywords", laws.alias("relevant_laws"), "articles", facts.alias("metadata"))


def hybrid_responses(best: DataFrame, related: DataFrame | None = None, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """``responses`` of a ``hybrid_search``: the score is the final one, the number the id's part after the first underscore."""
    rows = best.withColumnsRenamed({"highlighted": "highlighted_content", "final": "relevance_score", "chunk_type": "article_type"})
    if "article_number" not in rows.columns:
        rows = rows.withColumn("article_number", F.get(F.split("id", "_"), F.lit(1)))
    return responses(rows.withColumn("keywords", text.keywords_by_space(F.col("query"))), "hybrid", related, weights)


def query_plan(queries: DataFrame, column: str = "query") -> DataFrame:
    """Adds what is read out of each query: words, legal_terms and article_refs; a null query has none of them."""
    q = F.coalesce(F.col(column), F.lit(""))
    return queries.withColumns({"words": text.tokens(q), "legal_terms": text.legal_terms(q), "article_refs": text.article_refs(q)})


def evaluate(corpus: DataFrame, expected: DataFrame, k: int = 20, top: int = 3) -> DataFrame:
    """expected(qid, query, expected_min) with found, passed, by_law and by_tier (arrays of name and n, by
    name) and the ids of the first ``top`` hits; k hits a query at most."""
    hits = keyword_search(corpus, expected, k)
    rows = _fetched(corpus.select("id", F.coalesce("law_name", F.lit("Unknown")).alias("law_name")), hits.select("id", "qid", "rank")).withColumn("tier", text.tier(F.col("law_name")))
    total = rows.groupBy("qid").agg(F.count("*").alias("found"), F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "id")))), lambda x: x["id"]).alias("top_hits"))
    out = expected.join(total, "qid", "left").withColumns({"found": F.coalesce("found", F.lit(0)).cast("long"), "top_hits": F.coalesce("top_hits", F.array().cast("array<string>"))})
    for name, column in (("by_law", "law_name"), ("by_tier", "tier")):
        counts = rows.groupBy("qid", F.col(column).alias("name")).agg(F.count("*").alias("n")).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("name", "n"))).alias(name))
        out = out.join(counts, "qid", "left").withColumn(name, F.coalesce(name, F.array().cast("array<struct<name:string,n:bigint>>")))
    return out.withColumn("passed", F.col("found") >= F.col("expected_min"))


def verdict(evaluated: DataFrame) -> DataFrame:
    rows = evaluated.agg(F.count_if("passed").alias("n_passed"), F.count("*").alias("n")).withColumn("rate", F.try_divide("n_passed", "n"))
    return rows.withColumn("verdict", F.when(F.col("rate") == 1, "pass").when(F.col("rate") >= 0.75, "warn").otherwise("fail"))
