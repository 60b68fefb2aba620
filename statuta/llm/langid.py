"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams per language in Spark; the log-probability matrix
(buckets x languages: it grows with the label set, never with the rows) is broadcast.
Workers lay the texts of a batch end to end; their n-grams' buckets, with the document
each belongs to, are a sparse matrix of counts whose product with the log-probability
matrix gives the scores of the whole batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_PLAIN_LETTER = re.compile("[A-Za-z]")


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 14
    orders: tuple[int, ...] = (2, 3)
    smoothing: float = 0.5
    #: About so many labelled rows of each language are learned from.
    rows_per_language: int = 3000


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: buckets x languages; empty when nothing could be learned.
    log_prob: np.ndarray
    #: Logs of the languages' shares of the rows learned from (before they are sampled).
    prior: np.ndarray
    params: Params


def has_letter(text: str) -> bool:
    return _PLAIN_LETTER.search(text) is not None or any(map(str.isalpha, text))


def sparse_counts(texts: list[str], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of whole texts; an entry that occurs twice counts twice."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
    rows, buckets = [], []
    for n in p.orders:
        end = len(points) - n + 1
        if end > 0:
            h = np.full(end, n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ points[k : end + k]) * np.uint64(0x9E3779B97F4A7C15)
            inside = row[:end] == row[n - 1 :]
            rows.append(row[:end][inside])
            buckets.append(((h >> np.uint64(40)).astype(np.int64) & (p.buckets - 1))[inside])
    return (np.concatenate(rows), np.concatenate(buckets)) if rows else (np.empty(0, np.int32), np.empty(0, np.int64))


def fit(documents: DataFrame, p: Params = Params()) -> Model:
    """Learns from text and non-null lang of the rows that are not held out.

    The rows are a sample bounded by ``rows_per_language`` in expectation, drawn
    by a hash of the id.  Counts are summed in Spark; the driver receives at most
    buckets x languages sums.  The prior is learned from all such rows.
    """
    rows = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out("doc_id")).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.empty((p.buckets, 0)), np.empty(0), p)
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, p.rows_per_language / n)))
    rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.bincount(sparse_counts([text], p)[1], minlength=p.buckets)
                sums[lang] = sums[lang] + own if lang in sums else own
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), type=pa.string()), pa.array(at), pa.array(own[at])], names=["lang", "bucket", "n"])

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    matrix = np.full((p.buckets, len(languages)), p.smoothing)
    place = {lang: i for i, lang in enumerate(languages)}
    matrix[counted["bucket"].to_numpy(dtype=np.int64), counted["lang"].map(place).to_numpy(dtype=np.int64)] += counted["n"].to_numpy(dtype=np.float64)
    return Model(languages, np.log(matrix / matrix.sum(axis=0)), np.log(np.array([sizes[x] for x in languages]) / sum(sizes.values())), p)


def predict_texts(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability; ``und`` and 0 without a letter or a model."""
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    asked = [i for i, t in enumerate(texts) if t is not None and model.languages and has_letter(t)]
    for lo, hi in common.runs([texts[i] for i in asked], 1 << 18):
        own = asked[lo:hi]
        row, bucket = sparse_counts([texts[i] for i in own], model.params)
        like = np.stack([np.bincount(row, weights=column[bucket], minlength=len(own)) for column in model.log_prob.T], axis=1) + model.prior
        best = np.argmax(like, axis=1)
        scores[own] = 1 / np.exp(like - like.max(axis=1, keepdims=True)).sum(axis=1)
        for i, k in zip(own, best.tolist(), strict=True):
            langs[i] = model.languages[k]
    return langs, scores


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out boolean, lang_pred string, score double (0 to 1).

    Null texts and texts without a letter are ``und`` with score 0.  Ties go to
    the language that sorts first.  Repeated rows give repeated results; an
    empty table gives none; only doc_id and text are looked at.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small(batches, 2):
            langs, scores = predict_texts(batch.column(2).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, type=pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_told(documents: DataFrame, model: Model, least_score: float) -> DataFrame:
    """The rows, all columns, whose language is told with at least this probability.

    A filter in place: nothing is shuffled, and rows with a null doc_id are judged
    like any other.
    """
    place = documents.columns.index("text")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small(batches, place):
            langs, scores = predict_texts(batch.column(place).to_pylist(), shared.value)
            yield batch.filter(pa.array([lang != "und" and s >= least_score for lang, s in zip(langs, scores.tolist(), strict=True)], type=pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
