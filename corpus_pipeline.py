"""A corpus-cleaning pipeline over ``documents``: each stage rereads what its predecessor wrote.

Every stage takes and (but for the last) returns all columns it is given, whatever else they
are named; an empty table goes through as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from statuta.llm import common, decontam, langid, neardup, pieces, pii

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document goes if no language can be told, or its probability is below this.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told; one without a letter (null and empty texts
    too), or torn between languages, goes.  Rows are judged by their text alone."""
    return langid.keep_told(docs, langid.fit(docs), LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the least id, of each group of near copies.

    Rows without an id are nobody's copy and stay, as do empty texts.  Different texts under
    one id are documents of their own; repeated rows stay or go together.
    """
    return neardup.without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; each row is judged by its own text, null and empty ones stay."""
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; n_chars follows the text, all rows stay, null texts as they are."""
    return pii.masked(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as piece ids, with the N-best scores; a row for each row, nulls for a null text."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("language id", language),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("sentencepiece", encoding),
]

#: Language models, signatures and lattices have no SQL form; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir))
        if before is not None:
            common.discard(before)
        before = docs
    return docs
