"""Incremental ingestion of statute files as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import corpus, segment

_LAWS = "law_id string, text string, version long"
_NO_VERSION = -(1 << 63)


def chunked(laws: DataFrame) -> DataFrame:
    """Chunks of (law_id, text, version), keyed by chunk id, the law's version kept.

    A law without any article gives one row of type "empty", so that its version is known
    and takes the place of older ones.
    """
    versions = corpus.latest(laws, "law_id", "version")
    arts = segment.articles(versions).withColumn("paragraphs", F.lit(None).cast("array<struct<number:string,content:string>>"))
    chunks = segment.chunks(arts).withColumnRenamed("chunk_id", "id")
    rows = versions.select("law_id", "version").join(chunks, "law_id", "left")
    return rows.withColumn("chunk_type", F.coalesce("chunk_type", F.lit("empty"))).withColumn("id", F.coalesce("id", F.concat("law_id", F.lit("_empty"))))


def newest_only(laws: DataFrame) -> DataFrame:
    """Of a stream (law_id, text, version) the rows that are newer than all before of their law.

    The state holds a law's newest version.  Of a batch's rows of one law the newest goes on (of equal
    ones that of the greatest text), if it is newer than the state; late and repeated ones end here,
    before anything is merged.  A null version is before all others.
    """

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best: tuple[int, str] | None = None
        for rows in batches:
            for version, text in zip(rows["version"].tolist(), rows["text"].fillna("").tolist(), strict=True):
                best = max(best, (version, text)) if best else (version, text)
        if best and (not state.exists or best[0] > state.get[0]):
            state.update((best[0],))
            yield pd.DataFrame({"law_id": [key[0]], "text": [best[1]], "version": [best[0]]})

    known = laws.select("law_id", "text", F.coalesce("version", F.lit(_NO_VERSION)).cast("long").alias("version"))
    kept = known.groupBy("law_id").applyInPandasWithState(keep, _LAWS, "newest long", "append", GroupStateTimeout.NoTimeout)
    return kept.withColumn("version", F.nullif("version", F.lit(_NO_VERSION)))


def incremental_ingest(spark: SparkSession, source: str, root: str, checkpoint: str, parts: int = 64) -> DataFrame | None:
    """Takes up files that have arrived under ``source`` since the last call, and upserts
    their chunks into the table under ``root``.

    The checkpoint picks up each file once and keeps each law's newest version, so late versions
    are dropped before any merge; the upsert makes a replayed batch harmless.  Of each law only the
    newest version's chunks stay, whatever order versions arrive in, and only the parts of the
    table that hold laws of the batch are rewritten.  Returns the table's rows (see ``current_rows``).
    Table and state have ``parts`` parts, or more if the first files are large.
    """

    def merge(batch: DataFrame, _: int) -> None:
        with corpus.staged(batch, root) as laws:  # read several times below, and the state must change but once
            _upserted(batch.sparkSession, laws, root, parts)

    parts = corpus.parts_of(spark, source, parts)
    stream = newest_only(spark.readStream.schema(_LAWS).parquet(source))
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(parts))  # the state is dealt as the table is; a checkpoint keeps its number
    try:
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return current_rows(spark, root)


def full_refresh(spark: SparkSession, full: DataFrame, root: str, as_of: int | None = None, parts: int = 64) -> DataFrame | None:
    """Reconciles the table under ``root`` with a full drop (law_id, text, version) of what is in force.

    Its laws are upserted; laws it lacks, and that have no version of ``as_of`` (by default one above the
    drop's newest) or later, are marked as gone from that version on: their chunks leave the table, and
    only a newer version brings them back.  Repeating a refresh changes nothing.  An empty drop is refused.
    """
    newest = full.agg(F.max("version")).first()[0]
    if newest is None:
        raise ValueError("a full drop without a version would empty the table")
    as_of = newest + 1 if as_of is None else as_of
    table = corpus.current_table(spark, root)
    laws = full.select("law_id", "text", "version")
    if table is not None:
        old = table.groupBy("law_id").agg(F.max("version").alias("version")).filter(F.coalesce(F.col("version") < as_of, F.lit(True)))
        gone = old.join(full.select("law_id").distinct(), "law_id", "left_anti")
        laws = laws.unionByName(gone.select("law_id", F.lit("").alias("text"), F.lit(as_of).cast("long").alias("version")))
    with corpus.staged(laws, root) as rows:
        _upserted(spark, rows, root, parts)
    return current_rows(spark, root)


def _upserted(spark: SparkSession, laws: DataFrame, root: str, parts: int) -> None:
    with corpus.staged(chunked(laws), root) as chunks:
        corpus.upsert_table(spark, root, chunks, group="law_id", parts=parts)


def current_rows(spark: SparkSession, root: str) -> DataFrame | None:
    """The chunks under ``root``, without the marks of empty laws."""
    rows = corpus.current_table(spark, root)
    return None if rows is None else rows.filter("chunk_type <> 'empty'")
