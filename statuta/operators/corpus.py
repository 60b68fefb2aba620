"""The corpus table: mapping, reading, filtering, upserting and checking."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def law_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus: id, content, law_name, title, chunk_type, is_definition, embedding."""
    docs = table(spark, sf_dir, "documents")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(vectors, "doc_id", "left").join(labels, "doc_id", "left").select(*_columns(), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("is_definition"), F.col("embedding").cast("array<double>").alias("embedding"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding) of the corpus."""
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("doc_"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, is_definition) of the rows that are definitions."""
    return table(spark, sf_dir, "labels").filter("quality = 1").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), F.lit(True).alias("is_definition")).distinct()


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``law_documents`` without what other tables hold: no join."""
    return table(spark, sf_dir, "documents").select(*_columns())


def _columns() -> list[Column]:
    return [
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"),
        "doc_id",
        F.col("text").alias("content"),
        F.col("source").alias("law_name"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("lang").alias("chunk_type"),
    ]  # type: ignore[list-item]


def metadata_filter(corpus: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Equality on columns; a plain conjunction, so that it reaches the Parquet scan."""
    for name, value in wanted.items():
        corpus = corpus.filter(F.col(name) == value)
    return corpus


def new_only(incoming: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    return incoming.join(existing.select(key).distinct(), key, "left_anti")


def one_each(rows: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """One row of each key: the greatest by ``order``, equal ones told apart by a hash of the row,
    so the choice doesn't depend on how rows are dealt.  An aggregate with map-side combine (over
    whole rows, so sort-based)."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*order, F.xxhash64(*rows.columns))).alias("row")
    return rows.groupBy(key).agg(last).select("row.*")


def append_chunks(incoming: DataFrame, path: str) -> int:
    """Appends rows whose id isn't there yet, stamped with created_at, and returns how many;
    replaying a batch adds no row."""
    spark, fresh = incoming.sparkSession, one_each(incoming, "id")
    try:
        fresh = new_only(fresh, spark.read.parquet(path).select("id"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    fresh = fresh.withColumn("created_at", F.current_timestamp()) if "created_at" not in fresh.columns else fresh
    fresh = fresh.persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The last version of each key; a null version is before all others."""
    return one_each(rows, key, F.col(version))


def newest_of_group(rows: DataFrame, group: str, version: str) -> DataFrame:
    """The rows that have their group's newest version; what an older version had and a newer one hasn't goes."""
    newest = rows.groupBy(F.col(group).alias("_group")).agg(F.max(version).alias("_newest"))
    return rows.join(newest, F.col(group).eqNullSafe(F.col("_group")) & F.col(version).eqNullSafe(F.col("_newest"))).drop("_group", "_newest")


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id", version: str = "version", group: str | None = None) -> DataFrame:
    """Both tables' rows, the last version of each key and, if asked for, of each group."""
    both = existing.unionByName(incoming)
    return latest(both if group is None else newest_of_group(both, group, version), key, version)


#: Bytes of rows that a part of a table is for (a task holds and sorts one part's rows), and bytes in files that one of a stream's state is for.
PART_BYTES, PART_FILE_BYTES = 48 << 20, 16 << 20


def _store(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def parts_of(spark: SparkSession, folder: str, least: int) -> int:
    """Into how many parts the files under ``folder`` are dealt: ``least``, or as many as their size asks for."""
    store, path = _store(spark, folder)
    return max(least, -(-store.getContentSummary(path).getLength() // PART_FILE_BYTES)) if store.exists(path) else least


def _bytes(rows: DataFrame) -> int:
    """How much rows hold, about: their strings' bytes and eight for anything else."""
    sizes = [F.coalesce(F.octet_length(name), F.lit(0)) if kind == "string" else F.lit(8) for name, kind in rows.dtypes]
    return rows.agg(F.coalesce(F.sum(sum(sizes[1:], sizes[0]).cast("long")), F.lit(0))).first()[0]


@contextmanager
def staged(rows: DataFrame, root: str) -> Iterator[DataFrame]:
    """Rows as written once to a folder under ``root``, which goes at the end: what reads them several times doesn't work them out anew."""
    spark, folder = rows.sparkSession, f"{root}/staged-{uuid.uuid4().hex}"
    try:
        rows.write.parquet(folder)
        yield spark.read.schema(rows.schema).parquet(folder)
    finally:
        store, path = _store(spark, folder)
        store.delete(path, True)


def upsert_table(spark: SparkSession, root: str, incoming: DataFrame, key: str = "id", version: str = "version", group: str | None = None, parts: int = 64) -> None:
    """Merges rows into the table under ``root``, for one writer at a time.

    The table is dealt into parts by a hash of ``group`` (or ``key``); a key is of one group.  A new table has
    ``parts`` of them, or more if its first rows are many.  Only parts that
    incoming rows touch are merged and written, to a new folder; then one file with the
    parts' new places is added to the list.  Readers go by the list's last entry for each
    part, so a crash at any point leaves the table as it was.  Rows are shuffled once, by part: what has
    the same key or group is in one part.  Incoming rows are worked out several times (see ``staged``).
    """
    places = _places(spark, root)
    parts = int(places["parts"].iloc[0]) if len(places) else max(parts, -(-_bytes(incoming) // PART_BYTES))
    part = F.pmod(F.xxhash64(group or key), F.lit(parts))
    touched = [r["part"] for r in incoming.select(part.alias("part")).distinct().collect()]
    if not touched:
        return
    folders = places[places["part"].isin(touched) & places["folder"].notna()]["folder"].tolist()
    both = spark.read.schema(incoming.schema).parquet(*folders).unionByName(incoming) if folders else incoming
    dealt = both.withColumn("dealt", part).repartition(len(touched), "dealt")
    if group is not None:
        newest = F.max(version).over(Window.partitionBy("dealt", group))
        dealt = dealt.withColumn("_newest", newest).filter(F.col(version).eqNullSafe(F.col("_newest"))).drop("_newest")
    folder = f"{root}/data-{uuid.uuid4().hex}"
    one_each(dealt, ["dealt", key], F.col(version)).write.partitionBy("dealt").parquet(folder)
    full = {r["dealt"] for r in spark.read.parquet(folder).select("dealt").distinct().collect()}
    number = int(places["number"].max()) + 1 if len(places) else 1
    rows = [(number, p, f"{folder}/dealt={p}" if p in full else None, parts) for p in touched]
    spark.createDataFrame(rows, _PLACES).coalesce(1).write.mode("append").parquet(f"{root}/places")


def vacuum_table(spark: SparkSession, root: str) -> list[str]:
    """Deletes the folders under ``root`` that no part's last entry names, and those a crash left, and returns their names.

    For a time when nobody reads an older state or merges: a reader of before would miss its files.
    """
    kept = {f.rstrip("/").rsplit("/", 2)[-2] for f in _places(spark, root)["folder"].dropna()}
    store, path = _store(spark, root)
    gone = [s.getPath() for s in store.listStatus(path) if s.getPath().getName().startswith(("data-", "staged-")) and s.getPath().getName() not in kept]
    for p in gone:
        store.delete(p, True)
    return sorted(p.getName() for p in gone)


_PLACES = "number long, part long, folder string, parts long"


def _places(spark: SparkSession, root: str) -> pd.DataFrame:
    """The last entry of each part: at most as many rows as there are parts."""
    try:
        entries = spark.read.schema(_PLACES).parquet(f"{root}/places")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        entries = spark.createDataFrame([], _PLACES)
    return entries.groupBy("part").agg(F.max("number").alias("number"), F.max_by("folder", "number").alias("folder"), F.max("parts").alias("parts")).toPandas()


def current_table(spark: SparkSession, root: str, schema: StructType | str | None = None) -> DataFrame | None:
    """The table under ``root`` as last merged; None (or, with a schema, no rows) before that."""
    folders = _places(spark, root)["folder"].dropna().tolist()
    if not folders:
        return None if schema is None else spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*sorted(folders))


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder in the store that driver and executors share (spark.checkpoint.dir); a local session may do without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/statuta-{uuid.uuid4().hex}"


def reset_collection(spark: SparkSession, name: str, schema: StructType | str) -> None:
    """Deletes and recreates a table without rows."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.createDataFrame([], schema).write.mode("overwrite").saveAsTable(name)


def drop_collection(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def collection_stats(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count("*").alias("n_rows"), F.max(F.size("embedding")).cast("long").alias("dim"))


def check_schema(corpus: DataFrame, dim: int) -> DataFrame:
    """Violations of the table's constraints: repeated ids, null contents, wrong vector lengths."""
    return corpus.agg(
        (F.count("*") - F.count_distinct("id")).alias("repeated_ids"),
        F.count_if(F.col("content").isNull()).alias("null_content"),
        F.count_if(F.col("embedding").isNotNull() & (F.size("embedding") != dim)).alias("bad_vectors"),
    )


def first_per_group(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n per group on each side of the shuffle."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("rn", F.row_number().over(w).cast("long")).filter(F.col("rn") <= n)


def metadata_project(corpus: DataFrame) -> DataFrame:
    """id, title, number and kind with their defaults: an empty title is untitled, the number is the id's part
    after the first underscore, a missing kind is article."""
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("untitled"))
    return corpus.select("id", title.alias("title"), F.get(F.split("id", "_"), F.lit(1)).alias("number"), F.coalesce("chunk_type", F.lit("article")).alias("kind"))


def count_by(rows: DataFrame, column: str = "law_name", missing: str = "Unknown") -> DataFrame:
    """(column, n); null counts under ``missing``."""
    return rows.groupBy(F.coalesce(column, F.lit(missing)).alias(column)).agg(F.count("*").alias("n"))


def term_coverage(corpus: DataFrame, terms: Sequence[str], group: str = "law_name") -> DataFrame:
    """(group, term, n, percent): documents of each group that hold each term, in one pass over the texts."""
    counts = [F.count_if(F.contains("content", F.lit(t))).alias(f"n_{i}") for i, t in enumerate(terms)]
    each = F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"n_{i}").alias("n")) for i, t in enumerate(terms)))
    rows = corpus.groupBy(group).agg(F.count("*").alias("all"), *counts).select(group, "all", F.explode(each).alias("t"))
    return rows.select(group, "t.term", "t.n", F.round(100.0 * F.col("t.n") / F.col("all"), 1).alias("percent"))


def occurrence_totals(corpus: DataFrame, term: str, group: str = "law_name") -> DataFrame:
    """(group, total): occurrences of a term over all documents of each group."""
    return corpus.groupBy(group).agg(F.sum(text.occurrences(F.col("content"), F.lit(term))).alias("total"))


def ingest_tally(rows: DataFrame, good: Column, group: str = "law_name") -> DataFrame:
    """(group, success, failed), and one row of null for all groups; what can't be told failed."""
    ok = F.coalesce(good, F.lit(False))
    return rows.rollup(group).agg(F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"))


def report(corpus: DataFrame, terms: Sequence[str], samples: int = 3, preview: int = 100, group: str = "law_name") -> DataFrame:
    """One row per group: n, mean_length, coverage (term, n, percent; in the order of the terms) and samples
    (id, preview of the content) of its first documents by id.  One pass over the texts for the figures, one
    for the samples, of which each task keeps as many as are asked for."""
    figures = corpus.groupBy(group).agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.length("content"))).alias("mean_length"),
        F.array(*(F.struct(F.lit(t).alias("term"), (c := F.count_if(F.contains("content", F.lit(t)))).alias("n"), F.round(100.0 * c / F.count("*"), 1).alias("percent")) for t in terms)).alias("coverage"),
    )
    first = first_per_group(corpus.select(group, "id", text.preview(F.col("content"), preview).alias("preview")), group, "id", samples)
    shown = first.groupBy(F.col(group).alias("_group")).agg(F.sort_array(F.collect_list(F.struct("id", "preview"))).alias("samples"))
    return figures.join(shown, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")
