"""Statute XML, and probes of HTML, held in string columns (HTML as a tree: ``html``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# The tags of the statute service's XML.
LIST_SCHEMA = "`법령일련번호` STRING, `법령명한글` STRING, `법령구분명` STRING, `공포일자` STRING, `시행일자` STRING"
DETAIL_SCHEMA = (
    "`법령일련번호` STRING, `법령명한글` STRING, `법령구분명` STRING, `공포일자` STRING, `시행일자` STRING, "
    "`조문` ARRAY<STRUCT<`조문번호`: STRING, `조문제목`: STRING, `조문내용`: STRING, `항`: ARRAY<STRUCT<`항번호`: STRING, `항내용`: STRING>>>>"
)
UNKNOWN_TYPE = "미분류"


def _field(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def law_list(rows: DataFrame, column: str = "xml") -> DataFrame:
    """Headers of search results: (law_id, law_name, law_type, promulgation_date,
    enforcement_date); entries without id or name go."""
    entries = rows.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?s)(<law(?:\s[^>]*)?>.*?</law>)"), F.lit(1))).alias("one"))
    law = entries.select(F.from_xml("one", LIST_SCHEMA).alias("l")).select("l.*")
    out = law.select(
        _field(F.col("법령일련번호")).alias("law_id"),
        _field(F.col("법령명한글")).alias("law_name"),
        F.coalesce(_field(F.col("법령구분명")), F.lit(UNKNOWN_TYPE)).alias("law_type"),
        _field(F.col("공포일자")).alias("promulgation_date"),
        _field(F.col("시행일자")).alias("enforcement_date"),
    )
    return out.filter("law_id IS NOT NULL AND law_name IS NOT NULL")


def of_type(headers: DataFrame, keyword: str, law_type: str | None = None, display: int = 100) -> DataFrame:
    """Headers whose name holds the keyword, of one type if given: the first ``display`` (100 at most) by id."""
    rows = headers.filter(F.contains("law_name", F.lit(keyword)))
    rows = rows if law_type is None else rows.filter(F.col("law_type") == law_type)
    return rows.orderBy("law_id").limit(min(display, 100))


def law_details(rows: DataFrame, column: str = "xml") -> DataFrame:
    """Nested laws; what is no well-formed law document gives no row."""
    law = rows.select(F.from_xml(column, DETAIL_SCHEMA + ", _corrupt_record STRING").alias("l")).select("l.*").filter("_corrupt_record IS NULL AND `법령일련번호` IS NOT NULL")
    pars = lambda a: F.transform(a["항"], lambda p: F.struct(_field(p["항번호"]).alias("number"), _field(p["항내용"]).alias("content")))
    arts = F.transform(
        "조문",
        lambda a: F.struct(_field(a["조문번호"]).alias("article_number"), _field(a["조문제목"]).alias("title"), _field(a["조문내용"]).alias("content"), F.coalesce(pars(a), F.array().cast("array<struct<number:string,content:string>>")).alias("paragraphs")),
    )
    return law.select(_field(F.col("법령일련번호")).alias("law_id"), _field(F.col("법령명한글")).alias("law_name"), arts.alias("articles"))


def exploded_articles(details: DataFrame) -> DataFrame:
    return details.select("law_id", "law_name", F.explode_outer("articles").alias("a")).select("law_id", "law_name", "a.*")


def selector_counts(rows: DataFrame, key: str, column: str, patterns: dict[str, str]) -> DataFrame:
    """(key, selector, n): how often each candidate pattern occurs in a page."""
    pairs = ", ".join(f"'{name}', n_{i}" for i, name in enumerate(patterns))
    counted = rows.select(key, *(F.coalesce(F.regexp_count(column, F.lit(p)), F.lit(0)).cast("long").alias(f"n_{i}") for i, p in enumerate(patterns.values())))
    return counted.select(key, F.expr(f"stack({len(patterns)}, {pairs}) AS (selector, n)"))


def marker_contexts(rows: DataFrame, key: str, column: str, patterns: dict[str, str], marker: str = text.ARTICLE_HEAD, before: int = 200, after: int = 500) -> DataFrame:
    """(key, at, context) of pages on which no pattern occurs but the marker does: the place of its
    first occurrence (from 1) and the text from ``before`` characters ahead to ``after`` behind its start."""
    none = F.lit(True)
    for p in patterns.values():
        none &= F.regexp_count(column, F.lit(p)) == 0
    found = rows.filter(none).withColumn("_first", F.regexp_extract(column, f"({marker})", 1)).filter("_first <> ''")
    at = F.instr(F.col(column), F.col("_first")).cast("long")
    start = F.greatest(F.lit(1).cast("long"), at - before)
    return found.select(key, at.alias("at"), F.substring(F.col(column), start.cast("int"), (at + after - start).cast("int")).alias("context"))
