"""Search functions that SQL can call by name, with named arguments and defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.postings import PostingIndex

_HITS = "length(content) - length(replace(content, search_query, ''))"

FUNCTIONS = {
    "search_documents": f"""
        (search_query STRING, max_results INT DEFAULT 100)
        RETURNS TABLE (id STRING, content STRING, law_name STRING, relevance_score DOUBLE)
        RETURN SELECT id, content, law_name, score FROM (
            SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM (
                SELECT id, content, law_name, CAST(({_HITS}) AS DOUBLE) / length(search_query) AS score
                FROM {{corpus}} WHERE length(trim(search_query)) > 0 AND contains(content, search_query)))
        WHERE place <= max_results""",
    "search_documents_x10": """
        (search_query STRING, max_results INT DEFAULT 100)
        RETURNS TABLE (id STRING, content STRING, law_name STRING, relevance_score DOUBLE)
        RETURN SELECT id, content, law_name, 10 * relevance_score FROM search_documents(search_query, max_results)""",
    "match_documents": """
        (query_vector ARRAY<DOUBLE>, max_results INT DEFAULT 10)
        RETURNS TABLE (id STRING, similarity DOUBLE)
        RETURN SELECT id, similarity FROM (
            SELECT *, row_number() OVER (ORDER BY similarity DESC NULLS LAST, id) AS place FROM (
                SELECT id, try_divide(
                    aggregate(zip_with(embedding, query_vector, (x, y) -> x * y), 0D, (acc, z) -> acc + z),
                    sqrt(aggregate(embedding, 0D, (acc, x) -> acc + x * x)) * sqrt(aggregate(query_vector, 0D, (acc, x) -> acc + x * x))) AS similarity
                FROM {vectors} WHERE embedding IS NOT NULL))
        WHERE place <= max_results""",
    "hybrid_search": """
        (search_query STRING, query_vector ARRAY<DOUBLE>, max_results INT DEFAULT 10)
        RETURNS TABLE (id STRING, relevance_score DOUBLE, semantic_rank BIGINT, keyword_rank BIGINT)
        RETURN WITH lex AS (SELECT DISTINCT term FROM (SELECT explode(filter(split(lower(search_query), '[^\\\\p{{L}}\\\\p{{N}}]+'), t -> t <> '')) AS term)),
        need AS (SELECT count(*) AS n FROM lex),
        hits AS (SELECT term, e.ids AS id, e.places FROM (SELECT term, explode(arrays_zip(ids, places)) AS e FROM {places} WHERE term IN (SELECT term FROM lex))),
        whole AS (SELECT id, any_value(size(places)) AS n, collect_list(named_struct('term', term, 'places', places)) AS found FROM hits GROUP BY id HAVING count(*) = (SELECT n FROM need)),
        near AS (SELECT id, 1 - exp(sum(ln(1 - 0.1 * sqrt(1 / (1.005 + 0.05 * exp(abs(p - q) / 1.5 - 2)))))) AS score
            FROM whole LATERAL VIEW explode(found) x AS a LATERAL VIEW explode(found) y AS b LATERAL VIEW explode(a.places) z AS p LATERAL VIEW explode(b.places) u AS q
            WHERE a.term < b.term AND abs(p - q) <= 100 GROUP BY id),
        texts AS (SELECT w.id, CASE WHEN (SELECT n FROM need) = 1 THEN 0.1 * aggregate(sequence(1, w.n), 0D, (acc, j) -> acc + 1D / (j * j)) / 1.64493406685 ELSE coalesce(near.score, 0D) END AS score FROM whole w LEFT JOIN near ON near.id = w.id),
        keyword AS (SELECT id, CAST(place AS BIGINT) AS place FROM (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC NULLS LAST, id) AS place FROM texts) WHERE place <= 2 * max_results),
        semantic AS (SELECT id, CAST(place AS BIGINT) AS place FROM (SELECT id, row_number() OVER (ORDER BY round(similarity, 9) DESC NULLS LAST, id) AS place FROM (
            SELECT id, try_divide(
                aggregate(zip_with(embedding, query_vector, (x, y) -> x * y), 0D, (acc, z) -> acc + z),
                sqrt(aggregate(embedding, 0D, (acc, x) -> acc + x * x)) * sqrt(aggregate(query_vector, 0D, (acc, x) -> acc + x * x))) AS similarity
            FROM {vectors} WHERE size(embedding) = size(query_vector)) WHERE similarity IS NOT NULL) WHERE place <= 2 * max_results),
        fused AS (SELECT coalesce(s.id, k.id) AS id, s.place AS semantic_rank, k.place AS keyword_rank, 100 * (0.7D / (60 + coalesce(s.place, 999999)) + 0.3D / (60 + coalesce(k.place, 999999))) AS score FROM semantic s FULL OUTER JOIN keyword k ON s.id = k.id)
        SELECT id, score, semantic_rank, keyword_rank FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS place FROM fused) WHERE place <= max_results""",
}


def register(spark: SparkSession, corpus: DataFrame, vectors: DataFrame | None = None, places: PostingIndex | None = None) -> None:
    """Makes temporary table functions over a corpus (id, content, law_name) and, if given, vectors (id,
    embedding array<double>) and a saved index of places (``search.text_index``), for this session.

    ``hybrid_search`` needs both, and gives what ``search.hybrid_search_sql`` does for one query.
    """
    views = {"corpus": corpus, "vectors": vectors, "places": None if places is None else places.rows}
    names = {name: f"searched_{name}" for name in views}
    for name, rows in views.items():
        if rows is not None:
            rows.createOrReplaceTempView(names[name])
    for name, body in FUNCTIONS.items():
        if all(rows is not None or f"{{{view}}}" not in body for view, rows in views.items()):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body.format(**names)}")
