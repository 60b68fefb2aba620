"""Responses, reports and related articles on small hand-made tables."""

import pytest
from pyspark.sql import functions as F
from statuta.functions import text as T
from statuta.operators import corpus, search, segment
from statuta.sources import markup

MARK = '<mark style="' + search.MARK_STYLE + '">{}</mark>'


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("v")).first().v


def test_marks_ignore_case_and_take_keywords_as_they_are(spark):
    mark = lambda c, q: one(spark, T.highlight_ignoring_case(F.col("c"), T.keywords_by_comma(F.col("q")), "s"), c=c, q=q)
    tag = '<mark style="s">{}</mark>'
    assert mark("The the THE tHem", "the") == " ".join(tag.format(x) for x in ("The", "the", "THE")) + " " + tag.format("tHe") + "m"
    assert mark("a.b A.B axb $1 (x", "a.b, $1 (") == f"{tag.format('a.b')} {tag.format('A.B')} axb {tag.format('$1')} {tag.format('(')}x"
    assert mark("x\\Ey \\Q", "\\Ey") == "x" + tag.format("\\Ey") + " \\Q" and mark("Ärger ÄRGER", "ärger") == tag.format("Ärger") + " " + tag.format("ÄRGER")
    assert mark("text", "") == "text" and mark(None, "a") is None


ROWS = [("l_1", "Gas law\n\ntext\ngas", "Law A", "", None, "7"), ("l_2", "gas", "", "T", "definition", ""), ("x", "no", "B 시행령", "t", "k", None), ("y", None, None, None, None, None), ("l_3", "gas gas gas", "Law A", "t", "k", None)]


def docs(spark):
    return spark.createDataFrame(ROWS, "id string, content string, law_name string, title string, chunk_type string, article_number string")


def test_web_search_fields_and_defaults(spark):
    q = spark.createDataFrame([(1, "gas"), (2, "absent"), (3, " "), (4, None)], "qid long, query string")
    got = search.web_search(docs(spark), q).orderBy("rank").collect()
    assert [(r.id, r.law_name, r.article_number, r.title, r.article_type, round(r.relevance_score)) for r in got] == [("l_3", "Law A", "3", "t", "k", 100), ("l_1", "Law A", "7", "", "article", 33), ("l_2", search.DEFAULT_LAW, "2", "T", "definition", 33)]
    assert got[1].highlighted_content == MARK.format("Gas") + " law<br><br>text " + MARK.format("gas") and got[1].keywords == ["gas"] and got[1].query == "gas"
    related = spark.createDataFrame([("l_1", ["제2조"]), ("zz", ["제3조"])], "id string, related_articles array<string>")
    (r,) = search.responses(search.web_search(docs(spark), q), related=related).collect()
    assert (r.query, r.total_found, r.keywords, r.relevant_laws, r.metadata.search_method, r.metadata.llm_used) == ("gas", 3, ["gas"], ["Law A", search.DEFAULT_LAW], "keyword", False)
    assert [(a.rank, a.id, a.related_articles) for a in r.articles] == [(1, "l_3", []), (2, "l_1", ["제2조"]), (3, "l_2", [])]


def test_evaluation_and_report(spark):
    expected = spark.createDataFrame([(1, "gas", 3), (2, "absent", 1)], "qid long, query string, expected_min long")
    got = {r.qid: r for r in search.evaluate(docs(spark), expected).collect()}
    assert got[1].passed and got[1].found == 3 and got[1].top_hits == ["l_3", "l_1", "l_2"] and [(x.name, x.n) for x in got[1].by_law] == [("", 1), ("Law A", 2)] and [(x.name, x.n) for x in got[1].by_tier] == [("법률", 3)]
    assert not got[2].passed and got[2].by_law == [] and got[2].top_hits == []
    rows = {r.law_name: r for r in corpus.report(docs(spark), ["gas", "Gas"], samples=1, preview=5).collect()}
    assert rows["Law A"].n == 2 and [(c.term, c.n, c.percent) for c in rows["Law A"].coverage] == [("gas", 2, 100.0), ("Gas", 1, 50.0)] and [(x.id, x.preview) for x in rows["Law A"].samples] == [("l_1", "Gas l...")]
    assert rows[None].n == 1 and rows[None].mean_length is None and rows[None].samples[0].id == "y"
    assert {r.law_name: r.n for r in corpus.count_by(docs(spark)).collect()} == {"Law A": 2, "": 1, "B 시행령": 1, "Unknown": 1}
    assert [r.id for r in corpus.metadata_filter(docs(spark), {"law_name": "Law A", "article_number": "7"}).collect()] == ["l_1"]
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("source", "law_name")
    assert "EqualTo(source,src1)" in corpus.metadata_filter(table, {"law_name": "src1"})._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in corpus.ingest_tally(docs(spark), F.length("content") > 3).filter("law_name IS NULL").orderBy("success").collect()] == [(None, 0, 1), (None, 2, 3)]


def test_related_articles_go_by_hops_and_end_in_cycles(spark):
    edges = [("L", "1", "2", True), ("L", "2", "3", True), ("L", "3", "1", True), ("L", "3", "4", True), ("L", "1", "9", False), ("M", "1", "5", True), ("L", "2", "4", True), ("L", "4", "6", True)]
    e = spark.createDataFrame(edges, "law_id string, src string, dst string, resolved boolean")
    seeds = spark.createDataFrame([("L", "1"), ("L", "1"), ("L", "8"), ("M", "1")], "law_id string, article_number string")
    reach = lambda hops: {(r.law_id, r.article_number, r.related, r.distance) for r in segment.related_articles(e, seeds, hops).collect()}
    two = {("L", "1", "2", 1), ("L", "1", "3", 2), ("L", "1", "4", 2), ("M", "1", "5", 1)}
    assert reach(0) == set() and reach(1) == {x for x in two if x[3] == 1} and reach(2) == two and reach(5) == two | {("L", "1", "6", 3)}
    nodes = spark.createDataFrame([("L", "1"), ("L", "4"), ("L", "8")], "law_id string, article_number string")
    assert {tuple(r) for r in segment.degrees(e, nodes).collect()} == {("L", "1", 1, 1), ("L", "4", 1, 2), ("L", "8", 0, 0)}


def test_query_plan_and_marker_contexts(spark):
    q = spark.createDataFrame([(1, "수소충전소 설치 제12조제3항 제5조의2"), (2, None)], "qid long, query string")
    got = {r.qid: r for r in search.query_plan(q).collect()}
    assert (got[1].legal_terms, got[1].article_refs, len(got[1].words)) == (["설치기준", "수소충전소"], ["제12조제3항", "제5조"], 4) and got[2].words == got[2].article_refs == []
    pages = spark.createDataFrame([(1, "x" * 300 + "제3조 (목적)" + "y" * 900), (2, "<li>제1조(a)"), (3, "none"), (4, "제1조(a)b"), (5, None)], "page long, html string")
    got = {r.page: (r.at, r.context) for r in markup.marker_contexts(pages, "page", "html", {"item": "<li>"}).collect()}
    assert got == {1: (301, "x" * 200 + "제3조 (목적)" + "y" * 492), 4: (1, "제1조(a)b")} and len(got[1][1]) == pytest.approx(700)


def test_hybrid_function_by_name_equals_the_operator(spark, tmp_path):
    from statuta.plans import sql_functions

    words = ["gas law one", "gas gas", "law and gas", "x", "", "Gas-law"]
    rows = spark.createDataFrame([(f"d{i}", t, "L", [float(i), 1.0]) for i, t in enumerate(words)], "id string, content string, law_name string, embedding array<double>")
    index = search.text_index(rows, str(tmp_path / "t"))
    sql_functions.register(spark, rows, rows.select("id", "embedding"), index)
    for text in ("gas", "law gas", "unknown"):
        q = spark.createDataFrame([(1, text, [1.0, 2.0])], "qid long, query string, qvec array<double>")
        want = {r.id: (r.semantic_rank, r.keyword_rank, pytest.approx(r.relevance)) for r in search.hybrid_search_sql(rows, q, 4, index=index).collect()}
        got = {r.id: (r.semantic_rank, r.keyword_rank, r.relevance_score) for r in spark.sql("SELECT * FROM hybrid_search(query_vector => array(1D, 2D), search_query => :t, max_results => 4)", {"t": text}).collect()}
        assert got == want and len(got) == 4
    # places were held against one another by a join of all of them; they stay in their document's row now
    plan = spark.sql("SELECT * FROM hybrid_search('gas law', array(1D, 2D), 4)")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in line and "abs(" in line for line in plan.splitlines())
