"""Every registered query of the retrieval engine with its SQL oracle.

Queries run over whole tables.  ``documents`` stands in for the statute corpus
(source as law name, language as kind); statute markup is put around its texts
where a query needs some.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexemes
from ..functions import text as T
from ..functions import vectors as V
from ..operators import ann, batch as batches, corpus, search, segment, semantic, substring
from ..operators.corpus import law_documents, table, text_corpus
from ..sources import html, markup
from ..streaming import ingest
from . import sql_functions

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

BATCH = [(1, "the"), (2, "password"), (3, "que la"), (4, ""), (5, "  "), (6, "ción"), (7, "th thing"), (8, "no such text"), (9, "The")]
#: Searches ask for every row whose id is divisible by this; a text query is the row's first three words.
EVERY = 100
EXPECTED = [(1, "the", 10), (2, "password", 5), (3, "que la", 3), (4, "no such text", 1)]
BOOSTS = {"en": 5, "de": 3, "fr": 2, "es": 1}
TERMS = ["the", "de", "que", "und", "token"]

SQL_TEXT = "t AS (SELECT 'doc_' || doc_id AS id, doc_id, text AS content, source AS law_name, split_part(text, chr(10), 1) AS title, lang AS chunk_type FROM documents)"
SQL_LAW = """law AS (SELECT 'doc_' || d.doc_id AS id, d.doc_id, d.text AS content, d.source AS law_name, split_part(d.text, chr(10), 1) AS title,
 d.lang AS chunk_type, coalesce(l.quality = 1, false) AS is_definition, CAST(e.embedding AS DOUBLE[]) AS embedding
 FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
SQL_STATUTE = """s AS (SELECT 'law_' || doc_id AS law_id, doc_id, CAST(doc_id % 40 + 1 AS VARCHAR) AS n, 'head ' || replace(replace(string_split(text, ' ')[1], '(', ''), ')', '') AS head, text,
 '제' || (doc_id % 40 + 1) || '조(head ' || replace(replace(string_split(text, ' ')[1], '(', ''), ')', '') || ') ' || text || chr(10) || '제' || (doc_id % 40 + 2) || '조 (second) see 제' || (doc_id % 40 + 1) || '조제2항 and 제99조' AS body FROM documents)"""


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + str(x) + "'" if isinstance(x, str) else f"CAST({x} AS BIGINT)" for x in r) + ")" for r in rows)


SQL_BATCH = f"q(qid, query) AS (SELECT * FROM (VALUES {_values(BATCH)}))"
SQL_WORDS3 = "array_to_string(list_slice(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), 1, 3), ' ')"
SQL_ASKED = f"q AS (SELECT doc_id AS qid, {SQL_WORDS3} AS query FROM documents WHERE doc_id % {EVERY} = 0)"
SQL_PROBES = f"q AS (SELECT doc_id AS qid, {SQL_WORDS3} AS query, CAST(e.embedding AS DOUBLE[]) AS qvec FROM documents JOIN embeddings e ON e.vec_id = doc_id WHERE doc_id % {EVERY} = 0)"
SQL_VPROBES = f"q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS qvec FROM embeddings WHERE vec_id % {EVERY} = 0)"
SQL_HITS = "h AS (SELECT qid, id, (length(content) - length(replace(content, query, ''))) / length(query) AS score FROM t JOIN q ON contains(content, query) WHERE length(trim(query)) > 0)"
SQL_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC NULLS LAST, id) AS rank FROM h)"


def batch(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BATCH, "qid long, query string")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text queries: (qid, query)."""
    rows = table(spark, sf_dir, "documents").filter(F.col("doc_id") % EVERY == 0)
    return rows.select(F.col("doc_id").alias("qid"), F.array_join(F.slice(T.tokens(F.col("text")), 1, 3), " ").alias("query"))


def vector_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector queries: (qid, qvec)."""
    rows = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % EVERY == 0)
    return rows.select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("qvec"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of both kinds at once: (qid, query, qvec)."""
    return asked(spark, sf_dir).join(vector_probes(spark, sf_dir), "qid")


def statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(law_id, doc_id, n, head, text, body): texts with statute markup around them."""
    docs = table(spark, sf_dir, "documents")
    head = F.concat(F.lit("head "), F.replace(F.replace(F.substring_index("text", " ", 1), F.lit("("), F.lit("")), F.lit(")"), F.lit("")))
    n = F.col("doc_id") % 40 + 1
    s = lambda c: c.cast("string")
    body = F.concat(F.lit("제"), s(n), F.lit("조("), head, F.lit(") "), F.col("text"), F.lit("\n제"), s(n + 1), F.lit("조 (second) see 제"), s(n), F.lit("조제2항 and 제99조"))
    return docs.select(F.concat(F.lit("law_"), s(F.col("doc_id"))).alias("law_id"), "doc_id", s(n).alias("n"), head.alias("head"), "text", body.alias("body"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return add


def simple(name: str, sql: str, columns: Callable[[], list[Column | str]], source: str = "text", where: Callable[[], Column] | None = None) -> None:
    """A query that projects (and filters) one table row by row; columns need a session, so they are made late."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = text_corpus(spark, sf_dir) if source == "text" else table(spark, sf_dir, source)
        return (df if where is None else df.filter(where())).select(*columns())

    query(name, sql)(run)


def _content() -> Column:
    return F.col("content")


def _title() -> Column:
    return F.col("title")


def long(c: Column) -> Column:
    return c.cast("long")



# --- sources, sinks, maintenance -------------------------------------------------------
simple("scan_corpus", f"WITH {SQL_TEXT} SELECT id, law_name FROM t", lambda: ["id", "law_name"])


def _xml(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@query("read_law_list_xml", "SELECT CAST(doc_id AS VARCHAR) AS law_id, 'name ' || source AS law_name, CASE WHEN lang = 'en' THEN '미분류' ELSE lang END AS law_type, '2024' AS promulgation_date, CAST(NULL AS VARCHAR) AS enforcement_date FROM documents WHERE doc_id % 7 <> 0")
def read_law_list_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    ident = F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.col("doc_id").cast("string"))
    kind = F.when(F.col("lang") == "en", F.lit("")).otherwise(F.concat(F.lit("<법령구분명>"), "lang", F.lit("</법령구분명>")))
    law = F.concat(F.lit("<law><법령일련번호> "), ident, F.lit(" </법령일련번호><법령명한글> name "), _xml(F.col("source")), F.lit("</법령명한글>"), kind, F.lit("<공포일자>2024</공포일자><시행일자></시행일자></law>"))
    return markup.law_list(d.select(F.concat(F.lit("<LawSearch>"), law, F.lit("</LawSearch>")).alias("xml")))


@query("read_law_detail_xml", "SELECT CAST(doc_id AS VARCHAR) AS law_id, CASE WHEN k = 1 THEN '1' ELSE '2' END AS article_number, CASE WHEN k = 1 THEN source ELSE NULL END AS title, CAST(CASE WHEN k = 1 THEN doc_id % 3 ELSE 0 END AS BIGINT) AS n_paragraphs FROM documents, (VALUES (1), (2)) v(k) WHERE doc_id % 5 <> 0")
def read_law_detail_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    pars = F.repeat(F.lit("<항><항번호>①</항번호><항내용>text</항내용></항>"), (F.col("doc_id") % 3).cast("int"))
    one = F.concat(F.lit("<조문><조문번호>1</조문번호><조문제목> "), _xml(F.col("source")), F.lit(" </조문제목><조문내용>body</조문내용>"), pars, F.lit("</조문>"))
    end = F.when(F.col("doc_id") % 5 == 0, F.lit("<broken")).otherwise(F.lit("</법령>"))
    xml = F.concat(F.lit("<법령><법령일련번호>"), F.col("doc_id").cast("string"), F.lit("</법령일련번호><법령명한글>n</법령명한글>"), one, F.lit("<조문><조문번호>2</조문번호><조문내용>b</조문내용></조문>"), end)
    rows = markup.exploded_articles(markup.law_details(d.select(xml.alias("xml"))))
    return rows.select("law_id", "article_number", "title", long(F.size("paragraphs")).alias("n_paragraphs"))


#: References in a node's text, decoded as in HTML: the semicolon after a named one may be missing (a text may be cut within one), and a
#: number ends at the node; the cut-off number 2 is no character and gives nothing.
SQL_DECODED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', chr(34), 'g'), '&#x27(;|$)', chr(39), 'g'), '&#x2$', ''), '&amp;?', '&', 'g')"
#: A page's body as the texts of its nodes, each decoded and stripped, without tags.
SQL_NODES = "array_to_string(list_transform(string_split(regexp_replace(a, '<[^>]*>', chr(1), 'g'), chr(1)), lambda x: trim(" + SQL_DECODED.format("x") + ", chr(10) || chr(13) || chr(9) || ' ')), '')"


@query("read_law_html", f"SELECT page_id, trim({SQL_DECODED.format('h')}) AS number, {SQL_NODES} AS content FROM (SELECT page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a FROM pages) WHERE h <> ''")
def read_law_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.law_pages(table(spark, sf_dir, "pages"), "page_id", block=("body", None), number=("h1", None), title=None, content=("article", None))
    return rows.select("page_id", "number", "content")


SQL_TRIM = "trim({}, chr(10) || chr(13) || chr(9) || ' ')"
SQL_PAGES = f"""WITH d AS (SELECT doc_id, source, text, k, instr(text, chr(10)) AS cut FROM documents, (VALUES (1), (2), (3)) v(k)),
 b AS (SELECT doc_id, k, '제' || doc_id || '조의' || k AS number, CASE WHEN (doc_id + k) % 3 = 0 THEN NULL WHEN k = 2 THEN source || '<&' ELSE source END AS title,
 CASE WHEN k = 3 THEN {SQL_TRIM.format("'①' || text")} WHEN cut > 0 THEN {SQL_TRIM.format("left(text, cut)")} || {SQL_TRIM.format("substr(text, cut + 1)")} ELSE {SQL_TRIM.format("text")} END AS content FROM d WHERE (doc_id + k) % 7 <> 0)"""


@query("read_statute_html", SQL_PAGES + " SELECT doc_id, number, title, content FROM b")
def read_statute_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statute_pages(spark, sf_dir).select("doc_id", "number", "title", "content")


SQL_CONTENT_LINES = "ln AS (SELECT doc_id, number, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS no FROM b WHERE k = 3), l2 AS (SELECT doc_id, number, no, trim(line, chr(13) || chr(9) || ' ') AS line FROM ln WHERE trim(line, chr(13) || chr(9) || ' ') <> '')"


@query("read_html_paragraphs", SQL_PAGES + f", {SQL_CONTENT_LINES} SELECT doc_id, number, '①' AS paragraph, trim(substr(string_agg(line, ' ' ORDER BY no), 2)) AS content FROM l2 GROUP BY 1, 2")
def read_html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _statute_pages(spark, sf_dir).select("doc_id", "number", F.explode("paragraphs").alias("p"))
    return rows.select("doc_id", "number", F.col("p.number").alias("paragraph"), F.trim("p.content").alias("content"))


def _statute_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statute pages made of the texts, three articles each: classes in either quotes and among
    others, a nested division, references for what markup needs, inline tags, unclosed ones, some without number or title."""
    d = table(spark, sf_dir, "documents")
    lit, ident = F.lit, F.col("doc_id").cast("string")
    cut = F.instr("text", "\n")
    nested = F.concat(lit("<div>"), _xml(F.left("text", cut)), lit("</div>"), _xml(F.substring(F.col("text"), cut + 1, F.length("text"))))
    whole = F.when(cut > 0, nested).otherwise(_xml(F.col("text")))
    body = {1: whole, 2: whole, 3: F.concat(lit("&#9312;"), _xml(F.col("text")))}
    opened = {1: '<div class="article">', 2: "<div id=x class='main article'>", 3: '<DIV CLASS="article  last">'}
    page = [lit("<html><head><style>div.article{}</style></head><body><div class='articles'><!-- <div class=\"article\"> -->")]
    for k in (1, 2, 3):
        number = F.when((F.col("doc_id") + k) % 7 == 0, lit("")).otherwise(F.concat(lit("<p><span class='article-number'> <b>제"), ident, lit(f"조</b>의{k}</span>")))
        inline = ("<i> ", " </i>&lt;&amp;") if k == 2 else ("", "")
        title = F.when((F.col("doc_id") + k) % 3 == 0, lit("")).otherwise(F.concat(lit('<span class="article-title x">' + inline[0]), F.col("source"), lit(inline[1] + "</span>")))
        page += [lit(opened[k]), number, title, lit('<div class="article-content"><script>var x = "</b>";</script>'), body[k], lit("</div><br/></div>")]
    return html.law_pages(d.select("doc_id", F.concat(*page, lit("</div></body></html>")).alias("html")), "doc_id")


@query("law_type_filter", "SELECT CAST(doc_id AS VARCHAR) AS law_id, 'name ' || source AS law_name, lang AS law_type FROM documents WHERE doc_id % 7 <> 0 AND lang = 'de' AND contains('name ' || source, 'src1') ORDER BY 1 LIMIT 100")
def law_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.of_type(read_law_list_xml(spark, sf_dir), "src1", "de", 500).select("law_id", "law_name", "law_type")


_SELECTORS = {"article": "<article", "heading": "<h1", "paragraph": "<p>", "item": "<li>", "law": 'class="article"'}


@query("probe_selectors", "SELECT page_id, k AS selector, CAST(len(regexp_extract_all(html, p)) AS BIGINT) AS n FROM pages, (VALUES " + _values(list(_SELECTORS.items())) + ") v(k, p)")
def probe_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.selector_counts(table(spark, sf_dir, "pages"), "page_id", "html", _SELECTORS)


@query("probe_marker_context", "SELECT page_id, instr(html, 'the ') AS at, substr(html, greatest(1, instr(html, 'the ') - 200), instr(html, 'the ') + 500 - greatest(1, instr(html, 'the ') - 200)) AS context FROM pages WHERE contains(html, 'the ') AND NOT contains(html, '<ol>')")
def probe_marker_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where no selector occurs: the text around the first marker."""
    return markup.marker_contexts(table(spark, sf_dir, "pages"), "page_id", "html", {"ordered": "<ol>"}, "the ")


@query("concat_page_text", "SELECT conv_id, string_agg(text || chr(10), '' ORDER BY turn, text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def concat_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.page_text(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


SQL_NEW = "SELECT 'doc_' || doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"


@query("new_only_anti_join", SQL_NEW)
def new_only_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.new_only(text_corpus(spark, sf_dir).select("id"), corpus.vectors(spark, sf_dir).select("id"))


@query("append_chunks", f"WITH {SQL_TEXT} SELECT id, content, law_name, true AS stamped, CAST(0 AS BIGINT) AS added_again FROM t")
def append_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that holds the rows with vectors takes up all rows, twice; the second time adds none."""
    rows, folder = text_corpus(spark, sf_dir).select("id", "content", "law_name"), corpus.scratch_folder(spark)
    corpus.append_chunks(rows.join(corpus.vectors(spark, sf_dir).select("id"), "id", "left_semi"), folder)
    corpus.append_chunks(rows, folder)
    again = corpus.append_chunks(rows, folder)
    return spark.read.parquet(folder).select("id", "content", "law_name", F.col("created_at").isNotNull().alias("stamped"), F.lit(again).cast("long").alias("added_again"))


@query("created_at", "SELECT source AS law_name, count(*) AS n, count(*) AS stamped FROM documents GROUP BY 1")
def created_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = corpus.scratch_folder(spark)
    corpus.append_chunks(text_corpus(spark, sf_dir).select("id", "law_name"), folder)
    return spark.read.parquet(folder).groupBy("law_name").agg(F.count("*").alias("n"), F.count_if(F.col("created_at") <= F.current_timestamp()).alias("stamped"))


@query("reset_collection", "SELECT count(*) AS rows_before, CAST(0 AS BIGINT) AS rows_after FROM documents")
def reset_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "collection_" + uuid.uuid4().hex
    rows = text_corpus(spark, sf_dir).select("id", "law_name")
    rows.write.saveAsTable(name)
    before = spark.table(name).count()
    corpus.reset_collection(spark, name, rows.schema)
    after = spark.table(name).count()
    corpus.drop_collection(spark, name)
    return spark.createDataFrame([(before, after)], "rows_before long, rows_after long")


@query("upsert_corpus", "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN source ELSE upper(source) END AS law_name, text AS content, CAST(CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 2 END AS BIGINT) AS version FROM documents UNION ALL SELECT doc_id + 10000000, upper(source), text, CAST(CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 2 END AS BIGINT) FROM documents")
def upsert_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows come again under their own ids and under new ones, every fourth in an older version, through the table on disk."""
    d = table(spark, sf_dir, "documents").withColumnsRenamed({"source": "law_name", "text": "content"})
    old = d.select(F.col("doc_id").alias("id"), "law_name", "content", F.lit(1).cast("long").alias("version"))
    version = F.when(F.col("doc_id") % 4 == 0, 0).otherwise(2).cast("long")
    new = d.select(F.explode(F.array(F.col("doc_id"), F.col("doc_id") + 10_000_000)).alias("id"), F.upper("law_name").alias("law_name"), "content", version.alias("version"))
    root = corpus.scratch_folder(spark)
    corpus.upsert_table(spark, root, old, parts=8)
    corpus.upsert_table(spark, root, new)
    return corpus.current_table(spark, root, old.schema)


@query("collection_stats", f"WITH {SQL_LAW} SELECT count(*) AS n_rows, max(len(embedding)) AS dim FROM law")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.collection_stats(law_documents(spark, sf_dir))


@query("check_schema", f"WITH {SQL_LAW} SELECT count(*) - count(DISTINCT id) AS repeated_ids, count(*) FILTER (content IS NULL) AS null_content, count(*) FILTER (len(embedding) <> 32) AS bad_vectors FROM law")
def check_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.check_schema(law_documents(spark, sf_dir), 32)


# --- projections, filters ---------------------------------------------------------------
query("metadata_filter", f"WITH {SQL_TEXT} SELECT id FROM t WHERE law_name = 'src3' AND chunk_type = 'en'")(lambda s, d: corpus.metadata_filter(text_corpus(s, d), {"law_name": "src3", "chunk_type": "en"}).select("id"))
simple("like_filter", f"WITH {SQL_TEXT} SELECT id FROM t WHERE content LIKE '%t_k_n%'", lambda: ["id"], where=lambda: _content().like("%t_k_n%"))
simple("contains_filter", f"WITH {SQL_TEXT} SELECT id FROM t WHERE contains(content, 'token')", lambda: ["id"], where=lambda: F.contains("content", F.lit("token")))
query("metadata_project", f"WITH {SQL_TEXT} SELECT id, coalesce(nullif(title, ''), 'untitled') AS title, split_part(id, '_', 2) AS number, coalesce(chunk_type, 'article') AS kind FROM t")(lambda s, d: corpus.metadata_project(text_corpus(s, d)))
simple("require_fields", f"WITH {SQL_TEXT} SELECT id FROM t WHERE length(id) > 0 AND length(trim(title)) > 20", lambda: ["id"], where=lambda: (F.length("id") > 0) & (F.length(F.trim("title")) > 20))
simple("content_bounds", f"WITH {SQL_TEXT} SELECT id, substr(content, 1, 2000) AS content FROM t WHERE length(content) > 10", lambda: ["id", T.truncated(_content()).alias("content")], where=lambda: F.length("content") > 10)
simple("law_tier", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 4 = 3 THEN '시행규칙' WHEN doc_id % 4 = 1 THEN '시행령' ELSE '법률' END AS tier FROM documents", lambda: ["doc_id", T.tier(F.concat("law_name", F.when(F.col("doc_id") % 4 == 1, " 시행령").when(F.col("doc_id") % 4 == 3, " 시행규칙").otherwise(""), F.when(F.col("doc_id") % 3 == 0, " 시행규칙").otherwise(""))).alias("tier")])
_WORDY = "CASE doc_id % 8 WHEN 0 THEN '정의' WHEN 1 THEN ' 용어의 뜻' WHEN 2 THEN '벌칙' WHEN 3 THEN '과태료' WHEN 4 THEN '형' WHEN 5 THEN '징역' WHEN 6 THEN '벌금' END"


def _wordy() -> Column:
    """A title with a word of the domain behind it; every eighth is null."""
    words = F.element_at(F.array(*map(F.lit, ("정의", " 용어의 뜻", "벌칙", "과태료", "형", "징역", "벌금", None))), (F.col("doc_id") % 8 + 1).cast("int"))
    return F.concat(_title(), words)


simple("is_definition", f"WITH {SQL_TEXT} SELECT id, coalesce(regexp_matches(title || {_WORDY}, '정의|용어|뜻'), false) AS found FROM t", lambda: ["id", T.is_definition(_wordy()).alias("found")])
simple("is_penalty", f"WITH {SQL_TEXT} SELECT id, coalesce(regexp_matches(title || {_WORDY}, '벌칙|과태료|형|징역|벌금'), false) AS found FROM t", lambda: ["id", T.is_penalty(_wordy()).alias("found")])
simple("law_name_filter", f"WITH {SQL_TEXT} SELECT id FROM t WHERE law_name = 'src7'", lambda: ["id"], where=lambda: F.col("law_name") == "src7")


@query("valid_query", "WITH q AS (SELECT row_number() OVER () AS n, text AS query FROM conversations) SELECT count(*) FILTER (length(trim(query)) > 0) AS valid, count(*) FILTER (coalesce(length(trim(query)) = 0, true)) AS rejected FROM q")
def valid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "conversations").select(F.col("text").alias("query"))
    return search.valid_queries(q).select(F.lit(1).alias("v"), F.lit(0).alias("r")).union(search.rejected_queries(q).select(F.lit(0), F.lit(1))).agg(F.coalesce(F.sum("v"), F.lit(0)).alias("valid"), F.coalesce(F.sum("r"), F.lit(0)).alias("rejected"))


# --- aggregations ------------------------------------------------------------------------
@query("count_rows", "SELECT count(*) AS n FROM documents WHERE contains(text, 'token')")
def count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_corpus(spark, sf_dir).filter(F.contains("content", F.lit("token"))).agg(F.count("*").alias("n"))


@query("conditional_counts", "SELECT count(*) AS n, count(*) FILTER (contains(text, 'token')) AS tokens, count(*) FILTER (contains(text, 'password')) AS passwords FROM documents")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_corpus(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.contains("content", F.lit("token"))).alias("tokens"), F.count_if(F.contains("content", F.lit("password"))).alias("passwords"))


@query("count_by_law", "SELECT coalesce(source, 'Unknown') AS law_name, count(*) AS n FROM documents GROUP BY 1")
def count_by_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.count_by(text_corpus(spark, sf_dir))


@query("avg_content_length", "SELECT source AS law_name, round(avg(length(text))) AS mean_length FROM documents GROUP BY 1")
def avg_content_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_corpus(spark, sf_dir).groupBy("law_name").agg(F.round(F.avg(F.length("content"))).alias("mean_length"))


@query("term_coverage", "SELECT source AS law_name, term, count(*) FILTER (contains(text, term)) AS n, round(100.0 * count(*) FILTER (contains(text, term)) / count(*), 1) AS percent FROM documents, (VALUES " + _values([(t,) for t in TERMS]) + ") v(term) GROUP BY 1, 2")
def term_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.term_coverage(text_corpus(spark, sf_dir), TERMS)


@query("distinct_laws", "SELECT DISTINCT source AS law_name FROM documents WHERE source <> ''")
def distinct_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_corpus(spark, sf_dir).filter("law_name <> ''").select("law_name").distinct()


query("distinct", "SELECT DISTINCT lang, source FROM documents")(lambda s, d: table(s, d, "documents").select("lang", "source").distinct())


@query("occurrence_totals", f"WITH {SQL_TEXT} SELECT law_name, sum((length(content) - length(replace(content, 'the', ''))) / 3) AS total FROM t GROUP BY 1")
def occurrence_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.occurrence_totals(text_corpus(spark, sf_dir), "the")


@query("ingest_tally", "SELECT source AS law_name, count(*) FILTER (length(text) > 10) AS success, count(*) FILTER (NOT length(text) > 10) AS failed FROM documents GROUP BY ROLLUP (source)")
def ingest_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.ingest_tally(text_corpus(spark, sf_dir), F.length("content") > 10)


@query("max_score", f"WITH {SQL_TEXT}, {SQL_BATCH}, {SQL_HITS} SELECT qid, greatest(max(score), 0.0001) AS max_score FROM h GROUP BY qid")
def max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keyword_hits(text_corpus(spark, sf_dir), batch(spark)).groupBy("qid").agg(F.greatest(F.max("score"), F.lit(1e-4)).alias("max_score"))


SQL_EVAL = f"""WITH {SQL_TEXT}, q(qid, query, expected_min) AS (SELECT * FROM (VALUES {_values(EXPECTED)})), {SQL_HITS}, {SQL_RANKED},
 f AS (SELECT qid, count(*) AS found FROM r WHERE rank <= 20 GROUP BY qid), e AS (SELECT q.*, coalesce(found, 0) AS found, coalesce(found, 0) >= expected_min AS passed FROM q LEFT JOIN f USING (qid)) """


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.evaluate(text_corpus(spark, sf_dir), spark.createDataFrame(EXPECTED, "qid long, query string, expected_min long"))


query("eval_expectations", SQL_EVAL + "SELECT qid, query, CAST(expected_min AS BIGINT) AS expected_min, found, passed FROM e")(lambda s, d: _evaluated(s, d).select("qid", "query", "expected_min", "found", "passed"))
SQL_VERDICT = SQL_EVAL + "SELECT count(*) FILTER (passed) AS n_passed, count(*) AS n, count(*) FILTER (passed) / count(*) AS rate, CASE WHEN count(*) FILTER (passed) = count(*) THEN 'pass' WHEN count(*) FILTER (passed) / count(*) >= 0.75 THEN 'warn' ELSE 'fail' END AS verdict FROM e"
query("pass_rate", SQL_EVAL + "SELECT count(*) FILTER (passed) AS n_passed, count(*) AS n, count(*) FILTER (passed) / count(*) AS rate FROM e")(lambda s, d: search.verdict(_evaluated(s, d)).select("n_passed", "n", "rate"))
query("evaluate_search_details", SQL_EVAL + """, m AS (SELECT r.qid, rank, r.id, coalesce(law_name, 'Unknown') AS name FROM r JOIN t ON r.id = t.id WHERE rank <= 20), bl AS (SELECT qid, string_agg(name || ':' || n, ',' ORDER BY name) AS by_law FROM (SELECT qid, name, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1)
 SELECT e.qid, e.found, coalesce(by_law, '') AS by_law, CASE WHEN e.found > 0 THEN '법률:' || e.found ELSE '' END AS by_tier, coalesce((SELECT string_agg(id, ',' ORDER BY rank) FROM m WHERE m.qid = e.qid AND rank <= 3), '') AS top_hits FROM e LEFT JOIN bl ON bl.qid = e.qid""")(
    lambda s, d: _evaluated(s, d).select("qid", "found", *(F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit(":"), x["n"].cast("string"))), ",").alias(c) for c in ("by_law", "by_tier")), F.array_join("top_hits", ",").alias("top_hits"))
)
query("evaluate_search", SQL_VERDICT)(lambda s, d: search.verdict(_evaluated(s, d)))

SQL_INDEX = f"""w AS (SELECT id, list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '') AS words FROM t),
 st AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM w), post AS (SELECT term, id, count(*) AS tf, max(dl) AS dl FROM (SELECT id, len(words) AS dl, unnest(words) AS term FROM w) GROUP BY 1, 2),
 dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1), raw AS (SELECT term, df, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, st),
 tm AS (SELECT term, df, n, avgdl, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
SQL_SCORED = SQL_INDEX + """,
 qt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest(string_split(query, ' ')) AS term FROM q) GROUP BY 1, 2),
 kh AS (SELECT qid, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN tm USING (term) JOIN post USING (term) GROUP BY 1, 2),
 kr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM kh) """
SQL_BM25 = f"WITH {SQL_TEXT}, {SQL_ASKED}, {SQL_SCORED}"
SQL_VCORPUS = "vc AS (SELECT 'doc_' || vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings WHERE embedding IS NOT NULL)"
SQL_VEC = f", {SQL_VCORPUS}, vh AS (SELECT qid, id, list_cosine_similarity(embedding, qvec) AS similarity FROM vc, q), vr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(similarity, 9) DESC NULLS LAST, id) AS rank FROM vh) "


SQL_TERMS = """w AS (SELECT list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS words FROM documents), st AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM w),
 dfs AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(words)) AS term FROM w) GROUP BY 1), raw AS (SELECT term, df, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, st), mn AS (SELECT avg(raw) AS mean FROM raw)"""


@query("bm25_corpus_stats", f"WITH {SQL_TERMS} SELECT term, df, n, round(avgdl, 6) AS avgdl, round(CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END, 6) AS idf FROM raw, mn")
def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.term_statistics(text_corpus(spark, sf_dir)), "avgdl", "idf")


simple("doc_length", f"WITH {SQL_TEXT} SELECT id, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')) AS n FROM t", lambda: ["id", long(F.size(T.tokens(_content()))).alias("n")])
simple("tokenize_ws", f"WITH {SQL_TEXT} SELECT id, list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '') AS words FROM t", lambda: ["id", T.tokens(_content()).alias("words")])
simple("vector_norms", "SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings", lambda: ["vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm")], source="embeddings")


# --- search arms, ranks, fusion ------------------------------------------------------------
def _keyword(k: int, factor: float = 1.0) -> Query:
    return lambda s, d: search.keyword_search(text_corpus(s, d), batch(s), k, factor)


SQL_KEYWORD = f"WITH {SQL_TEXT}, {SQL_BATCH}, {SQL_HITS}, {SQL_RANKED} "
query("keyword_search", SQL_KEYWORD + "SELECT qid, id, score, rank FROM r WHERE rank <= 100")(_keyword(100))
query("keyword_topk", SQL_KEYWORD + "SELECT qid, id, score, rank FROM r WHERE rank <= 10")(_keyword(10))
query("candidate_overfetch", SQL_KEYWORD + "SELECT qid, id, score, rank FROM r WHERE rank <= 20")(_keyword(20))
query("keyword_search_x10", SQL_KEYWORD + "SELECT qid, id, score * 10 AS score, rank FROM r WHERE rank <= 100")(_keyword(100, 10.0))
query("keyword_theta_join", f"WITH {SQL_TEXT}, {SQL_BATCH}, {SQL_HITS} SELECT qid, id, score FROM h")(lambda s, d: search.keyword_hits(text_corpus(s, d), batch(s)))
query("occurrence_score", f"WITH {SQL_TEXT} SELECT id, (length(content) - length(replace(content, 'th', ''))) / 2 AS score FROM t")(lambda s, d: text_corpus(s, d).select("id", T.occurrences(_content(), F.lit("th")).alias("score")))
query("score_share", SQL_KEYWORD + "SELECT qid, id, round(100 * score / greatest(max(score) OVER (PARTITION BY qid), 0.0001), 6) AS share FROM r WHERE rank <= 100")(lambda s, d: rounded(search.with_share(_keyword(100)(s, d)).select("qid", "id", "share"), "share"))
query("normalized_score", SQL_KEYWORD + "SELECT qid, id, CAST(least(100, round(100 * score / greatest(max(score) OVER (PARTITION BY qid), 0.0001))) AS BIGINT) AS shown FROM r WHERE rank <= 20")(lambda s, d: search.with_share(_keyword(20)(s, d)).select("qid", "id", long(F.least(F.lit(100), F.round("share"))).alias("shown")))
query("positive_score", f"WITH {SQL_TEXT} SELECT id, (length(content) - length(replace(content, 'tion', ''))) / 4 AS score FROM t WHERE contains(content, 'tion')")(lambda s, d: text_corpus(s, d).select("id", T.occurrences(_content(), F.lit("tion")).alias("score")).filter("score > 0"))
query("list_rank", SQL_KEYWORD + "SELECT qid, rank, id FROM r WHERE rank <= 50")(lambda s, d: _keyword(50)(s, d).select("qid", "rank", "id"))


@query("substring_index_search", f"WITH {SQL_TEXT}, {SQL_ASKED}, {SQL_HITS}, {SQL_RANKED} SELECT qid, id, score, rank FROM r WHERE rank <= 100")
def substring_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search for the stated queries by a saved index of trigrams."""
    docs = text_corpus(spark, sf_dir).select("id", "content")
    index = substring.TrigramIndex.build(docs, corpus.scratch_folder(spark))
    return search.keyword_search(docs, asked(spark, sf_dir), 100, index=index)


def _vectors(k: int, metric: str = "cosine") -> Query:
    return lambda s, d: rounded(search.vector_search(corpus.vectors(s, d), vector_probes(s, d), k, metric), "similarity")


SQL_V = f"WITH {SQL_VPROBES}" + SQL_VEC
query("vector_search", SQL_V + "SELECT qid, id, round(similarity, 6) AS similarity, rank FROM vr WHERE rank <= 10")(_vectors(10))
query("semantic_rank", SQL_V + "SELECT qid, id, rank FROM vr WHERE rank <= 100")(lambda s, d: _vectors(100)(s, d).select("qid", "id", "rank"))


@query("vector_cross_join", SQL_V + "SELECT qid, id, round(similarity, 6) AS similarity FROM vh")
def vector_cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries against all rows, unranked."""
    return rounded(search.all_similarities(corpus.vectors(spark, sf_dir), vector_probes(spark, sf_dir)), "similarity")


simple("cosine_similarity", "SELECT vec_id, round(list_cosine_similarity(v, list_reverse(v)), 6) AS similarity, round(1 - list_cosine_similarity(v, list_reverse(v)), 6) AS distance FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)", lambda: ["vec_id", F.round(V.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("similarity"), F.round(V.cosine_distance(F.col("embedding"), F.reverse("embedding")), 6).alias("distance")], source="embeddings")
query("l2sq_distance", f"WITH {SQL_VPROBES}, {SQL_VCORPUS}, vh AS (SELECT qid, id, 1 - list_sum(list_transform(range(1, 65), lambda i: (embedding[i] - qvec[i]) ** 2)) AS similarity FROM vc, q), vr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(similarity, 9) DESC, id) AS rank FROM vh) SELECT qid, id, round(similarity, 6) AS similarity, rank FROM vr WHERE rank <= 10")(_vectors(10, "l2sq"))


_INDEXES: dict[tuple[str, str, str], search.Bm25Index | search.PostingIndex] = {}


def _index(spark: SparkSession, sf_dir: str, kind: str) -> search.Bm25Index | search.PostingIndex:
    """The saved index of the texts, built once a session: searches take it, as they do in use."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _INDEXES:
        _INDEXES[key] = (search.Bm25Index.build if kind == "bm25" else search.text_index)(text_corpus(spark, sf_dir))
    return _INDEXES[key]


def bm25(spark: SparkSession, sf_dir: str) -> search.Bm25Index:
    return _index(spark, sf_dir, "bm25")  # type: ignore[return-value]


def places(spark: SparkSession, sf_dir: str) -> search.PostingIndex:
    return _index(spark, sf_dir, "places")  # type: ignore[return-value]


@query("bm25_search", SQL_BM25 + "SELECT qid, id, round(score, 6) AS score, rank FROM kr WHERE rank <= 20 AND score > 0")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bm25(spark, sf_dir).search(asked(spark, sf_dir), 20), "score")


@query("bm25_topk", SQL_BM25 + "SELECT qid, id, rank FROM kr WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From all scores, those of zero or less too."""
    return search.ranked(bm25(spark, sf_dir).scores(asked(spark, sf_dir), k=10), "score", 10).select("qid", "id", "rank")


@query("bm25_score", SQL_BM25 + "SELECT qid, id, round(score, 6) AS score FROM kh")
def bm25_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(spark, sf_dir).scores(asked(spark, sf_dir), digits=6)


@query("bm25_term_join", SQL_BM25 + "SELECT qid, id, term, times, tf, CAST(dl AS BIGINT) AS dl FROM qt JOIN post USING (term)")
def bm25_term_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(spark, sf_dir).matches(asked(spark, sf_dir)).select("qid", "id", "term", "times", "tf", "dl")


SQL_FUSED = f"WITH {SQL_TEXT}, {SQL_PROBES}, {SQL_SCORED}" + SQL_VEC + """, u AS (SELECT qid, id, 0.7 / (60 + rank) AS part, rank AS vector_rank, NULL AS keyword_rank FROM vr WHERE rank <= 20 UNION ALL SELECT qid, id, 0.3 / (60 + rank), NULL, rank FROM kr WHERE rank <= 20 AND score > 0),
 fu AS (SELECT qid, id, sum(part) AS fused, max(vector_rank) AS vector_rank, max(keyword_rank) AS keyword_rank FROM u GROUP BY 1, 2) """


def _arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q, _ = batches.held(probes(spark, sf_dir))
    return q, search.vector_search(corpus.vectors(spark, sf_dir), q, 20), bm25(spark, sf_dir).search(q, 20)


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuse_by_sum(*_arms(spark, sf_dir)[1:])


query("fuse_union_sum", SQL_FUSED + "SELECT qid, id, round(fused, 6) AS fused, vector_rank, keyword_rank FROM fu")(lambda s, d: rounded(_fused(s, d), "fused"))
query("rrf_python", SQL_FUSED + "SELECT qid, id, round(sum(w / (10 + rank)), 6) AS fused FROM (SELECT qid, id, 0.5 AS w, rank FROM vr WHERE rank <= 20 UNION ALL SELECT qid, id, 0.5, rank FROM kr WHERE rank <= 20 AND score > 0) GROUP BY 1, 2")(lambda s, d: rounded(search.fuse_by_sum(*_arms(s, d)[1:], k=10, weights=(0.5, 0.5)).select("qid", "id", "fused"), "fused"))
query("fusion_topk", SQL_FUSED + "SELECT * FROM (SELECT qid, id, round(fused, 6) AS fused, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 9) DESC, id) AS rank FROM fu) WHERE rank <= 10")(lambda s, d: rounded(search.ranked(_fused(s, d).select("qid", "id", "fused"), "fused", 10), "fused"))
query("lookup_payload", SQL_FUSED + "SELECT qid, id, law_name, content FROM fu JOIN t USING (id)")(lambda s, d: text_corpus(s, d).select("id", "law_name", "content").join(F.broadcast(_fused(s, d).select("qid", "id")), "id"))
SQL_HYBRID = SQL_FUSED + """, b AS (SELECT qid, id, query, fused, title, law_name, content, fused + CASE WHEN len(list_filter(string_split(query, ' '), lambda x: contains(title, x))) > 0 THEN 10.0 ELSE 0.0 END
 + CASE chunk_type WHEN 'en' THEN 5.0 WHEN 'de' THEN 3.0 WHEN 'fr' THEN 2.0 WHEN 'es' THEN 1.0 ELSE 0.0 END + CASE WHEN is_definition THEN 3.0 ELSE 0.0 END AS final FROM fu JOIN t USING (id) JOIN q USING (qid) LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS is_definition FROM labels GROUP BY 1) l USING (doc_id)),
 br AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(final, 9) DESC, round(fused, 9) DESC, id) AS rank FROM b) """
query("rule_rerank", SQL_HYBRID + "SELECT qid, id, round(final, 6) AS final, rank FROM br")(lambda s, d: rounded(search.rerank(_fused(s, d), text_corpus(s, d), probes(s, d), BOOSTS, corpus.definitions(s, d)).select("qid", "id", "final", "rank"), "final"))
query("rerank_sort", SQL_HYBRID + "SELECT qid, id, rank FROM br WHERE rank <= 10")(lambda s, d: search.rerank(_fused(s, d), text_corpus(s, d), probes(s, d), BOOSTS, corpus.definitions(s, d)).filter("rank <= 10").select("qid", "id", "rank"))


@query("hybrid_search", SQL_HYBRID + "SELECT qid, id, law_name, round(final, 6) AS final, rank, list_reduce(list_filter(string_split(query, ' '), lambda x: length(x) > 1), lambda a, k: replace(a, k, '<mark>' || k || '</mark>'), content) AS highlighted FROM br WHERE rank <= 10")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_hybrid(spark, sf_dir).select("qid", "id", "law_name", "final", "rank", "highlighted"), "final")


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_search(text_corpus(spark, sf_dir), probes(spark, sf_dir), 10, BOOSTS, index=bm25(spark, sf_dir), vectors=corpus.vectors(spark, sf_dir), flags=corpus.definitions(spark, sf_dir))


SQL_WITHIN = f"""WITH {SQL_TEXT}, {SQL_PROBES}, {SQL_SCORED.replace("row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM kh", "row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM kh SEMI JOIN (SELECT id FROM t WHERE chunk_type = 'en') USING (id)")}
 , {SQL_VCORPUS}, vh AS (SELECT qid, id, list_cosine_similarity(embedding, qvec) AS similarity FROM vc SEMI JOIN (SELECT id FROM t WHERE chunk_type = 'en') USING (id), q), vr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(similarity, 9) DESC NULLS LAST, id) AS rank FROM vh)
 SELECT qid, id, round(sum(part), 6) AS fused FROM (SELECT qid, id, 0.7 / (60 + rank) AS part FROM vr WHERE rank <= 20 UNION ALL SELECT qid, id, 0.3 / (60 + rank) FROM kr WHERE rank <= 20 AND score > 0) GROUP BY 1, 2"""


@query("hybrid_search_filtered", SQL_WITHIN)
def hybrid_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on both arms; k is such that all fused candidates are seen."""
    best = search.hybrid_search(text_corpus(spark, sf_dir), probes(spark, sf_dir), 10, BOOSTS, index=bm25(spark, sf_dir), vectors=corpus.vectors(spark, sf_dir), flags=corpus.definitions(spark, sf_dir), where=F.col("chunk_type") == "en", cut=40)
    return rounded(best.select("qid", "id", "fused"), "fused")


def sql_lexemes(text: str) -> str:
    """Typed lexemes of a column, taken to pieces by SQL; a text with words alone is split between them."""
    page, skipped, hyphenated = lexemes.IS_PAGE, lexemes.IS_SKIPPED, lexemes.IS_HYPHENATED
    kinds = f"WHEN NOT regexp_matches(x, '[^\\p{{L}}\\p{{N}}]') THEN [x] WHEN regexp_matches(x, '{skipped}') THEN [] WHEN regexp_matches(x, '{page}') THEN [x, regexp_extract(x, '{page}', 1), regexp_extract(x, '{page}', 2)]"
    typed = f"flatten(list_transform(regexp_extract_all(lower({text}), '{lexemes.TOKEN}'), lambda x: CASE {kinds} WHEN regexp_matches(x, '{hyphenated}') THEN list_concat([x], string_split(x, '-')) ELSE [x] END))"
    plain = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    return f"CASE WHEN regexp_matches(lower({text}), '[<&@/]|[.][a-z0-9]|[+-][\\p{{L}}\\p{{N}}]') THEN {typed} ELSE {plain} END"


SQL_LEX = f"""ql AS (SELECT qid, list_distinct({sql_lexemes('query')}) AS lex FROM q), wl AS (SELECT qid, len(lex) AS need, unnest(lex) AS word FROM ql WHERE len(lex) > 0),
 toks AS (SELECT id, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM (SELECT id, {sql_lexemes('content')} AS l FROM t)),
 pl AS (SELECT qid, id, need, toks.word, pos FROM toks JOIN wl USING (word)), fd AS (SELECT qid, id, max(need) AS need, count(*) AS n FROM pl GROUP BY 1, 2 HAVING count(DISTINCT word) = max(need)),
 sg AS (SELECT qid, id, 0.1 * list_sum(list_transform(range(1, n + 1), lambda j: 1.0 / (j * j))) / 1.64493406685 AS score FROM fd WHERE need = 1),
 mu AS (SELECT a.qid, a.id, 1 - exp(sum(ln(1 - 0.1 * sqrt(1 / (1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5 - 2)))))) AS score FROM pl a JOIN pl b ON a.qid = b.qid AND a.id = b.id AND a.word < b.word AND abs(a.pos - b.pos) <= 100 GROUP BY 1, 2),
 th AS (SELECT * FROM sg UNION ALL SELECT fd.qid, fd.id, coalesce(score, 0) FROM fd LEFT JOIN mu ON fd.qid = mu.qid AND fd.id = mu.id WHERE need > 1),
 tr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM th) """
SQL_TS = f"WITH {SQL_TEXT}, {SQL_ASKED}, {SQL_LEX}"
query("ts_rank", SQL_TS + "SELECT qid, id, round(score, 6) AS score FROM th")(lambda s, d: search.text_rank(text_corpus(s, d), asked(s, d), places(s, d), digits=6))
query("keyword_rank", SQL_TS + "SELECT qid, id, rank FROM tr WHERE rank <= 100")(lambda s, d: search.ranked(search.text_rank(text_corpus(s, d), asked(s, d), places(s, d), 100), "score", 100).select("qid", "id", "rank"))
query("ts_match", f"WITH {SQL_TEXT} SELECT id, len(list_intersect({sql_lexemes('content')}, ['the', 'thing'])) = 2 AS matched FROM t")(lambda s, d: text_corpus(s, d).select("id", T.matches_all(_content(), F.lit("The thing!")).alias("matched")))
# Each text's id in an address, a mail address, compounds and numbers behind its law's name; the oracle lays out what must come of them.
query("typed_lexemes", """SELECT 'doc_' || doc_id AS id, array_to_string(list_concat(list_filter(regexp_split_to_array(lower(coalesce(source, '')), '[^a-z0-9]+'), lambda x: x <> ''),
 ['www.law' || doc_id || '.go.kr/a/' || doc_id || '?v=1', 'www.law' || doc_id || '.go.kr', '/a/' || doc_id || '?v=1', 'desk.' || doc_id || '@office.go.kr', '수소-안전' || doc_id, '수소', '안전' || doc_id, '-' || doc_id, '1.' || doc_id || '.2', 'a', '제' || doc_id || '조']), '|') AS lexemes FROM documents""")(
    lambda s, d: table(s, d, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"),
        F.array_join(T.lexemes(F.concat(F.regexp_replace(F.coalesce("source", F.lit("")), "[^A-Za-z0-9]+", " "), F.replace(F.lit(" <p class='x'>HTTPS://www.law#.go.kr/A/#?v=1 Desk.#@office.go.kr, 수소-안전# -# 1.#.2 &amp; A&lt;제#조(…)</p>"), F.lit("#"), F.col("doc_id").cast("string")))), "|").alias("lexemes"),
    )
)
SQL_OUTER = f"WITH {SQL_TEXT}, {SQL_PROBES}, {SQL_LEX}" + SQL_VEC + """, fo AS (SELECT coalesce(v.qid, k.qid) AS qid, coalesce(v.id, k.id) AS id, v.rank AS semantic_rank, k.rank AS keyword_rank, 100 * (0.7 / (60 + coalesce(v.rank, 999999)) + 0.3 / (60 + coalesce(k.rank, 999999))) AS relevance
 FROM (SELECT * FROM vr WHERE rank <= 20) v FULL OUTER JOIN (SELECT * FROM tr WHERE rank <= 20) k ON v.qid = k.qid AND v.id = k.id) """


def _outer(spark: SparkSession, sf_dir: str, **how: object) -> DataFrame:
    q, _ = batches.held(probes(spark, sf_dir))
    return search.fuse_full_outer(search.vector_search(corpus.vectors(spark, sf_dir), q, 20), search.ranked(search.text_rank(text_corpus(spark, sf_dir), q, places(spark, sf_dir), 20), "score", 20), **how)


query("fuse_full_outer", SQL_OUTER + "SELECT qid, id, semantic_rank, keyword_rank, round(relevance, 6) AS relevance FROM fo")(lambda s, d: rounded(_outer(s, d), "relevance"))
query("rrf_sql", SQL_OUTER + "SELECT qid, id, round(100 * (0.4 / (10 + coalesce(semantic_rank, 1000)) + 0.6 / (10 + coalesce(keyword_rank, 1000))), 6) AS relevance FROM fo")(lambda s, d: rounded(_outer(s, d, k=10, weights=(0.4, 0.6), absent=1000).select("qid", "id", "relevance"), "relevance"))
query("hybrid_search_sql", SQL_OUTER + "SELECT * FROM (SELECT qid, id, semantic_rank, keyword_rank, round(relevance, 6) AS relevance, row_number() OVER (PARTITION BY qid ORDER BY round(relevance, 9) DESC, id) AS rank FROM fo) WHERE rank <= 10")(lambda s, d: rounded(search.hybrid_search_sql(text_corpus(s, d), probes(s, d), 10, corpus.vectors(s, d), places(s, d)), "relevance"))
SQL_WEB = SQL_KEYWORD + """, wb AS (SELECT qid, query, rank, id, score, round(100 * score / greatest(max(score) OVER (PARTITION BY qid), 0.0001), 6) AS relevance_score, coalesce(nullif(law_name, ''), '수소경제육성및수소안전관리에관한법률') AS law_name,
 split_part(id, '_', 2) AS article_number, coalesce(title, '') AS title, content, coalesce(nullif(chunk_type, ''), 'article') AS article_type, list_filter(string_split(query, ' '), lambda x: length(x) > 1) AS keywords FROM r JOIN t USING (id) JOIN q USING (qid) WHERE rank <= 100) """
SQL_BODY = "regexp_replace(regexp_replace(list_reduce(list_filter(regexp_split_to_array(trim(query), '[\\s,]+'), lambda x: x <> ''), lambda a, k: regexp_replace(a, '(?i)(' || k || ')', '<mark style=\"background-color: #fef08a; padding: 2px 4px; border-radius: 2px;\">\\1</mark>', 'g'), content), '\\n\\n+', '<br><br>', 'g'), '\\n', ' ', 'g')"
query("web_search", SQL_WEB + f"SELECT qid, query, rank, id, law_name, article_number, title, content, {SQL_BODY} AS highlighted_content, relevance_score, article_type, score, keywords FROM wb")(lambda s, d: rounded(search.web_search(text_corpus(s, d), batch(s)), "relevance_score"))
SQL_LAWS = "lw AS (SELECT qid, string_agg(law_name, ',' ORDER BY r) AS laws FROM (SELECT qid, law_name, min(rank) AS r FROM wb GROUP BY 1, 2) GROUP BY 1)"


def _flat(found: DataFrame, *extra: str) -> DataFrame:
    """A response's articles as rows, with its header."""
    rows = found.select("qid", "query", "total_found", F.array_join("keywords", ",").alias("keywords"), F.array_join("relevant_laws", ",").alias("laws"), "metadata.search_method", *extra, F.explode("articles").alias("a"))
    return rounded(rows.select("qid", "query", "total_found", "keywords", "laws", "search_method", *extra, *(f"a.{c}" for c in search.ARTICLE_FIELDS)), "relevance_score")


query("format_response", SQL_WEB + f", {SQL_LAWS} SELECT qid, query, count(*) OVER (PARTITION BY qid) AS total_found, array_to_string(keywords, ',') AS keywords, laws, 'keyword' AS search_method, rank, id, law_name, article_number, title, content, {SQL_BODY} AS highlighted_content, relevance_score, article_type, CAST([] AS VARCHAR[]) AS related_articles FROM wb JOIN lw USING (qid)")(
    lambda s, d: _flat(search.responses(search.web_search(text_corpus(s, d), batch(s))))
)
query(
    "format_hybrid_response",
    SQL_HYBRID + """, hb AS (SELECT qid, query, rank, id, law_name, split_part(id, '_', 2) AS article_number, title, content, round(final, 6) AS relevance_score, list_filter(string_split(query, ' '), lambda x: length(x) > 1) AS keywords FROM br WHERE rank <= 10),
 lw AS (SELECT qid, string_agg(law_name, ',' ORDER BY r) AS laws FROM (SELECT qid, law_name, min(rank) AS r FROM hb GROUP BY 1, 2) GROUP BY 1)
 SELECT qid, query, count(*) OVER (PARTITION BY qid) AS total_found, array_to_string(keywords, ',') AS keywords, laws, 'hybrid' AS search_method, CAST(0.7 AS DOUBLE) AS vector_weight, rank, id, law_name, article_number, title, content,
 list_reduce(keywords, lambda a, k: replace(a, k, '<mark>' || k || '</mark>'), content) AS highlighted_content, relevance_score, lang AS article_type, CAST([] AS VARCHAR[]) AS related_articles FROM hb JOIN lw USING (qid) JOIN (SELECT 'doc_' || doc_id AS id, lang FROM documents) USING (id)""",
)(lambda s, d: _flat(search.hybrid_responses(_hybrid(s, d)).withColumn("vector_weight", F.col("metadata.vector_weight")), "vector_weight"))

# --- windows, limits, sets ---------------------------------------------------------------
query("first_n_per_group", f"WITH {SQL_TEXT} SELECT id, law_name, rn FROM (SELECT *, row_number() OVER (PARTITION BY law_name ORDER BY id) AS rn FROM t) WHERE rn <= 3")(lambda s, d: corpus.first_per_group(text_corpus(s, d).select("id", "law_name"), "law_name", "id", 3))
query("sample_cap", f"WITH {SQL_TEXT} SELECT id FROM t ORDER BY id LIMIT 200")(lambda s, d: text_corpus(s, d).select("id").orderBy("id").limit(200))
query("union_all", "SELECT source AS name FROM documents UNION ALL SELECT url FROM pages")(lambda s, d: table(s, d, "documents").select(F.col("source").alias("name")).union(table(s, d, "pages").select("url")))


@query("compare_result_sets", f"WITH {SQL_TEXT}, a AS (SELECT id FROM t WHERE content LIKE '%to_en%'), b AS (SELECT id FROM t WHERE contains(content, 'token')) SELECT (SELECT count(*) FROM (SELECT id FROM a EXCEPT SELECT id FROM b)) AS only_like, (SELECT count(*) FROM (SELECT id FROM b EXCEPT SELECT id FROM a)) AS only_literal")
def compare_result_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text_corpus(spark, sf_dir)
    a, b = t.filter(_content().like("%to_en%")).select("id"), t.filter(F.contains("content", F.lit("token"))).select("id")
    return a.subtract(b).agg(F.count("*").alias("only_like")).crossJoin(b.subtract(a).agg(F.count("*").alias("only_literal")))


# --- text functions ------------------------------------------------------------------------
simple("remove_stopwords", f"WITH {SQL_TEXT} SELECT id, list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '') || ['법', '은것'] AS words FROM t", lambda: ["id", T.without_stopwords(T.tokens(F.concat(F.lit("은 "), _content(), F.lit(" 는 법 이 가 을 를 은것 의 에 와 과")))).alias("words")])
simple("legal_terms", f"WITH {SQL_TEXT} SELECT id, CASE doc_id % 4 WHEN 0 THEN ['설치기준', '수소충전소'] WHEN 1 THEN ['안전검사'] WHEN 2 THEN ['운영기준', '인증기준', '수소저장소'] ELSE CAST([] AS VARCHAR[]) END AS terms FROM t", lambda: ["id", T.legal_terms(F.concat(_content(), F.element_at(F.array(*map(F.lit, (" 수소충전소 설치", "검사를", "저장소 인증 운영", " 법"))), (F.col("doc_id") % 4 + 1).cast("int")))).alias("terms")])
simple("highlight_mark", f"WITH {SQL_TEXT} SELECT id, replace(replace(content, 'th', '<mark>th</mark>'), 'mark', '<mark>mark</mark>') AS body FROM t", lambda: ["id", T.highlight(_content(), F.array(F.lit("th"), F.lit("mark"))).alias("body")])
simple("highlight_ci", f"WITH {SQL_TEXT} SELECT id, regexp_replace(content, '(?i)(the)', '<mark style=\"background:#ff0\">\\1</mark>', 'g') AS body FROM t", lambda: ["id", T.highlight_ignoring_case(_content(), ["the"]).alias("body")])
simple("normalize_newlines", f"WITH {SQL_TEXT} SELECT id, regexp_replace(regexp_replace(content, '\\n\\n+', '<br><br>', 'g'), '\\n', ' ', 'g') AS body FROM t", lambda: ["id", T.normalized_newlines(_content()).alias("body")])
simple("split_keywords", f"WITH {SQL_TEXT} SELECT id, list_filter(regexp_split_to_array(trim(title), '[\\s,]+'), lambda x: x <> '') AS by_comma, list_filter(string_split(title, ' '), lambda x: length(x) > 1) AS by_space FROM t", lambda: ["id", T.keywords_by_comma(_title()).alias("by_comma"), T.keywords_by_space(_title()).alias("by_space")])
simple("kwic_snippet", f"WITH {SQL_TEXT} SELECT id, CASE WHEN instr(content, 'tion') > 0 THEN substr(content, greatest(1, instr(content, 'tion') - 30), least(length(content) + 1, instr(content, 'tion') + 35) - greatest(1, instr(content, 'tion') - 30)) END AS snippet FROM t", lambda: ["id", T.snippet(_content(), F.lit("tion"), 30, 35).alias("snippet")])
simple("preview", f"WITH {SQL_TEXT} SELECT id, CASE WHEN length(content) > 400 THEN left(content, 400) || '...' ELSE content END AS body FROM t", lambda: ["id", T.preview(_content(), 400).alias("body")])
simple("compose_metadata", f"WITH {SQL_TEXT} SELECT id, law_name, title AS label, true AS full_article FROM t", lambda: ["id", F.struct("law_name", _title().alias("label"), F.lit(True).alias("full_article")).alias("m")])
_compose = _QUERIES["compose_metadata"]
_QUERIES["compose_metadata"] = lambda s, d: _compose(s, d).select("id", "m.*")
SQL_ADDED = "CASE item_id % 3 WHEN 0 THEN ' 수소충전소 설치 제12조제3항' WHEN 1 THEN ' 검사를 제5조의2 제7조제1항제2호' ELSE ' 법' END"
query("query_plan_columns", f"SELECT item_id, q AS original, list_filter(regexp_split_to_array(q, '\\s+'), lambda x: x <> '') AS words, CASE item_id % 3 WHEN 0 THEN ['설치기준', '수소충전소'] WHEN 1 THEN ['안전검사'] ELSE CAST([] AS VARCHAR[]) END AS legal_terms, CASE item_id % 3 WHEN 0 THEN ['제12조제3항'] WHEN 1 THEN ['제5조', '제7조제1항제2호'] ELSE CAST([] AS VARCHAR[]) END AS article_refs FROM (SELECT item_id, text || {SQL_ADDED} AS q FROM benchmark)")(
    lambda s, d: search.query_plan(table(s, d, "benchmark").select("item_id", F.concat("text", F.element_at(F.array(*map(F.lit, (" 수소충전소 설치 제12조제3항", " 검사를 제5조의2 제7조제1항제2호", " 법"))), (F.col("item_id") % 3 + 1).cast("int"))).alias("original")), "original")
)



# --- statutes --------------------------------------------------------------------------------
SQL_ARTICLES = f"""WITH {SQL_STATUTE}, a AS (SELECT law_id, '제' || n || '조' AS article_number, trim(head) AS title, trim(text, chr(10) || chr(13) || chr(9) || ' ') AS content FROM s
 UNION ALL SELECT law_id, '제' || (CAST(n AS BIGINT) + 1) || '조', 'second', 'see 제' || n || '조제2항 and 제99조' FROM s) """


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.articles(statutes(spark, sf_dir).select("law_id", F.col("body").alias("text")))


query("segment_articles", SQL_ARTICLES + "SELECT law_id, article_number, title, substr(content, 1, 2000) AS content FROM a WHERE length(content) > 10")(lambda s, d: _articles(s, d).select("law_id", "article_number", "title", "content"))
query("segment_bounds", SQL_ARTICLES + "SELECT law_id, article_number, length(substr(content, 1, 2000)) AS n FROM a WHERE length(content) > 10")(lambda s, d: _articles(s, d).select("law_id", "article_number", long(F.length("content")).alias("n")))
query("first_wins_dedup", SQL_ARTICLES + ", b AS (SELECT *, row_number() OVER (PARTITION BY law_id, article_number ORDER BY title DESC) FROM a) SELECT law_id, article_number FROM b WHERE length(content) > 10")(lambda s, d: segment.articles(statutes(s, d).select("law_id", F.concat("body", F.lit("\n제"), "n", F.lit("조(again) a repeated article that loses")).alias("text"))).select("law_id", "article_number"))
query("extract_article_refs", SQL_ARTICLES + "SELECT law_id, article_number, list_sort(list_distinct(regexp_extract_all(content, '제[0-9]+조(?:제[0-9]+항)?(?:제[0-9]+호)?'))) AS refs FROM a WHERE length(content) > 10")(lambda s, d: _articles(s, d).select("law_id", "article_number", T.distinct_refs(_content()).alias("refs")))
query("article_reference_graph", SQL_ARTICLES + "SELECT law_id, article_number AS src, d AS dst, d <> '제99조' AND d IN (SELECT article_number FROM a b WHERE b.law_id = a.law_id AND length(b.content) > 10) AS resolved FROM a, (VALUES (1), (2)) v(k), LATERAL (SELECT CASE WHEN k = 1 THEN regexp_extract(content, '제[0-9]+조') ELSE '제99조' END AS d) WHERE title = 'second' AND content LIKE 'see %'")(lambda s, d: segment.reference_edges(_articles(s, d)))

#: Every document as a law of five articles, which refer to their next and to another one.
SQL_CITED = """c AS (SELECT 'law_' || doc_id AS law_id, '제' || i || '조' AS article_number, doc_id, i FROM documents, (VALUES (1), (2), (3), (4), (5)) v(i)),
 ed AS (SELECT DISTINCT law_id, article_number AS src, '제' || k || '조' AS dst FROM (SELECT *, unnest([i % 5 + 1, (doc_id * i + 1) % 5 + 1, 7]) AS k FROM c) WHERE k <> i AND k <> 7)"""
SQL_REACHED = f"""WITH RECURSIVE {SQL_CITED}, rc AS (SELECT law_id, article_number, article_number AS related, 0 AS distance FROM c WHERE i = doc_id % 5 + 1
 UNION ALL SELECT rc.law_id, rc.article_number, ed.dst, distance + 1 FROM rc JOIN ed ON ed.law_id = rc.law_id AND ed.src = rc.related WHERE distance < 2),
 rl AS (SELECT law_id, article_number, related, CAST(min(distance) AS BIGINT) AS distance FROM rc GROUP BY 1, 2, 3 HAVING min(distance) > 0)"""


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(law_id, article_number, content, i)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("law_"), F.col("doc_id").cast("string")).alias("law_id"), F.explode(F.array(*map(F.lit, range(1, 6)))).alias("i"))
    name = lambda k: F.concat(F.lit("제"), k.cast("string"), F.lit("조"))
    content = F.concat(name(F.col("i")), F.lit(" see "), name(F.col("i") % 5 + 1), F.lit("제2항, "), name((F.col("doc_id") * F.col("i") + 1) % 5 + 1), F.lit(" and 제7조"))
    return d.select("law_id", name(F.col("i")).alias("article_number"), content.alias("content"), "doc_id", "i")


query("article_degrees", f"WITH {SQL_CITED} SELECT law_id, article_number, (SELECT count(*) FROM ed WHERE ed.law_id = c.law_id AND src = article_number) AS n_out, (SELECT count(*) FROM ed WHERE ed.law_id = c.law_id AND dst = article_number) AS n_in FROM c")(
    lambda s, d: segment.degrees(segment.reference_edges(_cited(s, d)), _cited(s, d))
)
query("related_articles", SQL_REACHED + " SELECT * FROM rl")(lambda s, d: segment.related_articles(segment.reference_edges(_cited(s, d)), _cited(s, d).filter(F.col("i") == F.col("doc_id") % 5 + 1)))


@query("respond_with_related", f"""{SQL_REACHED}, h AS (SELECT law_id || '_' || article_number AS id, row_number() OVER (ORDER BY law_id || '_' || article_number) AS rank FROM c WHERE i = doc_id % 5 + 1)
 SELECT CAST(1 AS BIGINT) AS qid, rank, id, coalesce(string_agg(related, ',' ORDER BY related), '') AS related FROM h LEFT JOIN (SELECT law_id || '_' || article_number AS id, related FROM rl) USING (id) GROUP BY ALL""")
def respond_with_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response whose hits are one article of each law, with what each reaches in two hops."""
    rows = _cited(spark, sf_dir)
    ident = F.concat_ws("_", "law_id", "article_number").alias("id")
    docs = rows.filter(F.col("i") == F.col("doc_id") % 5 + 1).select(ident, F.lit("see 제").alias("content"), F.col("law_id").alias("law_name"), "article_number", F.lit("").alias("title"), F.lit("article").alias("chunk_type"), "law_id")
    found = search.web_search(docs, spark.createDataFrame([(1, "see 제")], "qid long, query string"), 10**6)
    related = segment.related_articles(segment.reference_edges(rows), docs.select("law_id", "article_number")).groupBy(ident).agg(F.sort_array(F.collect_list("related")).alias("related_articles"))
    articles = search.responses(found, related=related).select("qid", F.explode("articles").alias("a"))
    return articles.select("qid", "a.rank", "a.id", F.array_join("a.related_articles", ",").alias("related"))



SQL_MARKED = "replace(replace(chr(10) || text, chr(10) || 'T', chr(10) || '①T'), chr(10) || 'A', chr(10) || '②A')"
SQL_LINES = f"md AS (SELECT doc_id, {SQL_MARKED} AS text FROM documents), ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM md), l2 AS (SELECT doc_id, no, trim(line) AS line FROM ln WHERE trim(line) <> ''), g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[①-⑮]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS grp FROM l2)"
SQL_PARAGRAPHS = f"WITH {SQL_LINES}, m AS (SELECT doc_id, grp, string_agg(line, ' ' ORDER BY no) AS body FROM g WHERE grp > 0 GROUP BY 1, 2) SELECT doc_id, CAST(grp AS BIGINT) AS grp, substr(body, 1, 1) AS number, trim(substr(body, 2)) AS content FROM m"


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin with T or A get a circled number."""
    lines = F.concat(F.lit("\n"), F.col("text"))
    for letter, mark in (("T", "①"), ("A", "②")):
        lines = F.replace(lines, F.lit("\n" + letter), F.lit("\n" + mark + letter))
    return segment.paragraphs(table(spark, sf_dir, "documents").select("doc_id", lines.alias("text")), "doc_id", "text")


query("extract_paragraphs", SQL_PARAGRAPHS)(_paragraphs)
query("paragraph_groups", f"WITH {SQL_LINES} SELECT doc_id, CAST(max(grp) AS BIGINT) AS n FROM g WHERE grp > 0 GROUP BY doc_id")(lambda s, d: _paragraphs(s, d).groupBy("doc_id").agg(F.max("grp").alias("n")))
SQL_KINDS = "CASE WHEN regexp_matches(line, '^제[0-9]+장') THEN 'chapter' WHEN regexp_matches(line, '^제[0-9]+조') THEN 'article' WHEN regexp_matches(line, '^[①-⑮]') THEN 'paragraph' WHEN regexp_matches(line, '^[0-9]+[.]') THEN 'item' WHEN regexp_matches(line, '^[가-힣][.]') THEN 'subitem' ELSE 'body' END"
query("classify_line", f"SELECT doc_id, no, {SQL_KINDS} AS kind FROM (SELECT doc_id, no, ['제1장 ', '제2조 ', '③', '12. ', '가. ', ''][CAST((doc_id + no) % 6 + 1 AS BIGINT)] || line AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents))")(
    lambda s, d: table(s, d, "documents")
    .select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    .withColumn("no", long(F.col("at") + 1))
    .select("doc_id", "no", T.line_kind(F.concat(F.element_at(F.array(*map(F.lit, ("제1장 ", "제2조 ", "③", "12. ", "가. ", ""))), ((F.col("doc_id") + F.col("no")) % 6 + 1).cast("int")), "line")).alias("kind"))
)
SQL_WINDOWS = """w AS (SELECT key, text, 0 AS part, 0 AS start, 0 AS stop, '' AS chunk, false AS last FROM long
 UNION ALL SELECT key, text, part + 1, CASE WHEN last THEN NULL ELSE CASE WHEN part = 0 THEN 0 ELSE stop - 50 END END, e, substr(text, s + 1, e - s), e >= length(text) FROM (
  SELECT *, CASE WHEN s + 512 < length(text) AND cut > 0 AND s + cut - 50 > s THEN s + cut ELSE s + 512 END AS e FROM (
   SELECT *, CASE WHEN s + 512 < length(text) THEN length(regexp_extract(substr(text, s + 1, 512), '(?s)^.*[.\\n]')) ELSE 0 END AS cut FROM (SELECT *, CASE WHEN part = 0 THEN 0 ELSE stop - 50 END AS s FROM w WHERE NOT last)))),
 cuts AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY part) - 1 AS i, trim(chunk, chr(10) || chr(13) || chr(9) || ' ') AS chunk FROM w WHERE part > 0 AND trim(chunk, chr(10) || chr(13) || chr(9) || ' ') <> '')"""
SQL_SPLIT = f"WITH RECURSIVE long AS (SELECT doc_id AS key, text FROM documents WHERE length(text) >= 512), {SQL_WINDOWS} SELECT key AS doc_id, chunk FROM cuts"
query("split_long_text", SQL_SPLIT)(lambda s, d: table(s, d, "documents").filter(F.length("text") >= 512).select("doc_id", F.explode(segment.split_long_text(F.col("text"))).alias("chunk")))


def _laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles from documents; every third has its lines as paragraphs."""
    pars = F.when(F.col("doc_id") % 3 == 0, F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).cast("string").alias("number"), x.alias("content"))))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("law_"), "source").alias("law_id"), F.col("doc_id").cast("string").alias("article_number"), F.lit(None).cast("string").alias("title"), F.col("text").alias("content"), pars.alias("paragraphs"))


SQL_PAR = "par AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE doc_id % 3 = 0 AND {})"
query("chunk_articles", f"WITH RECURSIVE {SQL_PAR.format('length(text) >= 512')}, long AS (SELECT 'law_' || source || '_' || doc_id AS key, text FROM documents WHERE length(text) >= 512 AND doc_id % 3 <> 0), {SQL_WINDOWS} SELECT 'law_' || source || '_' || doc_id AS chunk_id, 'article' AS chunk_type, text AS content FROM documents WHERE length(text) < 512 UNION ALL SELECT 'law_' || source || '_' || doc_id || '_' || i, 'paragraph', line FROM par UNION ALL SELECT key || '_part' || i, 'text_split', chunk FROM cuts")(lambda s, d: segment.chunks(_laid_out(s, d)).select("chunk_id", "chunk_type", "content"))
SQL_WHOLE = "doc_id || ' ' || '' || chr(10) || text"
query("chunk_full_text", f"WITH {SQL_PAR.format(f'length({SQL_WHOLE}) >= 512')} SELECT CAST(doc_id AS VARCHAR) AS article_number, 'full_article' AS chunk_type, {SQL_WHOLE} AS content FROM documents WHERE length({SQL_WHOLE}) < 512 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'paragraph', doc_id || ' ' || i || chr(10) || line FROM par")(lambda s, d: segment.full_text_chunks(_laid_out(s, d)).select("article_number", "chunk_type", "content"))
query("chunk_table", "SELECT 'law_' || source || '_table_' || doc_id AS chunk_id, '별표' || doc_id AS article_number, text AS content FROM documents")(lambda s, d: segment.table_chunks(table(s, d, "documents").select(F.concat(F.lit("law_"), "source").alias("law_id"), F.col("doc_id").alias("n"), F.col("source").alias("title"), F.col("text").alias("content"))).select("chunk_id", "article_number", "content"))
@query("ingest_statutes", SQL_ARTICLES.replace("WITH ", "WITH RECURSIVE ", 1) + f", b AS (SELECT law_id || '_' || article_number AS key, substr(content, 1, 2000) AS text FROM a WHERE length(content) > 10), long AS (SELECT * FROM b WHERE length(text) >= 512), {SQL_WINDOWS} SELECT key AS id, 'article' AS kind, text AS content, CAST(64 AS BIGINT) AS dim FROM b WHERE length(text) < 512 UNION ALL SELECT key || '_part' || i, 'text_split', chunk, 64 FROM cuts")
def ingest_statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles, their chunks and vectors, appended to a new table."""
    articles = _articles(spark, sf_dir).withColumn("paragraphs", F.lit(None).cast("array<struct<number:string,content:string>>"))
    folder = corpus.scratch_folder(spark)
    corpus.append_chunks(segment.embed(segment.chunks(articles).withColumnRenamed("chunk_id", "id")), folder)
    return spark.read.parquet(folder).select("id", F.col("chunk_type").alias("kind"), "content", long(F.size("embedding")).alias("dim"))


@query("incremental_ingest", SQL_ARTICLES + "SELECT DISTINCT law_id, article_number, CAST(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version FROM a JOIN s USING (law_id) WHERE length(content) > 10 AND doc_id % 3 <> 2 AND (doc_id % 2 = 1 OR title <> 'second')")
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files arrive in three drops: all laws; a second version of every other law, which lacks
    its second article; and late, an old version.  Every third law ends without an article."""
    laws, folder = statutes(spark, sf_dir), corpus.scratch_folder(spark)
    drop = lambda rows, body, version: rows.select("law_id", body.alias("text"), F.lit(version).cast("long").alias("version")).write.mode("append").parquet(f"{folder}/in")
    first = F.concat(F.lit("제"), "n", F.lit("조("), "head", F.lit(") "), "text")
    for step in (
        lambda: drop(laws, F.col("body"), 1),
        lambda: drop(laws.filter("doc_id % 2 = 0"), first, 2),
        lambda: (drop(laws.filter("doc_id % 4 = 0"), F.col("body"), 0), drop(laws.filter("doc_id % 3 = 2"), F.lit("repealed"), 3)),
    ):
        step()
        rows = ingest.incremental_ingest(spark, f"{folder}/in", f"{folder}/table", f"{folder}/checkpoint", parts=8)
    return rows.select("law_id", "article_number", "version").distinct()


@query("full_refresh", SQL_ARTICLES + "SELECT law_id, article_number, CAST(CASE WHEN doc_id % 5 <> 0 THEN 2 ELSE 9 END AS BIGINT) AS version FROM a JOIN s USING (law_id) WHERE length(content) > 10 AND (doc_id % 5 <> 0 OR doc_id % 10 = 0)")
def full_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All laws arrive, every tenth in a late version; then a full drop lacks every fifth: those in an older version are gone."""
    laws, folder = statutes(spark, sf_dir).select("law_id", F.col("body").alias("text"), F.when(F.col("doc_id") % 10 == 0, 9).otherwise(1).cast("long").alias("version"), "doc_id"), corpus.scratch_folder(spark)
    laws.drop("doc_id").write.parquet(f"{folder}/in")
    ingest.incremental_ingest(spark, f"{folder}/in", f"{folder}/table", f"{folder}/checkpoint", parts=8)
    drop = laws.filter("doc_id % 5 <> 0").select("law_id", "text", F.lit(2).cast("long").alias("version"))
    return ingest.full_refresh(spark, drop, f"{folder}/table", parts=8).select("law_id", "article_number", "version").distinct()


query("compliance_match", "WITH r AS (SELECT DISTINCT lang AS business_type, source AS law FROM documents) SELECT r.business_type, r.law, CAST(k AS VARCHAR) AS article_number, EXISTS (SELECT 1 FROM documents d WHERE d.source = r.law AND d.doc_id % 50 = k) AS matched FROM r, (VALUES (1), (2), (60)) v(k)")(
    lambda s, d: segment.compliance(
        segment.load_rules(table(s, d, "documents").groupBy(F.col("lang").alias("business_type")).agg(F.transform(F.collect_set("source"), lambda x: F.struct(x.alias("law"), F.array(F.lit("1"), F.lit("2"), F.lit("60")).alias("articles"))).alias("required_laws"))),
        table(s, d, "documents").select(F.col("source").alias("law"), F.concat(F.lit("name "), "source").alias("law_name")).distinct(),
        table(s, d, "documents").select(F.concat(F.lit("name "), "source").alias("law_name"), (F.col("doc_id") % 50).cast("string").alias("article_number")),
    ).select("business_type", "law", "article_number", "matched")
)
query("load_rules", "SELECT DISTINCT lang AS business_type, source AS law, k AS article_number FROM documents, (VALUES ('1'), ('2')) v(k)")(
    lambda s, d: segment.load_rules(table(s, d, "documents").groupBy(F.col("lang").alias("business_type")).agg(F.transform(F.collect_set("source"), lambda x: F.struct(x.alias("law"), F.array(F.lit("1"), F.lit("2")).alias("articles"))).alias("required_laws")))
)
query(
    "corpus_report",
    f"WITH {SQL_TEXT}, f AS (SELECT law_name, id, content, row_number() OVER (PARTITION BY law_name ORDER BY id) AS rn FROM t), sm AS (SELECT law_name, string_agg(id, ',' ORDER BY id) AS samples, min(CASE WHEN rn = 1 THEN CASE WHEN length(content) > 100 THEN left(content, 100) || '...' ELSE content END END) AS preview FROM f WHERE rn <= 3 GROUP BY 1)"
    + " SELECT law_name, count(*) AS n, round(avg(length(content))) AS mean_length, term, count(*) FILTER (contains(content, term)) AS n_term, round(100.0 * count(*) FILTER (contains(content, term)) / count(*), 1) AS percent, any_value(samples) AS samples, any_value(preview) AS preview FROM t JOIN sm USING (law_name), (VALUES " + _values([(t,) for t in TERMS]) + ") v(term) GROUP BY law_name, term",
)(lambda s, d: corpus.report(text_corpus(s, d), TERMS).withColumn("c", F.explode("coverage")).select("law_name", "n", "mean_length", "c.term", F.col("c.n").alias("n_term"), "c.percent", F.array_join("samples.id", ",").alias("samples"), F.col("samples")[0]["preview"].alias("preview")))

# --- no SQL form: tests check these against brute force or properties --------------------------
query("embed_documents")(lambda s, d: segment.embed(text_corpus(s, d).select("id", "content")).select("id", "embedding"))
query("embed_documents_trained")(lambda s, d: segment.WordVectors(text_corpus(s, d)).embed(text_corpus(s, d).select("id", "content")).select("id", "embedding"))
query("embed_documents_semantic")(lambda s, d: semantic.SemanticVectors(text_corpus(s, d)).embed(text_corpus(s, d).select("id", "content")).select("id", "embedding"))


def _cells(spark: SparkSession, sf_dir: str) -> ann.CellIndex:
    folder = corpus.scratch_folder(spark)
    ann.CellIndex(corpus.vectors(spark, sf_dir), CELLS).save(folder)
    return ann.CellIndex.load(spark, folder)


#: Cells of the approximate index, how many of them a query probes by codes, and how many vectors it then
#: scores exactly: recall at 10 is at least 0.9 on the tables (tests).
CELLS, PROBED, SHORTLIST = 100, 60, 100
query("ann_topk")(lambda s, d: _cells(s, d).search(vector_probes(s, d), 10, PROBED, SHORTLIST))
query("ann_topk_all_cells", _ORACLES["vector_search"])(lambda s, d: rounded(_cells(s, d).search(vector_probes(s, d), 10, CELLS), "similarity"))
query("embed_query")(lambda s, d: segment.embed_query(asked(s, d)))


@query("sql_functions", f"WITH {SQL_TEXT}, h AS (SELECT id, law_name, (length(content) - length(replace(content, 'tion', ''))) / 4 AS relevance_score FROM t WHERE contains(content, 'tion')) SELECT id, law_name, relevance_score FROM h ORDER BY relevance_score DESC, id LIMIT 50")
def by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql_functions.register(spark, text_corpus(spark, sf_dir))
    return spark.sql("SELECT id, law_name, relevance_score FROM search_documents(max_results => 50, search_query => 'tion')")


SQL_ONE = SQL_OUTER.replace(SQL_PROBES, SQL_PROBES.replace(f"doc_id % {EVERY} = 0", "doc_id = (SELECT min(doc_id) FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id > 7)"))


@query("hybrid_search_by_name", SQL_ONE + "SELECT id, semantic_rank, keyword_rank, round(relevance, 6) AS relevance_score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(relevance, 9) DESC, id) AS rank FROM fo) WHERE rank <= 10")
def hybrid_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid function by its SQL name: the query is a text's first words with its vector, the search goes over all rows."""
    sql_functions.register(spark, text_corpus(spark, sf_dir), corpus.vectors(spark, sf_dir), places(spark, sf_dir))
    docs = table(spark, sf_dir, "documents").filter("doc_id > 7").join(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")
    words, vector = docs.orderBy("doc_id").select(F.array_join(F.slice(T.tokens(F.col("text")), 1, 3), " "), F.col("embedding").cast("array<double>")).first()
    rows = spark.sql("SELECT * FROM hybrid_search(search_query => :words, query_vector => :vector, max_results => 10)", {"words": words, "vector": F.array(*map(F.lit, vector))})
    return rounded(rows, "relevance_score")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_search(spark, sf_dir)
