"""Text functions of the engine as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexemes import lexemes

# Particles, dictionary, title words and patterns of the statute domain.
STOPWORDS = ["은", "는", "이", "가", "을", "를", "의", "에", "와", "과"]
LEGAL_TERMS = [("설치", "설치기준"), ("운영", "운영기준"), ("검사", "안전검사"), ("인증", "인증기준"), ("충전소", "수소충전소"), ("저장소", "수소저장소")]
DEFINITION_WORDS = "정의|용어|뜻"
PENALTY_WORDS = "벌칙|과태료|형|징역|벌금"
ARTICLE_REF = r"제[0-9]+조(?:제[0-9]+항)?(?:제[0-9]+호)?"
ARTICLE_HEAD = r"제([0-9]+)조\s*\(([^)]+)\)"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮"

_SPACE = r"(?U)\s+"


def occurrences(content: Column, query: Column) -> Column:
    """Non-overlapping, case-sensitive occurrences of a non-empty literal, as double."""
    gone = F.length(content) - F.length(F.replace(content, query, F.lit("")))
    return F.try_divide(gone.cast("double"), F.length(query).cast("double"))


def tokens(text: Column) -> Column:
    """Words between (Unicode) white space, none empty."""
    return F.filter(F.split(text, _SPACE), lambda t: t != "")


def without_stopwords(words: Column, stop: Sequence[str] = STOPWORDS) -> Column:
    """Whole-token removal; repeats and order stay."""
    return F.filter(words, lambda t: ~t.isin(*stop))


def legal_terms(query: Column, terms: Sequence[tuple[str, str]] = LEGAL_TERMS) -> Column:
    """The value of every dictionary key that the query contains, in dictionary order."""
    found = F.array(*(F.when(F.contains(query, F.lit(k)), F.lit(v)) for k, v in terms))
    return F.filter(found, lambda v: v.isNotNull())


def article_refs(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(ARTICLE_REF), F.lit(0))


def distinct_refs(content: Column) -> Column:
    return F.array_sort(F.array_distinct(article_refs(content)))


def highlight(content: Column, keywords: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Each keyword in turn, literal and case-sensitive; a later keyword may match inside earlier tags."""
    return F.aggregate(keywords, content, lambda acc, k: F.replace(acc, k, F.concat(F.lit(before), k, F.lit(after))))


def highlight_ignoring_case(content: Column, keywords: Column | Sequence[str], style: str = "background:#ff0") -> Column:
    """As ``highlight`` but without regard to case, keeping the text as it was written; keywords are literal."""
    if not isinstance(keywords, Column):
        keywords = F.array(*map(F.lit, keywords)).cast("array<string>")
    pattern = lambda k: F.concat(F.lit("(?iu)(\\Q"), F.replace(k, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    return F.aggregate(keywords, content, lambda acc, k: F.regexp_replace(acc, pattern(k), F.lit(f'<mark style="{style}">$1</mark>')))


def normalized_newlines(content: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(content, "\n\n+", "<br><br>"), "\n", " ")


def keywords_by_comma(query: Column) -> Column:
    return F.filter(F.split(F.trim(query), r"[\s,]+"), lambda t: t != "")


def keywords_by_space(query: Column) -> Column:
    return F.filter(F.split(query, " "), lambda t: F.length(t) > 1)


def snippet(content: Column, query: Column, before: int, after: int | Column) -> Column:
    """Text around the first hit: from ``before`` characters ahead to ``after`` behind its start; null without one."""
    at = F.locate(query, content) if isinstance(query, str) else F.instr(content, query)
    at = at.cast("int")
    start = F.greatest(F.lit(1), at - before)
    end = F.least(F.length(content) + 1, at + (F.lit(after) if isinstance(after, int) else after))
    return F.when(at > 0, F.substring(content, start, end - start))


def preview(content: Column, n: int) -> Column:
    return F.when(F.length(content) > n, F.concat(F.left(content, F.lit(n)), F.lit("..."))).otherwise(content)


def matches_all(content: Column, query: Column) -> Column:
    """Every lexeme of the query occurs in the content; an empty query matches nothing."""
    q, own = F.array_distinct(lexemes(query)), F.array_distinct(lexemes(content))
    return (F.size(q) > 0) & F.forall(q, lambda t: F.array_contains(own, t))


def tier(name: Column, words: Sequence[str] = ("시행규칙", "시행령"), otherwise: str = "법률") -> Column:
    """The first of the words that the name contains."""
    first, *rest = words
    case = F.when(F.contains(name, F.lit(first)), F.lit(first))
    for w in rest:
        case = case.when(F.contains(name, F.lit(w)), F.lit(w))
    return case.otherwise(F.lit(otherwise))


def title_has(title: Column, words: str) -> Column:
    """Whether a title has one of the words (parted by |); false for null."""
    return F.coalesce(title.rlike(words), F.lit(False))


def is_definition(title: Column) -> Column:
    return title_has(title, DEFINITION_WORDS)


def is_penalty(title: Column) -> Column:
    return title_has(title, PENALTY_WORDS)


def line_kind(line: Column) -> Column:
    """chapter, article, paragraph, item, subitem or body, by how the line begins."""
    return (
        F.when(line.rlike(r"^제[0-9]+장"), "chapter")
        .when(line.rlike(r"^제[0-9]+조"), "article")
        .when(line.rlike(f"^[{CIRCLED}]"), "paragraph")
        .when(line.rlike(r"^[0-9]+\."), "item")
        .when(line.rlike(r"^[가-힣]\."), "subitem")
        .otherwise("body")
    )


def truncated(content: Column, most: int = 2000) -> Column:
    return F.substring(content, 1, most)
