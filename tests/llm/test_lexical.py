import math
import re
from collections import Counter

import numpy as np
import pytest
from statuta.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k):
    each = [(i, Counter(terms(t))) for i, t in docs]
    each = [(i, c) for i, c in each if c]
    n_docs, total = len(each), sum(sum(c.values()) for _, c in each)
    df = Counter(t for _, c in each for t in c)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(t))
    out = set()
    for item, own in wanted.items():
        scores = []
        for doc, c in each:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if s > 0 and doc is not None:
                scores.append((-s, doc))
        out |= {(item, rank, doc, -s) for rank, (s, doc) in enumerate(sorted(scores)[:k], 1)}
    return out


DOCS = [
    (1, "The cat sat. THE END"), (2, "the cat"), (3, "the cat"), (3, "the cat"), (4, None), (5, ""), (6, " .,; "), (None, "cat cat dog"), (7, "Ärger ärger ÄRGER straße 12 1２"),
    (8, "cat " * 5000 + "dog"), (9, "x" * 300_000 + " dog"), (10, "a\x00b\x7fc`d@e/f:g[h{i~j"), (11, "das Wort　hier"),
]
ITEMS = [(1, "THE cat the CAT"), (2, "dog"), (2, "cat"), (3, "nothing here like it"), (4, None), (5, ""), (None, "cat"), (6, "ärger Ärger 1２"), (7, "a b c d e f g h i j"), (8, "das Wort　hier"), (9, "x" * 300_000)]


@pytest.mark.parametrize(("tile", "width", "docs", "block"), [(1_000_000, 4096, 1024, 256), (8, 2, 3, 2)])
def test_equals_brute_force(spark, monkeypatch, tile, width, docs, block):
    for name, value in (("_WIDTH", width), ("_DOCS", docs), ("_ITEMS", block)):
        monkeypatch.setattr(lexical, name, value)
    d = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "'x' AS item_id", "1 AS n", "2 AS score", "3 AS terms")
    i = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'y' AS doc_id", "0 AS term")
    got = [tuple(r) for r in lexical.rank_documents(d, i, 4, tile).collect()]
    want = brute(DOCS, ITEMS, 4)
    assert Counter(got) == Counter(want)
    ties = [r for r in got if r[0] == 1]
    assert [r[2] for r in sorted(ties)] == [1, 2, 3, 3]


def test_empty_tables(spark):
    d, i = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.rank_documents(d.limit(0), i).count() == 0 and lexical.rank_documents(d, i.limit(0)).count() == 0


def test_terms_of_a_long_text_are_those_of_the_whole():
    text = ("Wort größer 12x--" * 1000).encode()
    assert [w for part in lexical.words(text, 7) for w in part] == [w for part in lexical.words(text) for w in part] == [t.encode() for t in terms(text.decode())]


def test_a_tile_is_so_narrow_that_sums_stay_exact():
    plan = lexical.Plan(10, 10, np.arange(1), np.zeros(9, int), np.arange(9), np.full(9, 1 << 32))
    assert plan.width * (1 << 32) * 10**6 < 1 << 53
    assert lexical.impacts(np.array([1]), np.array([10**9]), np.array([0]), 1, 1)[0] < 10**6


def test_lengths_beyond_a_long_are_exact():
    n = np.array([10**9, 3])
    got = lexical.impacts(n, np.array([5, 5]), np.array([0, 1]), 10**12, 10**15)
    assert got.tolist() == [10**9 * 5 // (5000 + 8 * (10 + 90 * int(x) * 10**12 // 10**15)) for x in n]
