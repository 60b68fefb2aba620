"""Typed lexemes: a table of inputs, and texts on which a careless pattern would take for ever."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F
from statuta.functions import lexemes as L
from statuta.functions import text as T
from statuta.plans import registry

# Expectations as recalled of the default full-text parser; each place in a list is a position.
CASES = [
    ("", []),
    ("  .,;!? ", []),
    ("The Thing", ["the", "thing"]),
    ("the the", ["the", "the"]),
    ("foo_bar", ["foo", "bar"]),
    ("beta1 1st 12", ["beta1", "1st", "12"]),
    ("수소충전소 설치 기준", ["수소충전소", "설치", "기준"]),
    ("제18조(수소충전소의 설치·운영)", ["제18조", "수소충전소의", "설치", "운영"]),
    ("ÉCOLE Straße", ["école", "straße"]),
    ("foo-bar-beta1", ["foo-bar-beta1", "foo", "bar", "beta1"]),
    ("Ko-Präsident", ["ko-präsident", "ko", "präsident"]),
    ("수소-안전", ["수소-안전", "수소", "안전"]),
    ("up-2date", ["up-2date", "up", "2date"]),
    ("abc-12", ["abc", "-12"]),
    ("trailing- dash -led", ["trailing", "dash", "led"]),
    ("a--b", ["a", "b"]),
    ("don't", ["don", "t"]),
    ("12 -12 +12", ["12", "-12", "+12"]),
    ("2020-01-31", ["2020", "-01", "-31"]),
    ("3.14 -2.5", ["3.14", "-2.5"]),
    ("1.5e10 2e-3", ["1.5e10", "2e-3"]),
    ("8.3.0 1.2.3.4", ["8.3.0", "1.2.3.4"]),
    ("7e5f", ["7e5f"]),
    ("end. Start", ["end", "start"]),
    ("e.g. so", ["e", "g", "so"]),
    ("example.com", ["example.com"]),
    ("www.example-site.co.kr:8080", ["www.example-site.co.kr:8080"]),
    ("http://example.com/stuff/index.html", ["example.com/stuff/index.html", "example.com", "/stuff/index.html"]),
    ("HTTPS://Example.com/a?b=1&c=2", ["example.com/a?b=1&c=2", "example.com", "/a?b=1&c=2"]),
    ("(see example.com/a)", ["see", "example.com/a)", "example.com", "/a)"]),
    ("http://localhost/x", ["localhost/x"]),
    ("a.b+c@example.com", ["a.b+c@example.com"]),
    ("mailto:joe@example.com.", ["mailto", "joe@example.com"]),
    ("joe@localhost", ["joe", "localhost"]),
    ("/usr/local/foo.txt", ["/usr/local/foo.txt"]),
    ("and/or", ["and/or"]),
    ("~/notes/today", ["~/notes/today"]),
    ("1/2", ["1", "2"]),
    ("수소/안전", ["수소", "안전"]),
    ('<b class="x">bold</b> a < b', ["bold", "a", "b"]),
    ("x &amp; y &#38; z", ["x", "y", "z"]),
    ("AT&T", ["at", "t"]),
    ("line\nbreak\ttab\u00a0blank", ["line", "break", "tab", "blank"]),
]


def test_table(spark):
    rows = spark.createDataFrame(list(enumerate(t for t, _ in CASES)), "i int, t string")
    got = {r["i"]: r["l"] for r in rows.select("i", L.lexemes(F.col("t")).alias("l")).collect()}
    assert [(CASES[i][0], got[i]) for i in range(len(CASES))] == CASES


def test_table_by_sql():
    con = duckdb.connect()
    got = [(t, con.execute(f"SELECT {registry.sql_lexemes('t')} FROM (SELECT ? AS t)", [t]).fetchone()[0]) for t, _ in CASES]
    assert got == CASES


def test_null_and_matching(spark):
    rows = spark.createDataFrame([(None, "a"), ("see example.com/a-b now", "example.com"), ("a foo-bar", "bar foo"), ("a foo bar", "foo-bar"), ("x", ""), ("x", "<b>")], "c string, q string")
    assert [r[0] for r in rows.select(T.matches_all(F.col("c"), F.col("q"))).collect()] == [None, True, True, False, False, False]


@pytest.mark.parametrize("piece", ["a", "a_", "a.", "a-", "a/", "1.", "-1", "a@", "<a", "&a", "a://", "가-", "a.b", "/", "_", "aa.", "ab@c."])
def test_long_texts_take_linear_time(spark, piece):
    t = (piece * 400_000)[:400_000]
    began = time.perf_counter()
    got = spark.createDataFrame([(t,)], "t string").select(F.size(L.lexemes(F.col("t")))).first()[0]
    assert got >= 0 and time.perf_counter() - began < 60
