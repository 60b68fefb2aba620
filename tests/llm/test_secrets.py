import collections
import math
import re
import signal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from statuta.llm import secrets


def plain(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_long_slugs_end():
    def late(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(20)
    try:
        for slug in ("guide-to-building-applications-with-many-long-words-and-then-some-2024", "a" * 5_000 + "1", "/usr/share" * 500 + "9", "a-b_c/" * 900 + "0"):
            secrets.all_spans(f"see {slug} there")
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


@settings(max_examples=1000, deadline=None)
@given(st.text(alphabet="ab/_-1", max_size=12))
def test_paths_are_allowed_as_before(s):
    path = re.fullmatch("(?:/?[a-z]+(?:[_-][a-z]+)*)+/?", s)
    assert bool(path) == bool(re.fullmatch("/?[a-z]+(?:[/_-][a-z]+)*/?", s))
    assert not path or secrets.allowed(s, 0, len(s))


PARTS = ["token", "Password", "api_key", "APIKEY", "ſecret", "=", ": ", '"', "abcdef0123456789", "AKIA", "AKIAZZ12", "QWE9", " ", "x", "é", "deadbeef" * 4]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_base_equals_plain_expressions(text):
    base, spans = secrets.all_spans(text)
    assert base == plain(text) and set(base) <= set(spans)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab01xyz", max_size=60), st.integers(1, 25))
def test_incremental_entropy(s, width):
    w = min(width, len(s))
    want = [-sum(c / w * math.log2(c / w) for c in collections.Counter(s[i : i + w]).values()) for i in range(len(s) - w + 1)] if w else []
    assert list(secrets.window_entropies(s, width)) == pytest.approx(want, abs=1e-9)


def test_added_and_allowed():
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzK1q9Z"
    assert ("entropy", 2, 2 + len(key)) in secrets.all_spans(f"x {key} y")[1]
    for text in ("commit 3fa9c1d2e4b5a6978877665544332211aabbccd", "123e4567-e89b-12d3-a456-426614174000", "Donaudampfschifffahrtsgesellschaft", "abcdefghijklmnopqrstuvwxyz0123456789", "some/long/path/of_words/in-it", "1" * 40 + "e" * 3):
        assert not [s for s in secrets.all_spans(text)[1] if s[0] == "entropy"], text


def needs(s, p):
    """The bound of a candidate, from the words of the specification."""
    if not re.search("[0-9]", s) or not re.search("[A-Za-z]", s):
        return math.inf
    if re.fullmatch("[0-9a-f]*", s) or re.fullmatch("[0-9A-F]*", s):
        return p.hexadecimal
    return p.alphanumeric if re.fullmatch("[A-Za-z0-9]*", s) else p.base64


def entropies(s, width):
    w = min(width, len(s))
    return [-sum(c / w * math.log2(c / w) for c in collections.Counter(s[i : i + w]).values()) for i in range(len(s) - w + 1)] if w else []


SNIPPETS = ["wJalrXUtnFEMI/K7MDENG", "bPxRfiCYz9", "0123456789", "abcdefghij", "commit ", "sha256=", "deadbeef00", "77AC", " ", "=", "_", "/usr/share", "EXAMPLE", "q8Z", "é", "token=", "123e4567-e89b-12d3-a456-426614174000"]


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(SNIPPETS), max_size=10).map("".join))
def test_added_spans_equal_brute_force(text):
    p = secrets.Params()
    base, spans = secrets.all_spans(text)
    want = []
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        s = m[0]
        if len(s) < 20 or any(set(range(x, y)) & set(range(m.start(), m.end())) for _, x, y in base):
            continue
        public = (
            re.fullmatch("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", s)
            or re.fullmatch("/?[a-z]+([/_-][a-z]+)*/?", s)
            or re.fullmatch("[A-Za-z]+([_-][A-Za-z]+)*=*", s)
            or re.fullmatch("[0-9=_+/-]+", s)
            or re.fullmatch("[A-Za-z_-]*(EXAMPLE|example|sample|dummy|placeholder|changeme)[A-Za-z0-9_-]*", s)
            or any(a[i : i + 10] in s for a in secrets._ALPHABETS for i in range(0, len(a) - 9, 4))
            or re.search(r"(sha-?(1|256|384|512)|md5|commit|checksum|digest|integrity|etag)[\s:=\"'(-]*$", text[max(0, m.start() - 24) : m.start()], re.I)
        )
        if not public and any(h > needs(s, p) for h in entropies(s.rstrip("="), p.window)):
            want.append(("entropy", m.start(), m.end()))
    assert sorted(set(spans) - set(base)) == sorted(want)


def test_many_candidates_take_linear_time():
    base, spans = secrets.all_spans("token=abcdefgh1 x8KqZr5TnWc2LmYp7VbD " * 20_000)
    assert len(base) == 20_000 and len(spans) == 40_000


def test_frame(spark):
    rows = [(1, "token=abcdefgh1"), (1, "token=abcdefgh1"), (2, None), (3, ""), (None, "A" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans")
    got = sorted(((r.doc_id, r.n_assign, r.spans) for r in secrets.find(df).collect()), key=str)
    assert got == sorted([(1, 1, "assign:0:15"), (1, 1, "assign:0:15"), (2, 0, ""), (3, 0, ""), (None, 0, "")], key=str)
    assert secrets.find(df.limit(0)).count() == 0
