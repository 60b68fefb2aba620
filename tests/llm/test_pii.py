import re

from hypothesis import given, settings
from hypothesis import strategies as st
from statuta.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The contract's words, by regular expressions alone."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab.@-+ 0123459()%é", max_size=60))
def test_base_equals_plain_expressions(text):
    assert pii.base_spans(text) == plain(text)
    base, spans = pii.all_spans(text)
    assert base == plain(text) and set(base) <= set(spans)


def test_disguises_map_back_to_the_source():
    cases = {
        "mail joe.b (at) example (dot) com now": ("email", "joe.b (at) example (dot) com"),
        "mail joe at example dot com now": ("email", "joe at example dot com"),
        "mail jоe@exаmple.com now": ("email", "jоe@exаmple.com"),
        "mail joe [at] example.com.": ("email", "joe [at] example.com"),
        "call plus four nine one five five one two three four five six ok": ("phone", "plus four nine one five five one two three four five six"),
        "host １９２.168.0.1 up": ("ip", "１９２.168.0.1"),
        "host 10 dot 0 dot 0 dot 1 up": ("ip", "10 dot 0 dot 0 dot 1"),
        "pay four one one one one one one one one one one one one one one one .": ("card", "four one one one one one one one one one one one one one one one"),
    }
    for text, (kind, source) in cases.items():
        got = [(k, text[s:e]) for k, s, e in pii.all_spans(text)[1]]
        assert (kind, source) in got, (text, got)


def test_bracketed_forms_need_no_spelled_word():
    cases = {
        "mail joe@example[.]com now": ("email", "joe@example[.]com"),
        "host 10[.]0[.]0[.]1 up": ("ip", "10[.]0[.]0[.]1"),
        "host 10(.)0(.)0(.)1 up": ("ip", "10(.)0(.)0(.)1"),
        "mail joe (arroba) example.com now": ("email", "joe (arroba) example.com"),
        "mail joe [ät] example.de now": ("email", "joe [ät] example.de"),
        "mail joe (chez) example.fr now": ("email", "joe (chez) example.fr"),
        "mail joe{@}example.com now": ("email", "joe{@}example.com"),
        "mail joe<@>example.com now": ("email", "joe<@>example.com"),
        "mail joe{ at }example.com now": ("email", "joe{ at }example.com"),
        "mail joe< at >example.com now": ("email", "joe< at >example.com"),
        "pay ſix fıve SİX six six": None,
        "call plus four nine one ſix one two three four fıve SİX ok": ("phone", "plus four nine one ſix one two three four fıve SİX"),
    }
    for text, found in cases.items():
        got = [(k, text[s:e]) for k, s, e in pii.all_spans(text)[1]]
        assert found is None or found in got, (text, got)


PARTS = ["joe", "example", "com", "10", "0", "7", "at", "AT", "@", "arroba", "ät", "Ät", "chez", "dot", "Punkt", "PUN\u212aT", "punto", "poınt", ".", "[", "]", "(", ")", "{", "}", "<", ">", " ", " ", "\u2028", "\xa0", "plus", "+", "six", "ſix", "FİVE", "un", "null", "zéro", ","]


@settings(max_examples=2000, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), st.lists(st.sampled_from(PARTS), max_size=14).map(" ".join)))
def test_look_before_the_work_loses_nothing(text):
    got, look = pii.all_spans(text), pii._disguised
    pii._disguised = lambda text: True
    try:
        assert got == pii.all_spans(text)
    finally:
        pii._disguised = look


def test_numbers_of_thousands_of_digits():
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)] and pii.base_spans("9" * 5000 + ".1.1.1") == []
    assert pii.base_spans("256.1.1.1 255.000.1.1 1.1.1.0256") == [("ip", 10, 21)]


def test_many_parts_and_many_spans_take_linear_time():
    name = " dot ".join(f"part{i}" for i in range(10_000)) + " at mail dot com"
    assert pii.all_spans(name)[1] == [("email", 0, len(name))]
    many = "a@b.co " * 30_000 + "joe (at) c.co " * 2_000
    base, spans = pii.all_spans(many)
    assert len(base) == 30_000 and len(spans) == 32_000


DOTS = [" dot ", " Punkt ", " punto ", "[dot]", " (point) ", "{.}", "<.>", " [ dot ]"]
BOXED = ["[at]", " (at) ", "{@}", "<arroba>", " @ ", "@ ", "(ät)", "[chez]", "{ at }"]
WORDS = [["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"], ["null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"], ["cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"], ["zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"]]


@st.composite
def planted(draw):
    """(kind, text) of one identifier behind a disguise."""
    pick = lambda xs: draw(st.sampled_from(xs))
    kind = pick(["email", "ip", "phone", "card"])
    if kind == "email":
        bare = draw(st.booleans())
        owner, host = (draw(st.lists(st.text(alphabet="mnrv7", min_size=1, max_size=4), min_size=1, max_size=n)) for n in (9, 4))
        join = lambda parts, dots: parts[0] + "".join(pick(dots) + x for x in parts[1:])
        return kind, join(owner, [".", *DOTS]) + (pick([" at ", " arroba "]) if bare else pick(BOXED)) + join([*host, "com"], DOTS if bare else [".", *DOTS])
    if kind == "ip":
        parts = [str(draw(st.integers(0, 255))) for _ in range(4)]
        return kind, parts[0] + pick(DOTS) + parts[1] + pick([".", *DOTS]) + parts[2] + pick([".", *DOTS]) + parts[3]
    digits = draw(st.lists(st.integers(0, 9), min_size=10 if kind == "phone" else 13, max_size=15))
    if kind == "card":
        digits.append(next(c for c in range(10) if pii.luhn("".join(map(str, [*digits, c])))))
    words = pick(WORDS)
    said = [words[d] if i == 0 or draw(st.booleans()) else str(d) for i, d in enumerate(digits)]
    return kind, ("plus " if kind == "phone" else "") + said[0] + "".join(pick([" ", ", ", "-"]) + x for x in said[1:])


@settings(max_examples=600, deadline=None)
@given(st.lists(planted(), min_size=1, max_size=4), st.sampled_from(["zebra", "Ende gut", "1 x", "a@b.co", "— ﬁ"]))
def test_planted_disguises_are_found_at_their_places(items, filler):
    text, want = filler + " ; ", set()
    for kind, disguised in items:
        want.add((kind, len(text), len(text) + len(disguised)))
        text += disguised + " ; " + filler + " ; "
    base, spans = pii.all_spans(text)
    assert base == plain(text) and set(base) <= set(spans) and want <= set(spans), (text, want - set(spans))
    for kind, s, e in set(spans) - set(base):
        assert any(x <= s and e <= y for _, x, y in want), (text, kind, text[s:e])


def test_whole_table_behind_disguises(spark):
    """Each plain address of the table, disguised, is found again at its place, and nothing else is."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    hidden = 0
    for text in docs:
        found, new, last, want = [x for x in pii.base_spans(text) if x[0] == "email"], "", 0, set()
        for _, s, e in found:
            new += text[last:s]
            one = text[s:e].replace("@", " (at) ").replace(".", " [dot] ")
            want.add(("email", len(new), len(new) + len(one)))
            new, last = new + one, e
        new += text[last:]
        base, spans = pii.all_spans(new)
        assert want <= set(spans) and {x for x in set(spans) - set(base) if x[0] == "email"} == want
        hidden += len(want)
    assert hidden > 10


LOOKS = {}
for _look, _is in pii._LOOKALIKE.items():
    LOOKS.setdefault(_is, []).append(_look)
ADDRESS = "jane.roe+x@mail-1.example.co.uk"


def hidden_at(i):
    """The address with its i-th character disguised, in each way there is."""
    c = ADDRESS[i]
    forms = [*LOOKS.get(c, [])[:12], *LOOKS.get(c, [])[-4:], f"&#{ord(c)};", f"&#x{ord(c):x};", *(["\u00ad" + c, "\u200b" + c] if i else [])]
    if c == ".":
        forms += DOTS
    if c == "@":
        forms += [*BOXED, "&commat;"]
    return [ADDRESS[:i] + f + ADDRESS[i + 1 :] for f in forms]


def test_no_character_of_a_partly_disguised_address_survives_masking():
    n = 0
    for i in range(len(ADDRESS)):
        for one in hidden_at(i):
            text = f"write to {one} now"
            base, spans = pii.all_spans(text)
            assert base == plain(text) and set(base) <= set(spans)
            assert pii.redact(text, spans) == "write to [email] now", (one, spans)
            n += 1
    assert n > 400


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, len(ADDRESS) - 1), st.integers(0, 10**6)), min_size=1, max_size=6))
def test_several_disguises_within_one_address(places):
    one = list(ADDRESS)
    for i, pick in places:
        looks = [*LOOKS.get(ADDRESS[i], []), f"&#{ord(ADDRESS[i])};"]
        one[i] = looks[pick % len(looks)]
    text = "an " + "".join(one) + "; 日本語 é"
    base, spans = pii.all_spans(text)
    assert base == plain(text) and pii.redact(text, spans) == "an [email]; 日本語 é"


def test_other_kinds_behind_partial_disguises():
    for one, kind in (("192.16８.0.1", "ip"), ("192.168.٠.1", "ip"), ("192&#46;168.0.1", "ip"), ("192.168.0.𝟏", "ip"), ("4111 1111 11𝟏1 1111", "card"), ("４111-1111-1111-1111", "card"), ("+1 (988) 5५5-2485", "phone"), ("⁺49 30 1234 5678", "phone")):
        text = f"see {one} there"
        assert pii.redact(text, pii.all_spans(text)[1]) == f"see [{kind}] there", (one, pii.all_spans(text))


def test_clean_text_stays():
    for text in ("we met at noon and looked at example houses", "one two three", "at the dot com boom", "un dos tres", ""):
        assert pii.all_spans(text) == ([], [])


def test_frame(spark):
    rows = [(1, "a@b.co x"), (1, "a@b.co x"), (2, None), (3, ""), (None, "+1 (988) 555-2485"), (4, "4" * 100_000 + " " + "a" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans")
    got = {(r.doc_id, r.spans, r.redacted) for r in pii.find(df).collect()}
    assert {(1, "email:0:6", "[email] x"), (2, "", None), (3, "", ""), (None, "phone:0:17", "[phone]")} <= got
    assert pii.find(df).count() == 6 and pii.find(df.limit(0)).count() == 0
    assert pii.redact("ab cd ef", [("email", 0, 5), ("ip", 3, 8)]) == "[email]"
