"""Personal data in texts, plain and disguised, with spans in the source text.

The base detectors look at the text as it is.  The method adds what disguises
hide: a chain of rewriting transducers maps character references, look-alike characters,
bracketed or spelled "at" and "dot", and spelled digits to what they stand for.  Each keeps,
for every output character, the source span it came from, so a detector's span
in the normalised text maps back to source characters.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

Span = tuple[str, int, int]
KINDS = ("email", "ip", "card", "phone")
_ORDER = {k: i for i, k in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards in linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def _in_a_byte(digits: str) -> bool:
    """At most 255; leading zeros, however many, don't count."""
    own = digits.lstrip("0")
    return len(own) < 3 or (len(own) == 3 and own <= "255")


def base_spans(text: str) -> list[Span]:
    """The base spans by start, then kind."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_in_a_byte, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], _ORDER[s[0]]))


# Letters of other scripts that look like ASCII ones, and number words of four languages.
_LOOKALIKE = dict(zip("аеорсухіјѕһԁԛԝѵвгкмпткАВЕКМНОРСТУХІЅЈ", "aeopcyxijshdqwvbrkmntkABEKMHOPCTYXISJ", strict=True))
_LOOKALIKE |= dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονραικητυωγεβ", "ABEZHIKMNOPTYXovpaikntuwyeb", strict=True))
_LOOKALIKE |= dict(zip("օսոհզցıɑɡɪʟɴʀʏ", "ounhqgiagilnry", strict=True))
_LOOKALIKE |= {"․": ".", "。": ".", "｡": ".", "‑": "-", "–": "-", "−": "-", "⁺": "+", "\u00a0": " ", "\u2009": " ", "\u202f": " "}
#: By rule: what compatibility decomposition makes one printable ASCII character (mathematical, circled, full-width,
#: raised and lowered forms), and the decimal digits of every script.
for _c in map(chr, [*range(0x80, 0x10000), *range(0x10400, 0x12000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200), *range(0x1FBF0, 0x1FBFA)]):
    _plain = unicodedata.normalize("NFKC", _c)
    if len(_plain) == 1 and "!" <= _plain <= "~":
        _LOOKALIKE.setdefault(_c, _plain)
    elif unicodedata.category(_c) == "Nd":
        _LOOKALIKE.setdefault(_c, str(unicodedata.digit(_c)))
_INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
_DIGIT_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "oh": 0,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}

#: Characters of the first plane are one table to the pattern; those beyond are looked up one by one.
_FOLDED = re.compile("[" + "".join(re.escape(c) for c in (*_LOOKALIKE, *_INVISIBLE) if c <= "\uffff") + "\U00010000-\U0010ffff]")
_FOLDS = {**_LOOKALIKE, **dict.fromkeys(_INVISIBLE, "")}
_REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,10});")
_UNIT = r"(?:[0-9]|" + "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True)) + r")"
_SPELLED = re.compile(rf"(?<!\w)(?:(?:plus|\+)[\s,.-]{{1,2}})?{_UNIT}(?:[\s,-]{{1,2}}(?:(?:dot|point|punkt|punto)[\s,-]{{1,2}})?{_UNIT}){{3,}}(?!\w)", re.I)
_DIGIT_WORD = re.compile("|".join(sorted(_DIGIT_WORDS, key=len, reverse=True)), re.I)
# The words that stand for @ and a full stop.
_AT_WORDS, _BARE_AT_WORDS, _DOT_WORDS = ("at", "arroba", "ät", "chez"), ("at", "arroba"), ("dot", "punkt", "punto", "point")
_OPEN, _CLOSE = r"[\[({<]\s?", r"\s?[\])}>]"


def _any_of(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(words) + ")"


def _turned(words: tuple[str, ...]) -> str:
    return _any_of(tuple(w[::-1] for w in words))


_IN_AT = _OPEN + _any_of((*_AT_WORDS, "@")) + _CLOSE
_IN_DOT = _OPEN + _any_of((*_DOT_WORDS, r"\.")) + _CLOSE
_BARE_DOT = rf"\s{_any_of(_DOT_WORDS)}\s"
_DOT = rf"(?:\s?{_IN_DOT}\s?|{_BARE_DOT})"
_AT_ANY = re.compile(rf"(?P<boxed>\s?{_IN_AT}\s?|\s?@\s?)|(?P<bare>\s{_any_of(_BARE_AT_WORDS)}\s)", re.I)
_DOT_ANY = re.compile(_DOT, re.I)
#: What follows the at: labels parted by any dot; after a bare at, by disguised dots alone.
_HOST = {
    "boxed": re.compile(rf"(?:[A-Za-z0-9-]+(?:\.|{_DOT}))+[A-Za-z]{{2,}}", re.I),
    "bare": re.compile(rf"(?:[A-Za-z0-9-]+{_DOT})+[A-Za-z]{{2,}}", re.I),
}
#: What stands before the at, read backwards on the reversed text: as many names as there are.
_NAME = r"[A-Za-z0-9_%+-]++"
_OWNER = re.compile(rf"{_NAME}(?:(?:\.|\s?[\])}}>]\s?(?:{_turned(_DOT_WORDS)}|\.)\s?[\[({{<]\s?|\s{_turned(_DOT_WORDS)}\s){_NAME})*+", re.I)
_DOTTED_IP = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:\.|{_DOT})[0-9]{{1,3}}){{3}}(?![0-9])", re.I)


class Mapped:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str) -> None:
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces [a, b) by a string, for edits in order; what is put in stems from all of [a, b)."""
        if not edits:
            return
        text, start, end, last = [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[last:a] + new)
            start += self.start[last:a] + [self.start[a]] * len(new)
            end += self.end[last:a] + [self.end[b - 1]] * len(new)
            last = b
        self.text, self.start, self.end = "".join(text) + self.text[last:], start + self.start[last:], end + self.end[last:]


def decode_references(m: Mapped) -> None:
    """Character references of HTML become the character they stand for."""
    m.rewrite([(x.start(), x.end(), c) for x in _REFERENCE.finditer(m.text) if len(c := html.unescape(x[0])) == 1])


def fold_lookalikes(m: Mapped) -> None:
    m.rewrite([(x.start(), x.end(), _FOLDS[x[0]]) for x in _FOLDED.finditer(m.text) if x[0] in _FOLDS])


def disguised_addresses(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, start of the at, end of the at, end) of what has an address's shape, left to right without overlaps.

    From each at, the host is read forwards and the owner backwards, so names of any number of parts cost linear time.
    """
    turned, last = text[::-1], 0
    for at in _AT_ANY.finditer(text):
        host = _HOST[at.lastgroup].match(text, at.end())
        owner = _OWNER.match(turned, len(text) - at.start()) if host else None
        if owner and len(text) - owner.end() >= last:
            last = host.end()
            yield len(text) - owner.end(), at.start(), at.end(), last


def spell_out_addresses(m: Mapped) -> None:
    """In what has the shape of an address with a disguise, at and dot become @ and a full stop."""
    edits = []
    for start, at, after, end in disguised_addresses(m.text):
        edits += [(d.start(), d.end(), ".") for d in _DOT_ANY.finditer(m.text, start, at)]
        edits.append((at, after, "@"))
        edits += [(d.start(), d.end(), ".") for d in _DOT_ANY.finditer(m.text, after, end)]
    m.rewrite(edits)
    m.rewrite([(d.start(), d.end(), ".") for x in _DOTTED_IP.finditer(m.text) for d in _DOT_ANY.finditer(m.text, x.start(), x.end())])


def spell_out_digits(m: Mapped) -> None:
    """Runs of four or more spelled or single digits become digits without what parts them."""
    edits = []
    for x in _SPELLED.finditer(m.text):
        if not _DIGIT_WORD.search(x[0]):
            continue
        new = re.sub(r"^(?:plus|\+)[\s,.-]*", "+", x[0], flags=re.I)
        new = re.sub(r"[\s,-]+(?:dot|point|punkt|punto)[\s,-]+", ".", new, flags=re.I)
        new = _DIGIT_WORD.sub(lambda w: str(_DIGIT_WORDS[_lower(w[0])]), new)
        edits.append((x.start(), x.end(), re.sub(r"[\s,-]+", "", new)))
    m.rewrite(edits)


#: What the patterns' IGNORECASE takes for i, s and k, though lower() doesn't.
_CASELESS = str.maketrans("\u0130\u0131\u017f\u212a", "iisk")
_FOLDED_CASE = re.compile("[\u0130\u0131\u017f\u212a]")
#: Of a spelled number's four or more units, the inner ones stand between white space, commas and hyphens.
_UNITS = frozenset([*_DIGIT_WORDS, *"0123456789"])
_AT_APART = re.compile(rf"{_IN_AT}|\s@|@\s", re.I)
_DOT_APART = re.compile(rf"{_IN_DOT}|{_BARE_DOT}", re.I)


def _lower(text: str) -> str:
    return text.lower() if text.isascii() or not _FOLDED_CASE.search(text) else text.translate(_CASELESS).lower()


def _disguised(text: str) -> bool:
    """Whether any transducer could change the text (a cheap look before the work).

    Made of the transducers' own patterns: an address changes only by an "at" other
    than a plain @ or by a "dot" form, a bare "at" counts only beside such a form, and
    a dotted number needs one too.  Before a pattern, what it can't do without is looked for.
    """
    if not text.isascii() and any(x[0] in _FOLDS for x in _FOLDED.finditer(text)):
        return True
    if "&" in text and _REFERENCE.search(text):
        return True
    low, boxed = _lower(text), any(c in text for c in "[({<")
    if (boxed or "@" in text) and _AT_APART.search(text):
        return True
    if (boxed or any(w in low for w in _DOT_WORDS)) and _DOT_APART.search(text) and (_AT_ANY.search(text) or _DIGIT.search(text)):
        return True
    return not _UNITS.isdisjoint(low.replace(",", " ").replace("-", " ").split()) and _SPELLED.search(text) is not None


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans), each by start, then kind.

    An added span may cover a base span of its kind, as a disguise within an address leaves
    a shorter address beside it; one that is equal to or inside a base span is not added.
    """
    base = base_spans(text)
    if not _disguised(text):
        return base, base
    m = Mapped(text)
    decode_references(m)
    fold_lookalikes(m)
    spell_out_addresses(m)
    spell_out_digits(m)
    if m.text == text:
        return base, base
    own = {kind: [(s, e) for k, s, e in base if k == kind] for kind in KINDS}
    found = {(kind, m.start[a], m.end[b - 1]) for kind, a, b in base_spans(m.text)}
    added = [(kind, s, e) for kind, s, e in found if not _inside(own[kind], s, e)]
    return base, sorted({*base, *added}, key=lambda x: (x[1], _ORDER[x[0]], x[2]))


def _inside(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the spans, which are in order and don't overlap, holds all of [start, end)."""
    at = bisect_right(spans, start, key=lambda s: s[0]) - 1
    return at >= 0 and end <= spans[at][1]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, last = [], 0
    for kind, s, e in spans:
        if s >= last:
            out.append(text[last:s] + f"[{kind}]")
            last = e
        else:
            last = max(last, e)
    return "".join(out) + text[last:]


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string, redacted string"


def find(documents: DataFrame, redacted: bool = True) -> DataFrame:
    """Per row: doc_id, base counts by kind, the number of added spans, the digest of
    the base spans, all spans (kind:start:end in code points, end exclusive) and,
    if asked for, the text with all spans masked (else null).

    A null text counts as empty: no spans, a null masked text.  Texts are taken whole, however long, in linear time.  Repeated rows give
    repeated results, an empty table none; only doc_id and text are looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _FOUND.split(", ")]
        for batch in common.small(batches, 1):
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = all_spans(text or "")
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*counts, len(spans) - len(base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), redact(text, spans) if redacted and text is not None else None))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=pa.int64() if i < 5 else pa.string()) for i, c in enumerate(columns))], names=names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _FOUND)


def masked(documents: DataFrame) -> DataFrame:
    """All columns of ``documents``, in order, with personal data in text masked in place
    and n_chars, where there is one, counted anew.  Null texts stay null."""
    place, schema = documents.columns.index("text"), documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small(batches, place):
            texts = [None if t is None else redact(t, all_spans(t)[1]) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, "text", pa.array(texts, type=batch.schema.field(place).type))

    out = documents.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in documents.columns else out
