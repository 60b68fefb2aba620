"""Secrets in texts: keyed patterns, plus strings whose every window looks random.

The added spans come from candidate strings (runs of token characters).  Over a
candidate a window of fixed width slides; the counts of its characters change by
one in, one out, and so does the sum of c log2 c, which gives the window's
Shannon entropy without a recount.  A candidate's class (hexadecimal, letters and
digits, base 64) sets the entropy it must exceed; an allow-list then drops
strings that are public by their form, such as digests named as such, UUIDs,
alphabets, documented examples and paths.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

Span = tuple[str, int, int]
KINDS = ("assign", "access", "hex")
_ORDER = {k: i for i, k in enumerate((*KINDS, "entropy"))}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYWORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


@dataclass(frozen=True)
class Params:
    window: int = 20
    #: Entropy in bits that some window must exceed, by character class.
    hexadecimal: float = 3.0
    alphanumeric: float = 3.7
    base64: float = 3.9


# Forms and strings that are public.
_ALLOWED_FORMS = re.compile(
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"  # UUID
    r"|/?[a-z]+(?:[/_-][a-z]+)*/?"  # path of lower-case words
    r"|[A-Za-z]+(?:[_-][A-Za-z]+)*=*"  # words without a digit
    r"|[0-9=_+/-]+"  # numbers, rules
    r"|[A-Za-z_-]*(?:EXAMPLE|example|sample|dummy|placeholder|changeme)[A-Za-z0-9_-]*"
)
_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "9876543210", "qwertyuiop", "QWERTYUIOP")
_DIGEST_BEFORE = re.compile(r"(?:sha-?(?:1|256|384|512)|md5|commit|checksum|digest|integrity|etag)[\s:=\"'(-]*\Z", re.I)


def base_spans(text: str) -> list[Span]:
    """The base spans by start, then kind."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], _ORDER[s[0]]))


def window_entropies(s: str, width: int) -> Iterator[float]:
    """Entropy of each window, from counts that change by one character in and one out."""
    width = min(width, len(s))
    if not width:
        return
    term = [0.0, 0.0, *(c * math.log2(c) for c in range(2, width + 1))]
    counts: dict[str, int] = {}
    total = 0.0
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        total += term[c + 1] - term[c] if c < width else 0.0
        counts[ch] = c + 1
        if i >= width:
            old = s[i - width]
            c = counts[old]
            total += term[c - 1] - term[c] if c <= width else 0.0
            counts[old] = c - 1
        if i >= width - 1:
            yield math.log2(width) - total / width


def needed(s: str, p: Params) -> float | None:
    """The entropy a candidate of this make-up must exceed; None if it can't be a secret."""
    if not any(map(str.isdigit, s)) or not any(map(str.isalpha, s)):
        return None
    if all(c in "0123456789abcdef" for c in s) or all(c in "0123456789ABCDEF" for c in s):
        return p.hexadecimal
    return p.alphanumeric if s.isalnum() else p.base64


def allowed(text: str, start: int, end: int) -> bool:
    """Whether the candidate's form, content or introduction shows that it's public."""
    s = text[start:end]
    if _ALLOWED_FORMS.fullmatch(s) or any(a[i : i + 10] in s for a in _ALPHABETS for i in range(0, len(a) - 9, 4)):
        return True
    return _DIGEST_BEFORE.search(text, max(0, start - 24), start) is not None


def all_spans(text: str, p: Params = Params()) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans); an added span touches no base span."""
    base = base_spans(text)
    added, taken = [], common.Covered([(s, e) for _, s, e in base])
    for m in _CANDIDATE.finditer(text):
        start, end = m.start(), m.end()
        bound = needed(m[0], p)
        if bound is None or taken.touches(start, end) or allowed(text, start, end):
            continue
        if any(h > bound for h in window_entropies(m[0].rstrip("="), p.window)):
            added.append(("entropy", start, end))
    return base, sorted(base + added, key=lambda s: (s[1], _ORDER[s[0]]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_FOUND = "doc_id long, n_assign long, n_access long, n_hex long, n_added long, base_sha256 string, spans string"


def find(documents: DataFrame, p: Params = Params()) -> DataFrame:
    """Per row: doc_id, base counts by kind, number of added spans, digest of the base
    spans, and all spans (kind:start:end in code points, end exclusive).

    A span covers the whole match, keyword included.  A null text counts as empty.
    Repeated rows give repeated results, an empty table none; only doc_id and text
    are looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _FOUND.split(", ")]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = all_spans(text or "", p)
                rows.append((*(sum(k == kind for k, _, _ in base) for kind in KINDS), len(spans) - len(base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=pa.int64() if i < 4 else pa.string()) for i, c in enumerate(columns))], names=names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _FOUND)
