"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Distinct pre-tokens of a batch lie side by side in one ragged numpy array of
symbols.  In every round each sequence finds its lowest-ranked adjacent pair and
all sequences merge theirs at once; the symbols that survive are the tokens.
A merge can only form pairs of a higher rank, so merging every occurrence of the
lowest pair together gives what one-at-a-time merging gives.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_NONE = np.int64(1 << 40)
#: Words remembered by a worker, with their counts; beyond that it starts anew.
CACHE_WORDS = 600_000

#: Fixed value: the pre-token pattern of the vocabulary, with white space as Unicode has it.
_SPACE = r"[\t-\r\x20\x85\xa0  -     　]"
_PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?(?:(?!{_SPACE})[^\p{{L}}\p{{N}}])+|{_SPACE}+(?=\Z|{_SPACE})|{_SPACE}+")
#: A space that more white space or the end follows: the text can't simply be cut at spaces.
_ODD = re.compile(r" (?=\s|\Z)")
_CUT = re.compile(r" (?=\S)")


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merge ranks as arrays: a pair's key, its rank and the symbol it makes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], _byte_alphabet()
        self.byte_symbol = np.zeros(256, dtype=np.int64)
        for ch, b in alphabet.items():
            self.byte_symbol[b] = vocab[ch]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.made, order = made, np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], _NONE)


def surviving_symbols(words: list[bytes], merges: Merges) -> np.ndarray:
    """The number of tokens of each non-empty pre-token."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    out, index = sizes.copy(), np.arange(len(words))
    symbols = merges.byte_symbol[np.frombuffer(b"".join(words), dtype=np.uint8)]
    ranks = np.full(len(symbols), _NONE)
    ranks[:-1] = merges.rank(symbols[:-1], symbols[1:])
    ranks[np.cumsum(sizes) - 1] = _NONE
    while len(index):
        starts = np.cumsum(sizes) - sizes
        low = np.minimum.reduceat(ranks, starts)
        alive = low < _NONE
        if not alive.all():  # finished sequences leave the arrays
            out[index[~alive]] = sizes[~alive]
            keep = np.repeat(alive, sizes)
            symbols, ranks = symbols[keep], ranks[keep]
            index, sizes, low = index[alive], sizes[alive], low[alive]
            if not len(index):
                break
        hit = ranks == np.repeat(low, sizes)
        at = np.flatnonzero(hit)
        same = symbols[at] == symbols[at + 1]
        if same.any():  # of overlapping matches (a a a), the 1st, 3rd, ... merge
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            at = at[(nth % 2 == 0) | ~same]
        seq = np.repeat(np.arange(len(index)), sizes)
        symbols[at] = merges.made[ranks[at]]
        ends = np.zeros(len(symbols), dtype=bool)
        ends[np.cumsum(sizes) - 1] = True
        gone = np.zeros(len(symbols), dtype=bool)
        gone[at + 1] = True
        last = ends[at + 1]
        sizes = sizes - np.bincount(seq[at], minlength=len(index))
        fresh = np.zeros(len(symbols), dtype=bool)
        fresh[at] = True
        ends[at[last]] = True
        keep = ~gone
        symbols, ranks, fresh, ends = symbols[keep], ranks[keep], fresh[keep], ends[keep]
        fresh[:-1] |= fresh[1:]
        todo = np.flatnonzero(fresh)
        inner = todo[~ends[todo]]
        ranks[todo[ends[todo]]] = _NONE
        ranks[inner] = merges.rank(symbols[inner], symbols[inner + 1])
    return out


class Counter:
    """Token counts of texts; remembers the counts of space-led words."""

    def __init__(self, path: str) -> None:
        self.merges = Merges(path)
        self._special = re.compile("|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True)))) if self.merges.special else None
        self._led: dict[str, int] = {}

    def _chunks(self, text: str) -> tuple[str, list[str]]:
        """The text's first chunk and the others, each of which follows a space it owns."""
        parts = text.split(" ") if _ODD.search(text) is None else _CUT.split(text)
        return parts[0], parts[1:]

    def _learn(self, chunks: list[str]) -> dict[str, int]:
        """Counts of chunks given with their leading space."""
        split = [_PRETOKEN.findall(c) for c in chunks]
        flat = list(chain.from_iterable(split))
        if not flat:
            return dict.fromkeys(chunks, 0)
        distinct = {t: i for i, t in enumerate(dict.fromkeys(flat))}
        counts = surviving_symbols([t.encode() for t in distinct], self.merges)
        sums = np.concatenate(([0], np.cumsum(counts[np.fromiter(map(distinct.__getitem__, flat), dtype=np.int64, count=len(flat))])))
        ends = np.cumsum(np.fromiter(map(len, split), dtype=np.int64, count=len(split)))
        return dict(zip(chunks, np.diff(sums[np.concatenate(([0], ends))]).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        jobs, heads, unknown = [], set(), set()
        for text in texts:
            pieces = [text] if self._special is None or "<" not in text else self._special.split(text)
            own = []
            for piece in pieces:
                if piece:
                    head, led = self._chunks(piece)
                    own.append((head, led))
                    heads.add(head)
                    unknown.update(led)
            jobs.append((len(pieces) - 1, own))
        new = list(unknown.difference(self._led))
        if len(self._led) + len(new) > CACHE_WORDS:
            self._led, new = {}, list(unknown)
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            found = self._learn([" " + c for c in part])
            self._led.update((c, found[" " + c]) for c in part)
        first, led_count = self._learn(sorted(heads)), self._led.__getitem__
        return [n + sum(first[h] + sum(map(led_count, led)) for h, led in own) for n, own in jobs]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per worker process, kept between tasks."""
    return Counter(path)


def slices(texts: list[str], chars: int = 1 << 21) -> Iterator[list[str]]:
    """Runs of texts of about ``chars`` characters, at least one text each."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t)
        if n >= chars:
            yield run
            run, n = [], 0
    if run:
        yield run


def token_counts(documents: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Per row: doc_id, n_bytes long, n_tokens long, over_limit boolean.

    ``path`` names the vocabulary file, which every worker can read.  A null
    text counts as empty (0 bytes, 0 tokens).  Repeated rows give repeated
    results, an empty table none; more columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path)
        for batch in batches:
            _, at = common.text_bytes(batch.column(1))
            texts = batch.column(1).fill_null("").to_pylist()
            tokens = np.array([n for run in slices(texts) for n in tool.count(run)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
