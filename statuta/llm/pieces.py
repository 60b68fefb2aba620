"""SentencePiece encoding and decoding over a piece lattice, with N-best lists.

A text becomes a lattice of vocabulary pieces whose paths are its segmentations;
a path's score is the sum of its pieces' scores in the model file.  Forward
Viterbi gives each node its best score from the start; these scores are exact
heuristics for a backward A* search, which therefore yields paths best first.

No piece of the model has its word mark after another character, so every path
passes the node before each run of word marks.  The lattice is a chain of word
lattices: forward scores are computed once per distinct word, for all words of
one length together in numpy, and the search over a whole text only opens the
words whose second-best path costs least: an alternative in any other word is
beaten by N - 1 cheaper ones.

Scores are the model's own.  In a model trained by merges they are merge ranks,
so the best path here is the best-scoring segmentation, not the merge order's.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
_WORD = re.compile(" +[^ ]*")
_LOW = -1e18
#: Words remembered by a worker; beyond that it starts anew.
CACHE_WORDS = 300_000
_BASE = 0x2545F4914F6CDD1D


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Pieces:
    """The model file as tables: piece text to id and score, hashes by piece length."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal, user, byte = 1, 4, 6
        self.text = [p.piece for p in model.pieces]
        self.score = np.array([p.score for p in model.pieces])
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (normal, user)}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == byte}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        #: What each id decodes to.
        self.spoken = [bytes([self.byte_of[i]]) if i in self.byte_of else t.replace(MARK, " ").encode("utf-8", "surrogatepass") for i, t in enumerate(self.text)]
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == 2), 0)
        self._scores = self.score.tolist()
        usable = self.score[list(self.id.values())]
        #: Score of a character that no piece covers; it is encoded as bytes (or as the unknown piece).
        self.unknown_score = float(usable[usable > -1e8].min()) - 10
        if any(MARK in t.lstrip(MARK) for t in self.id):
            raise ValueError("a piece has a word mark after another character: the lattice has no cuts at words")
        self.longest = max(map(len, self.id))
        #: Every beginning of a piece: a walk from a start stops where none goes on.
        self.begun = {t[:k] for t in self.id for k in range(1, len(t) + 1)}
        by_length: dict[int, list[tuple[int, int]]] = {}
        for t, i in self.id.items():
            by_length.setdefault(len(t), []).append((self._hash(t), i))
        self.tables = {n: (np.array([h for h, _ in sorted(v)], dtype=np.uint64), np.array([i for _, i in sorted(v)], dtype=np.int32)) for n, v in by_length.items()}
        #: Upper bits of the pieces' hashes: most strings that are no piece are seen here.
        self.sieve = np.zeros(1 << 20, dtype=bool)
        #: By piece length, where the pieces of each upper 16 bits begin, and the most of any.
        self.starts: dict[int, tuple[np.ndarray, int]] = {}
        for n, (hashes, _) in self.tables.items():
            self.sieve[hashes >> np.uint64(44)] = True
            upper = (hashes >> np.uint64(48)).astype(np.int64)
            counts = np.bincount(upper, minlength=1 << 16)
            self.starts[n] = np.minimum(np.cumsum(counts) - counts, len(hashes) - 1).astype(np.int32), int(counts.max())
        #: The piece of a single character, or -1.
        self.single = np.full(0x110000, -1, dtype=np.int32)
        for t, i in self.id.items():
            if len(t) == 1:
                self.single[ord(t)] = i

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for k, c in enumerate(text):
            h += ((ord(c) + 1) * 0x9E3779B97F4A7C15 ^ ord(c) << 7) * pow(_BASE, k, 1 << 64)
        return h % (1 << 64)

    def edges(self, points: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By piece length, ascending: scores and ids by start and word, and which starts any word uses.

        ``points`` holds words of one length, a column each.
        """
        n, words = points.shape
        p = points.astype(np.uint64)
        sums = np.zeros((n + 1, words), dtype=np.uint64)
        np.cumsum(((p + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ p << np.uint64(7)) * _powers(_BASE, n)[:n, None], axis=0, out=sums[1:])
        down, out = _powers(pow(_BASE, -1, 1 << 64), n)[:, None], {}
        for k in range(1, min(self.longest, n) + 1):
            if k == 1:
                own = self.single[points]
                out[k] = np.where(own >= 0, self.score[own], self.unknown_score), own, np.ones(n, dtype=bool)
            elif k in self.tables:
                at, found = self._found(k, ((sums[k:] - sums[: n + 1 - k]) * down[: n + 1 - k]).ravel())
                if len(at):
                    score, own, used = np.full((n + 1 - k, words), _LOW), np.full((n + 1 - k, words), -1, dtype=np.int32), np.zeros(n + 1 - k, dtype=bool)
                    score.ravel()[at], own.ravel()[at] = self.score[found], found
                    used[at // words] = True
                    out[k] = score, own, used
        return out

    def _found(self, k: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces of ``k`` characters, and their ids."""
        (table, ids), (starts, most) = self.tables[k], self.starts[k]
        at = np.flatnonzero(self.sieve[h >> np.uint64(44)])
        h = h[at]
        place = starts[h >> np.uint64(48)]
        hit = table[place] == h
        for _ in range(1, most):  # others of the same upper bits follow
            left = np.flatnonzero(~hit)
            place[left] = np.minimum(place[left] + 1, len(table) - 1)
            hit[left] = table[place[left]] == h[left]
        return at[hit], ids[place[hit]]

    def forward(self, edges: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi from the start: best score of each node, and length of the piece that ends there (the shortest of equals)."""
        best, last = np.full((n + 1, words), _LOW), np.zeros((n + 1, words), dtype=np.int16)
        best[0] = 0
        for j in range(1, n + 1):
            for k, (score, _, used) in edges.items():
                if k <= j and used[j - k]:
                    through = best[j - k] + score[j - k]
                    np.copyto(last[j], k, where=through > best[j])
                    np.maximum(best[j], through, out=best[j])
        return best, last

    def best_paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words of one length: best score, cost of the second-best path (inf if none),
        the best paths' ids one after the other, and how many ids each has."""
        return self.paths("".join(words), len(words))

    def paths(self, joined: str, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``best_paths`` of so many words of one length, one after the other."""
        n = len(joined) // count
        points = np.ascontiguousarray(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(count, n).T)
        edges = self.edges(points)
        best, last = self.forward(edges, n, count)
        taken = np.zeros((n, count), dtype=np.int16)  # length of the best path's piece that starts here
        at, cols = np.full(count, n), np.arange(count)
        while len(cols):
            k = last[at[cols], cols]
            at[cols] -= k
            taken[at[cols], cols] = k
            cols = cols[at[cols] > 0]
        # A second path leaves the best one: it uses some edge that the best path doesn't.
        back, other = np.full((n + 1, count), _LOW), np.full(count, _LOW)
        back[n] = 0
        for i in range(n - 1, -1, -1):
            for k, (score, _, used) in edges.items():
                if i + k <= n and used[i]:
                    through = score[i] + back[i + k]
                    np.maximum(back[i], through, out=back[i])
                    through += best[i]
                    through[taken[i] == k] = _LOW
                    np.maximum(other, through, out=other)
        other[other < _LOW / 2] = -np.inf
        start, col = np.nonzero(taken.T)[::-1]
        k, ids = taken[start, col], np.empty(len(col), dtype=np.int32)
        for length in np.unique(k):
            on = k == length
            ids[on] = edges[int(length)][1][start[on], col[on]]
        alone = np.flatnonzero(ids < 0)
        if len(alone):  # characters that no piece covers
            chars = [self.spelled(joined[c * n + i]) for c, i in zip(col[alone].tolist(), start[alone].tolist(), strict=True)]
            n_ids = np.ones(len(ids), dtype=np.int64)
            n_ids[alone] = [len(x) for x in chars]
            ids, col = np.repeat(ids, n_ids), np.repeat(col, n_ids)
            ids[ids < 0] = np.fromiter(itertools.chain.from_iterable(chars), dtype=np.int32)
        return best[n], best[n] - other, ids, np.bincount(col, minlength=count)

    def spelled(self, char: str) -> list[int]:
        """A character that no piece covers: its bytes' pieces, or the unknown piece."""
        return [self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")] if len(self.byte_id) == 256 else [self.unknown]

    def lattice(self, word: str) -> tuple[list[list[tuple[int, float, int]]], list[float]]:
        """One word by itself: (start, score, id) of the pieces into each node, and each node's best score from the start."""
        into: list[list[tuple[int, float, int]]] = [[] for _ in range(len(word) + 1)]
        best = [0.0] + [_LOW] * len(word)
        for i in range(len(word)):
            for j in range(i + 1, len(word) + 1):
                part = word[i:j]
                if j > i + 1 and part not in self.begun:
                    break
                own = self.id.get(part, -1)
                if own >= 0 or j == i + 1:
                    score = self._scores[own] if own >= 0 else self.unknown_score
                    into[j].append((i, score, own))
                    if best[i] + score > best[j]:
                        best[j] = best[i] + score
                if part not in self.begun:
                    break
        return into, best

    def n_best(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of a word lattice, by backward A* under exact heuristics."""
        into, heuristic = self.lattice(word)
        # Among equal scores the path nearest the start goes first, so ties don't fan out;
        # a path is linked to the one it prolongs.
        count = itertools.count()
        queue, found = [(-heuristic[-1], len(word), next(count), 0.0, None)], []
        while queue and len(found) < n:
            cost, at, _, done, path = heapq.heappop(queue)
            if at == 0:
                ids = []
                while path is not None:
                    (i, c), path = path
                    ids += [i] if i >= 0 else self.spelled(c)
                found.append((-cost, ids))
                continue
            for start, score, own in reversed(into[at]):
                total = done + score
                heapq.heappush(queue, (-(total + heuristic[start]), start, next(count), total, ((own, word[start]), path)))
        return found


def words_of(text: str) -> list[str]:
    """The text's words, each without the first of its leading spaces (one is put before the text)."""
    if not text:
        return []
    if text[0] != " " and text[-1] != " " and "  " not in text:
        return text.split(" ")
    return [w[1:] for w in _WORD.findall(" " + text)]


class _Numbered(dict):
    """Words by number: one that isn't there yet gets the next."""

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        return at


class Encoder:
    def __init__(self, path: str) -> None:
        self.pieces = Pieces(path)
        self._alternatives: dict[tuple[str, int], list[tuple[float, list[int]]]] = {}
        self._forget()

    def _forget(self) -> None:
        self._index = _Numbered()
        self._score, self._gap = np.empty(0), np.empty(0)
        self._n, self._flat = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)
        self._start, self._spoken = np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)

    def learn(self, words: Iterable[str]) -> None:
        self.places(list(words))

    def places(self, words: list[str]) -> np.ndarray:
        """Where the words stand in the tables, which take up the new ones."""
        if len(self._index) > CACHE_WORDS:
            self._forget()
        known = len(self._index)
        at = np.fromiter(map(self._index.__getitem__, words), dtype=np.int64, count=len(words))
        if len(self._index) > known:
            self._take(list(itertools.islice(self._index, known, None)))
        return at

    def _take(self, new: list[str]) -> None:
        """The tables' rows of the words that were numbered last, worked out length by length."""
        sizes = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        order = np.argsort(sizes, kind="stable")
        own, sizes = [new[i] for i in order.tolist()], sizes[order]
        scores, gaps, counts, flat, spoken, lo = [], [], [], [], [], 0
        while lo < len(own):
            size = int(sizes[lo])
            hi = min(int(np.searchsorted(sizes, size, "right")), lo + max(1, (1 << 16) // (size + 1)))
            part = own[lo:hi]
            score, gap, ids, n = self.pieces.paths((MARK + MARK.join(part)).replace(" ", MARK), len(part))
            said = list(map(self.pieces.spoken.__getitem__, ids.tolist()))
            whole = [b"".join(said[e - k : e]).decode("utf-8", "replace") == " " + w for w, k, e in zip(part, n.tolist(), np.cumsum(n).tolist(), strict=True)]
            for column, values in zip((scores, gaps, counts, flat, spoken), (score, gap, n, ids, np.array(whole)), strict=True):
                column.append(values)
            lo = hi
        score, gap, n, spoken = (np.concatenate(c) for c in (scores, gaps, counts, spoken))
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        start = len(self._flat) + np.cumsum(n) - n
        self._score, self._gap, self._n = np.append(self._score, score[back]), np.append(self._gap, gap[back]), np.append(self._n, n[back])
        self._start, self._spoken, self._flat = np.append(self._start, start[back]), np.append(self._spoken, spoken[back]), np.concatenate((self._flat, *flat))

    def at(self, words: list[str]) -> np.ndarray:
        """Where the words, all learned, stand in the tables."""
        return np.fromiter(map(self._index.__getitem__, words), dtype=np.int64, count=len(words))

    def ids_at(self, at: np.ndarray) -> np.ndarray:
        """The best paths' ids of the words at these places, joined."""
        n = self._n[at]
        return self._flat[np.repeat(self._start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def swapped(self, ids: np.ndarray, ends: np.ndarray, swap: dict[int, list[int]]) -> list[np.ndarray]:
        """The best path's ids with other ids for the words at some positions, in pieces; ``ends`` is where each word's end."""
        out, done = [], 0
        for pos in sorted(swap):
            out += [ids[done : ends[pos - 1] if pos else 0], np.array(swap[pos], dtype=np.int32)]
            done = ends[pos]
        return [*out, ids[done:]]

    def says(self, at: np.ndarray, ids: np.ndarray, text: str) -> bool:
        """Whether decoding gives the text back: it does if it does word by word."""
        return bool(self._spoken[at].all()) or self.decode(ids.tolist()) == text

    def encode_words(self, words: list[str]) -> np.ndarray:
        return self.ids_at(self.at(words))

    def n_best_words(self, words: list[str], n: int, at: np.ndarray | None = None) -> list[tuple[float, int, dict[int, list[int]]]]:
        """Whole-text N best: (score, pieces, {word position: ids that replace its best path}).

        A* over the words that may change: the heuristic of the rest is its best score.
        """
        if not words:
            return [(0.0, 0, {})][:n]
        at = self.at(words) if at is None else at
        gaps = self._gap[at]
        k = min(n - 1, len(words))
        cheap = np.lexsort((np.arange(len(words)), gaps))[:k] if len(words) <= 4 * n or k == 0 else self._least(gaps, k)
        open_words = []
        for i in cheap:
            if np.isfinite(gaps[i]):  # of equals the search may find another first: the best path is the table's
                first = int(self._start[at[i]])
                options, own = self._options(words[i], n), self._flat[first : first + int(self._n[at[i]])].tolist()
                open_words.append((int(i), [(options[0][0], own), *(o for o in options if o[1] != own)][:n]))
        score, count = float(self._score[at].sum()), int(self._n[at].sum())
        queue: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        found = []
        while queue and len(found) < n:
            cost, chosen = heapq.heappop(queue)
            if len(chosen) == len(open_words):
                swap = {pos: options[c][1] for (pos, options), c in zip(open_words, chosen, strict=True) if c}
                more = sum(len(ids) - int(self._n[at[pos]]) for pos, ids in swap.items())
                found.append((score - cost, count + more, swap))
                continue
            options = open_words[len(chosen)][1]
            for c, (s, _) in enumerate(options):
                heapq.heappush(queue, (cost + options[0][0] - s, (*chosen, c)))
        return found

    @staticmethod
    def _least(gaps: np.ndarray, k: int) -> np.ndarray:
        """Positions of the k least gaps, earlier ones first among equals."""
        bound = np.partition(gaps, k - 1)[k - 1]
        below, level = np.flatnonzero(gaps < bound), np.flatnonzero(gaps == bound)
        return np.concatenate((below, level[: k - len(below)]))

    def _options(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        key = (word, n)
        if key not in self._alternatives:
            if len(self._alternatives) > 20_000:
                self._alternatives.clear()
            self._alternatives[key] = self.pieces.n_best(MARK + word.replace(" ", MARK), n)
        return self._alternatives[key]

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids: byte pieces joined as UTF-8, word marks as spaces, one space off the front."""
        text = b"".join(map(self.pieces.spoken.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process, kept between tasks."""
    return Encoder(path)


_ENCODED = "doc_id long, n_chars long, n_pieces long, score double, n_best_scores array<double>, n_best_pieces array<long>, ids array<int>, round_trip boolean"


def _lists(sizes: list[int | None], values: pa.Array) -> pa.ListArray:
    """The values in lists of these sizes, null for None."""
    ends = np.cumsum([0] + [n or 0 for n in sizes])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([n is None for n in sizes], pa.bool_()))


def _encoded(tool: Encoder, doc_ids: pa.Array, texts: list[str | None], n: int, keep_ids: bool, keep_n_best: bool) -> pa.RecordBatch:
    split = [None if t is None else words_of(t) for t in texts]
    places = tool.places([w for ws in split if ws for w in ws])
    flat, out, parts, sizes, done, first = tool.ids_at(places), [[] for _ in range(6)], [], [], 0, 0
    for t, ws in zip(texts, split, strict=True):
        if ws is None:
            row = [None] * 6
        else:
            at = places[done : done + len(ws)]
            ends = np.cumsum(tool._n[at])
            ids = flat[first : first + (int(ends[-1]) if ws else 0)]
            best = tool.n_best_words(ws, n, at)
            row = [len(t), len(ids), best[0][0], [b[0] for b in best], [b[1] for b in best], tool.says(at, ids, t)]
            done, first = done + len(ws), first + len(ids)
            if keep_n_best:
                sizes += row[4]
                for b in best:
                    parts += tool.swapped(ids, ends, b[2])
        for column, value in zip(out, row, strict=True):
            column.append(value)
    own = [*(pa.array(c, type=k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_()), strict=True))]
    own.insert(5, _lists(out[1], pa.array(flat, pa.int32())) if keep_ids else pa.nulls(len(texts), pa.list_(pa.int32())))
    names = [c.split()[0] for c in _ENCODED.split(", ")]
    if keep_n_best:
        ids = _lists(sizes, pa.array(np.concatenate([np.empty(0, dtype=np.int32), *parts]), pa.int32()))
        own.append(_lists([None if s is None else len(s) for s in out[3]], ids))
        names.append("n_best_ids")
    return pa.RecordBatch.from_arrays([doc_ids, *own], names=names)


def encode(documents: DataFrame, path: str, n: int = 4, keep_ids: bool = True, keep_n_best: bool = False) -> DataFrame:
    """Per row: doc_id, n_chars, the best segmentation's n_pieces, score and ids, the
    scores and piece counts of the ``n`` best segmentations (best first; fewer if
    the text has fewer), and whether decoding gives the text back.

    A null text stays null in all columns but doc_id; an empty one has no pieces
    and score 0.  Equal scores come in the search's own fixed order.  A literal word mark in a text decodes as a space, so round_trip is
    false there.  Repeated rows give repeated results, an empty table none.
    With ``keep_ids`` false, ids is null; with ``keep_n_best``, n_best_ids holds the ids of the ``n`` best.
    """
    schema = _ENCODED + (", n_best_ids array<array<int>>" if keep_n_best else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in common.small(batches, 1, limit=1 << 22):
            texts = batch.column(1).to_pylist()
            for lo, hi in common.runs(texts, 1 << 21):
                yield _encoded(tool, batch.column(0).slice(lo, hi - lo), texts[lo:hi], n, keep_ids, keep_n_best)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids array<int>); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if i is None else tool.decode(i) for i in batch.column(1).to_pylist()], type=pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
