"""Small weighted transducers and their composition.

An arc reads a symbol, writes one, multiplies the symbol's value by a factor and goes
to a state.  Machines are composed into one whose states are pairs, whose arcs chain
both arcs, and whose factors are products.  What a machine makes of a string is, over
its accepting paths, the greatest sum of the values that it writes.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence
from dataclasses import dataclass, field

State = Hashable
Symbol = str


@dataclass
class Transducer:
    starts: list[State]
    finals: set[State]
    #: (state, read) to arcs (written, factor, next state).
    arcs: dict[tuple[State, Symbol], list[tuple[Symbol, float, State]]] = field(default_factory=dict)

    def arc(self, state: State, read: Symbol, written: Symbol, factor: float, then: State) -> None:
        self.arcs.setdefault((state, read), []).append((written, factor, then))

    def best(self, symbols: Sequence[tuple[Symbol, float]]) -> float | None:
        """The greatest sum of values over the accepting paths; None if there is none."""
        live: dict[State, float] = dict.fromkeys(self.starts, 0.0)
        for read, value in symbols:
            then: dict[State, float] = {}
            for state, total in live.items():
                for _, factor, at in self.arcs.get((state, read), ()):
                    new = total + factor * value
                    if new > then.get(at, float("-inf")):
                        then[at] = new
            live = then
        return max((total for state, total in live.items() if state in self.finals), default=None)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that feeds what ``first`` writes to ``second``; states that can't be reached are left out."""
    todo = [(a, b) for a in first.starts for b in second.starts]
    out, seen = Transducer(list(todo), set()), set(todo)
    while todo:
        a, b = pair = todo.pop()
        if a in first.finals and b in second.finals:
            out.finals.add(pair)
        for (state, read), arcs in first.arcs.items():
            if state != a:
                continue
            for middle, f, a2 in arcs:
                for written, g, b2 in second.arcs.get((b, middle), ()):
                    out.arc(pair, read, written, f * g, (a2, b2))
                    if (a2, b2) not in seen:
                        seen.add((a2, b2))
                        todo.append((a2, b2))
    return out


class Lexicon:
    """A letter transducer from words to (symbol, value): a trie whose ends are exact
    forms or stems, which any ending may follow.  An exact form beats a stem, a longer
    stem a shorter one; of equal forms the one added first stays."""

    def __init__(self, other: Symbol) -> None:
        self.other = other
        self._next: list[dict[str, int]] = [{}]
        self._exact: dict[int, tuple[Symbol, float]] = {}
        self._stem: dict[int, tuple[Symbol, float]] = {}

    def add(self, forms: Iterable[str], symbol: Symbol, value: float = 0.0, stem: bool = False) -> None:
        for form in forms:
            at = 0
            for ch in form:
                if ch not in self._next[at]:
                    self._next[at][ch] = len(self._next)
                    self._next.append({})
                at = self._next[at][ch]
            (self._stem if stem else self._exact).setdefault(at, (symbol, value))

    def read(self, word: str) -> tuple[Symbol, float]:
        at, found = 0, (self.other, 0.0)
        for ch in word:
            at = self._next[at].get(ch, -1)
            if at < 0:
                return found
            found = self._stem.get(at, found)
        return self._exact.get(at, found)
