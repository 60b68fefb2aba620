"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon transducer reads each word of a clause as a symbol (insult, threat, target,
negation, reported speech, quotation mark, other).  Three transducers over these symbols
change what an insult or threat is worth: less in the reach of a negation, less when it is
reported or quoted, more when a target stands in its clause.  They are composed into one
machine; a clause weighs what its best path sums up to.  A document's features are those of
its matched clauses: the sum of their weights, the heaviest, and the weight a clause of the
document bears on average.  No word counts by itself.

Only the lexicon's insults and the logistic weights are learned; the latter are never
negative, so that a clause that weighs less never makes a document more toxic.  An insult is
a word or word stem (for languages with endings) that labelled rows tie to the label, and
its value the log odds of that tie.  The other word classes are fixed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .grammar import Lexicon, Transducer, compose

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n\"“”„«»]")
_CLAUSE_END = frozenset(".!?;:\n")

# Closed word classes in the four languages of the corpus, and seeds.
_QUOTE = '"“”„«»'
_THREAT = "kill hurt murder shoot stab burn destroy beat punish töten schlagen umbringen vernichten tuer frapper détruire tuerai matar golpear destruir mataré".split()
_TARGET = "you your you're yourself they them he she him her u du dich dir dein deine euch ihr sie tu toi te vous votre ton ta tú usted ustedes vosotros ti".split()
_NEGATION = "not no never neither nor isn't aren't wasn't don't doesn't nicht kein keine nie niemals pas jamais aucun ne nunca jamás ni".split()
_REPORT = "said says say called calls claimed claims quoted reported wrote tells told according sagte sagt nannte behauptet schrieb dit disait appelle écrit dijo dice llamó escribió".split()
_SEED_INSULTS = "idiot moron stupid loser scum trash".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = "other", "insult", "threat", "target", "negation", "report", "quote"
SYMBOLS = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE)
WEIGHED = (INSULT, THREAT)
FEATURES = 3


@dataclass(frozen=True)
class Params:
    #: About so many labelled rows are learned from.
    rows: int = 24_000
    stems: tuple[int, ...] = (4, 5, 6, 7)
    #: An insult stem or word occurs in at least so many toxic rows, this share of all rows that have it;
    #: ``fit`` chooses among the candidates by cross-validation on the rows that it learns from.
    support: int = 5
    precision: float = 0.9
    supports: tuple[int, ...] = (4, 8)
    precisions: tuple[float, ...] = (0.8, 0.9, 0.95)
    folds: int = 3
    #: What an insult or threat is worth by its place in the clause.
    aimed: float = 1.5
    negated: float = 0.2
    reported: float = 0.4
    unaimed_threat: float = 0.1
    #: Words that a negation reaches.
    reach: int = 3
    #: Value of a threat word and of a seed insult.
    fixed_value: float = 3.0
    threshold: float = 0.3


def negation(p: Params) -> Transducer:
    """States count the words still in reach."""
    t = Transducer([0], set(range(p.reach + 1)))
    for left in range(p.reach + 1):
        for s in SYMBOLS:
            then = p.reach if s == NEGATION else left if s == QUOTE else max(0, left - 1)
            t.arc(left, s, s, 0.0 if s not in WEIGHED else p.negated if left else 1.0, then)
    return t


def reported(p: Params) -> Transducer:
    """States are (after a verb of speech, inside quotation marks)."""
    states = [(said, quoted) for said in (False, True) for quoted in (False, True)]
    t = Transducer([(False, False)], set(states))
    for said, quoted in states:
        for s in SYMBOLS:
            then = (said or s == REPORT, quoted != (s == QUOTE))
            t.arc((said, quoted), s, s, p.reported if s in WEIGHED and (said or quoted) else 1.0, then)
    return t


def aimed(p: Params) -> Transducer:
    """Guesses at the start whether the clause has a target: one guess ends well only with one, the other only without."""
    t = Transducer(["aimed, not yet seen", "not aimed"], {"aimed, seen", "not aimed"})
    for s in SYMBOLS:
        for state in ("aimed, not yet seen", "aimed, seen"):
            t.arc(state, s, s, p.aimed if s in WEIGHED else 1.0, "aimed, seen" if s == TARGET else state)
        if s != TARGET:
            t.arc("not aimed", s, s, p.unaimed_threat if s == THREAT else 1.0, "not aimed")
    return t


def clause_machine(p: Params) -> Transducer:
    return compose(compose(negation(p), reported(p)), aimed(p))


@dataclass
class Model:
    """A lexicon's learned part and the logistic weights; ``memory`` bounds the words remembered."""

    #: Learned insults and their values; a word by itself is led by "=", a stem isn't.
    stems: dict[str, float]
    #: Intercept and one weight, not negative, per feature.
    weights: np.ndarray
    params: Params
    memory: int = 400_000
    machine: Transducer = field(init=False, repr=False)
    lexicon: Lexicon = field(init=False, repr=False)
    _symbols: dict[str, tuple[str, float]] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.machine, self.lexicon = clause_machine(self.params), Lexicon(OTHER)
        for forms, symbol in ((_QUOTE, QUOTE), (_NEGATION, NEGATION), (_TARGET, TARGET), (_REPORT, REPORT)):
            self.lexicon.add(forms, symbol)
        self.lexicon.add(_THREAT, THREAT, self.params.fixed_value)
        for form, value in self.stems.items():
            self.lexicon.add([form.removeprefix("=")], INSULT, value, stem=not form.startswith("="))
        self.lexicon.add(_SEED_INSULTS, INSULT, self.params.fixed_value)

    def symbols(self, words: list[str]) -> list[tuple[str, float]]:
        """What the words are read as.  Words are remembered; beyond ``memory`` of them it starts anew."""
        new = set(words).difference(self._symbols)
        if len(self._symbols) + len(new) > self.memory:
            self._symbols.clear()
            new = set(words)
        for w in new:
            self._symbols[w] = self.lexicon.read(w)
        return [self._symbols[w] for w in words]


def word_keys(words: set[str], p: Params) -> set[str]:
    """What may become an insult: each word itself (marked) and its prefixes."""
    return {"=" + w for w in words} | {w[:n] for w in words for n in p.stems if len(w) >= n}


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def clause_weights(tokens: list[str], model: Model) -> tuple[list[float], int]:
    """The weights of the matched clauses of a whole text's tokens, and the number of its clauses.

    A quotation goes on in the next clause, but ends with its line.
    """
    symbols = model.symbols(tokens)
    if not any(s in WEIGHED for s, _ in symbols):
        return [], 0
    out, n, clause = [], 0, []
    for token, symbol in zip([*tokens, "\n"], [*symbols, (OTHER, 0.0)], strict=True):
        if token in _CLAUSE_END:
            n += bool(clause)
            if any(s in WEIGHED for s, _ in clause):
                out.append(model.machine.best(clause) or 0.0)
            quoted = sum(s == QUOTE for s, _ in clause) % 2 == 1 and token != "\n"
            clause = [(QUOTE, 0.0)] if quoted else []
        else:
            clause.append(symbol)
    return out, n


def features(tokens: list[str], model: Model) -> np.ndarray:
    """Of a whole text's matched clauses: summed weight, heaviest, weight per clause of the text (logs)."""
    weights, n = clause_weights(tokens, model)
    total = sum(weights)
    return np.log1p([total, max(weights, default=0.0), 20 * total / max(1, n)])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps, intercept first; a feature whose weight
    would be negative is left out and the rest fitted anew."""
    own = list(range(x.shape[1]))
    while True:
        a = np.hstack([np.ones((len(x), 1)), x[:, own]])
        w = np.zeros(a.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        if not own or w[1:].min() >= 0:
            out = np.zeros(1 + x.shape[1])
            out[[0, *(1 + i for i in own)]] = w
            return out
        own.pop(int(np.argmin(w[1:])))


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))


def quality(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[float, float, np.ndarray]:
    """(F1 at the threshold, negative log loss, logistic weights) of features of rows."""
    w = _logistic(x, y)
    p = np.clip(probability(x, w), 1e-9, 1 - 1e-9)
    hit = ((p >= threshold) & (y == 1)).sum()
    return 2 * hit / max(1, (p >= threshold).sum() + (y == 1).sum()), float(np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))), w


def fit(documents: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """Learns from labelled rows that are not held out, and chooses its bounds by them alone.

    The rows are a sample of about ``rows`` ids drawn by a hash; an id that any label calls
    toxic is toxic, and of several texts of one id the least counts.  They are dealt to folds by
    another hash.  For each candidate bound of support and precision, the insults of all folds
    but one give the features of that fold's rows; the candidate whose features, over all folds,
    tell the labels apart best (F1 at the threshold, then log loss) is taken, with the logistic
    weights of these features, and its insults are those of all rows.  Word counts are summed in
    Spark, by fold; the driver gets the insults that pass and, per sampled id, three features
    a candidate.  Without rows the model has no learned insults.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~common.held_out("doc_id"))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("double").alias("toxic"))
    share = min(1.0, p.rows / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20))
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(p.folds)).cast("int").alias("fold")
    rows = common.written(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic", fold))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small(batches, 0):
            forms, toxic, folds = [], [], []
            for text, label, own_fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = word_keys({t for t in tokens_of(text) if t[0].isalpha()}, p)
                forms += own
                toxic += [label] * len(own)
                folds += [own_fold] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array(toxic, pa.float64()), pa.array(folds, pa.int32())], names=["form", "toxic", "fold"])

    sums = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}_{f}") for f in range(p.folds) for c in ("toxic", "one")]
    counts = rows.mapInArrow(keys, "form string, toxic double, fold int").withColumn("one", F.lit(1.0)).groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("one").alias("one"), *sums)
    passes = F.lit(False)
    for f in (None, *range(p.folds)):  # any candidate, with or without any fold
        yes, n = (F.col(c) - (F.lit(0.0) if f is None else F.col(f"{c}_{f}")) for c in ("toxic", "one"))
        passes |= (yes >= min(p.supports)) & (yes >= min(p.precisions) * n)
    passed = [r.asDict() for r in counts.filter(passes).collect()]

    def insults(support: int, precision: float, without: int | None) -> dict[str, float]:
        out = {}
        for r in passed:
            yes, n = (r[c] - (0 if without is None else r[f"{c}_{without}"]) for c in ("toxic", "one"))
            if yes >= support and yes >= precision * n:
                out[r["form"]] = math.log((yes + 0.5) / (n - yes + 0.5))
        return out

    candidates = [(s, q) for s in p.supports for q in p.precisions]
    none = np.r_[-3.0, np.zeros(FEATURES)]
    shared = documents.sparkSession.sparkContext.broadcast([[Model(insults(*c, f), none, p, 20_000) for c in candidates] for f in range(p.folds)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small(batches, 0):
            found = []
            for text, own_fold in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tokens = tokens_of(text)
                found.append(np.concatenate([features(tokens, m) for m in shared.value[own_fold]]).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, type=pa.list_(pa.float64()))], names=["toxic", "x"])

    seen = rows.mapInArrow(measure, "toxic double, x array<double>").toArrow()
    shared.destroy()
    common.discard(rows)
    best, chosen = (-1.0, 0.0, none), (p.support, p.precision)
    if seen.num_rows:
        y, x = seen["toxic"].to_numpy(), common.matrix(seen["x"]).reshape(seen.num_rows, len(candidates), FEATURES)
        best, chosen = max(((quality(x[:, i], y, p.threshold), c) for i, c in enumerate(candidates)), key=lambda r: r[0][:2])
    return Model(insults(*chosen, None), best[2], replace(p, support=chosen[0], precision=chosen[1]))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out boolean, score double (0 to 1), predicted int.

    Null and empty texts score as texts without any marked clause; texts are taken whole, however long.  Repeated rows
    give repeated results, an empty table none; only doc_id and text are looked at.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in common.small(batches, 2):
            x = np.array([features(tokens_of(t or ""), m) for t in batch.column(2).to_pylist()]).reshape(-1, FEATURES)
            s = probability(x, m.weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= m.params.threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
