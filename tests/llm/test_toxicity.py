import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from statuta.llm import grammar
from statuta.llm import toxicity as tox

SF = "/root/testdata/sf0.1"
P = tox.Params()


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    m = tox.fit(docs, labels)
    got = tox.score(docs, m).join(labels.select("doc_id", "toxic"), "doc_id").toPandas()
    held = got[got.held_out]
    yes, no = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    auc = ((yes[:, None] > no).mean() + (yes[:, None] == no).mean() / 2)
    caught, wrong = (yes >= 0.3).sum(), (no >= 0.3).sum()
    print("auc", auc, "recall", caught / len(yes), "precision", caught / (caught + wrong), "weights", m.weights, len(m.stems), m.params.support, m.params.precision)
    assert len(yes) > 50 and auc > 0.9 and caught >= 0.8 * len(yes) and caught >= 0.8 * (caught + wrong)
    assert (m.weights[1:] >= 0).all()


def worth(symbols, p=P):
    """The clause's weight from the words of the specification, by plain loops."""
    total, has_target = 0.0, any(s == tox.TARGET for s, _ in symbols)
    for i, (s, value) in enumerate(symbols):
        if s not in tox.WEIGHED:
            continue
        before = [x for x, _ in symbols[:i]]
        words = [x for x in before if x != tox.QUOTE]
        value *= p.negated if tox.NEGATION in words[max(0, len(words) - p.reach) :] else 1
        value *= p.reported if tox.REPORT in before or before.count(tox.QUOTE) % 2 else 1
        value *= p.aimed if has_target else p.unaimed_threat if s == tox.THREAT else 1
        total += value
    return total


def test_machine_equals_the_specification_on_all_short_clauses():
    machine = tox.clause_machine(P)
    for n in range(6):
        for clause in itertools.product(tox.SYMBOLS, repeat=n):
            own = [(s, 2.0 if s == tox.INSULT else 3.0) for s in clause]
            assert machine.best(own) == pytest.approx(worth(own)), clause


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(tox.SYMBOLS), st.floats(0, 5)), max_size=30))
def test_machine_equals_the_specification_on_long_clauses(clause):
    assert tox.clause_machine(P).best(clause) == pytest.approx(worth(clause))


def every_path(t, symbols):
    """(what is written, product of factors by place) of each accepting path, by recursion."""

    def go(state, i):
        if i == len(symbols):
            return [((), ())] if state in t.finals else []
        return [((w, *ws), (f, *fs)) for w, f, then in t.arcs.get((state, symbols[i]), ()) for ws, fs in go(then, i + 1)]

    return [x for s in t.starts for x in go(s, 0)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from("ab"), st.sampled_from("ab"), st.integers(0, 3), st.integers(0, 2)), max_size=10), st.lists(st.tuples(st.integers(0, 2), st.sampled_from("ab"), st.sampled_from("ab"), st.integers(0, 3), st.integers(0, 2)), max_size=10), st.text(alphabet="ab", max_size=4))
def test_composition_chains_all_paths(one, two, text):
    made = []
    for arcs in (one, two):
        t = grammar.Transducer([0, 1], {1, 2})
        for state, read, written, factor, then in arcs:
            t.arc(state, read, written, factor, then)
        made.append(t)
    chained = [(out, tuple(f * g for f, g in zip(fs, gs, strict=True))) for middle, fs in every_path(made[0], text) for out, gs in every_path(made[1], middle)]
    both = grammar.compose(*made)
    assert sorted(every_path(both, text)) == sorted(chained)
    best = both.best([(c, 1.0) for c in text])
    assert best == max((sum(f) for _, f in chained), default=None)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(alphabet="abc", min_size=1, max_size=4), st.booleans(), max_size=8), st.text(alphabet="abc", max_size=6))
def test_lexicon_takes_exact_forms_then_the_longest_stem(forms, word):
    lexicon = grammar.Lexicon("no")
    for i, (form, stem) in enumerate(forms.items()):
        lexicon.add([form], form, float(i), stem=stem)
    if forms.get(word) is False:
        want = word
    else:
        want = max((f for f, stem in forms.items() if stem and word.startswith(f)), key=len, default="no")
    assert lexicon.read(word)[0] == want


def model(**stems):
    return tox.Model(stems or {"=idiot": 3.0, "clown": 3.0}, np.array([-3.0, 1.0, 1.0, 1.0]), P)


def test_held_out_labels_change_nothing(spark):
    """Bounds, insults and weights stay the same whatever the held-out rows are labelled."""
    from pyspark.sql import functions as F
    from statuta.llm import common

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(common.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert turned.exceptAll(labels).count() > 20
    a, b = tox.fit(docs, labels), tox.fit(docs, turned)
    assert a.params == b.params and a.stems == b.stems and np.allclose(a.weights, b.weights)


def document_score(text, m):
    """A document's score from its clauses by the words of the specification, without the machine or the trie."""
    weights, n, clause = [], 0, []
    def read(word):
        for words, symbol in ((tox._QUOTE, tox.QUOTE), (tox._NEGATION, tox.NEGATION), (tox._TARGET, tox.TARGET), (tox._REPORT, tox.REPORT), (tox._THREAT, tox.THREAT)):
            if word in words:
                return symbol, 3.0 if symbol == tox.THREAT else 0.0
        if "=" + word in m.stems:
            return tox.INSULT, m.stems["=" + word]
        if word in tox._SEED_INSULTS:
            return tox.INSULT, 3.0
        stem = max((f for f in m.stems if not f.startswith("=") and word.startswith(f)), key=len, default=None)
        return (tox.INSULT, m.stems[stem]) if stem else (tox.OTHER, 0.0)

    for token in [*tox.tokens_of(text), "\n"]:
        if token in ".!?;:\n":
            n += bool(clause)
            if any(s in tox.WEIGHED for s, _ in clause):
                weights.append(worth(clause, m.params))
            quoted = sum(s == tox.QUOTE for s, _ in clause) % 2 == 1 and token != "\n"
            clause = [(tox.QUOTE, 0.0)] if quoted else []
        else:
            clause.append(read(token))
    total = sum(weights)
    x = [np.log1p(total), np.log1p(max(weights, default=0)), np.log1p(20 * total / max(1, n) if weights else 0)]
    return 1 / (1 + np.exp(-(m.weights[0] + np.dot(m.weights[1:], x))))


def test_scores_equal_the_specification(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    m = tox.fit(docs, labels)
    assert m.stems
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = tox.score(docs, m).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.score == pytest.approx(document_score(texts[r.doc_id], m)) and r.predicted == (r.score >= 0.3)


def test_clauses_not_words():
    m = model()

    def w(text):
        return pytest.approx(tox.clause_weights(tox.tokens_of(text), m)[0])

    assert [4.5] == w("you are an idiot") and [3.0] == w("an idiot of a book")
    assert [0.9] == w("you are not an idiot") and [3.0 * 0.2] == w("it is never an idiot")
    assert [2 * 4.5 * 0.4] == w("he said you idiot and clowns") and [4.5] == w("i will kill you") and [0.3] == w("i will kill time")
    assert [1.2, 1.2, 3.0] == w('"an idiot. a clown" book\nclown')
    assert [3.0] == w('"a\nclown') and tox.clause_weights(tox.tokens_of("all is well"), m) == ([], 0)
    order = [tox.features(tox.tokens_of(t), m) for t in ("it is not an idiot today", "he said it is an idiot", "it is such an idiot today", "you are such an idiot today")]
    score = [float(m.weights[1:] @ x) for x in order]
    assert score == sorted(score) and len(set(score)) == 4


def test_weights_are_never_negative():
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = (x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=400) > 0).astype(float)
    w = tox._logistic(x, y)
    assert w[1] > 0 and w[2] == 0 and (w[1:] >= 0).all()


def test_edges(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (1, "you idiot"), (2, None), (3, ""), (None, "x " * 100_000)], "doc_id long, text string").selectExpr("*", "1 AS score", "'en' AS lang")
    got = [(r.doc_id, r.predicted) for r in tox.score(docs, model()).collect()]
    assert got.count((1, 1)) == 2 and {(2, 0), (3, 0), (None, 0)} <= set(got)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    empty = tox.fit(docs, none)
    assert empty.stems == {} and tox.score(docs, empty).count() == 5 and tox.score(docs.limit(0), empty).count() == 0
    both = spark.createDataFrame([(1, 0), (1, 1), (3, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    assert tox.fit(docs, both, tox.Params(supports=(1,), precisions=(0.9,))).stems.keys() == {"=you", "=idiot", "idio", "idiot"}
