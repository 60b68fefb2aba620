import collections
import math
import zlib

import numpy as np
from statuta.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 150 and (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all() and len(got) == 1000


def gram_buckets(text, p):
    """The buckets of a text's n-grams, one by one."""
    low, out = [ord(c) for c in text.lower()], []
    for n in p.orders:
        for i in range(len(low) - n + 1):
            h = n
            for c in low[i : i + n]:
                h = (h ^ c) * 0x9E3779B97F4A7C15 % (1 << 64)
            out.append((h >> 40) % p.buckets)
    return out


def test_counts_equal_a_plain_loop():
    p = langid.Params(buckets=1 << 10)
    texts = ["Straße Ñandú é — ab", "", "x", "İx", "ab" * 9]
    row, bucket = langid.sparse_counts(texts, p)
    for i, t in enumerate(texts):
        assert sorted(bucket[row == i].tolist()) == sorted(gram_buckets(t, p))


def test_table_equals_naive_bayes_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    p, rows = langid.Params(buckets=1 << 9), docs.collect()
    model = langid.fit(docs, p)
    counts, n_docs = collections.defaultdict(collections.Counter), collections.Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts[r.lang].update(gram_buckets(r.text, p))
            n_docs[r.lang] += 1
    want = {}
    for r in rows:
        grams = collections.Counter(gram_buckets(r.text, p))
        like = {x: math.log(n_docs[x] / sum(n_docs.values())) + sum(n * math.log((c[g] + p.smoothing) / (c.total() + p.smoothing * p.buckets)) for g, n in grams.items()) for x, c in counts.items()}
        best = max(sorted(like), key=like.get)
        want[r.doc_id] = (best, 1 / sum(math.exp(v - like[best]) for v in like.values()))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert {i: x for i, (x, _) in got.items()} == {i: x for i, (x, _) in want.items()}
    assert all(abs(got[i][1] - s) < 1e-6 for i, (_, s) in want.items())


def test_numerals_are_no_letters():
    m = langid.Model(["en", "es"], np.zeros((1 << 14, 2)), np.log([0.5, 0.5]), langid.Params())
    assert langid.predict_texts(["½ ²", "① 12", "_", "", None, "é", "字", "a"], m)[0] == ["und"] * 5 + ["en"] * 3


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (3, "der Hund und die Katze", "de"), (None, None, None), (4, "", "en"), (5, "123 ...", None), (1, "the cat and the dog", "en"), (6, "the and " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS lang_pred", "2 AS score")
    model = langid.fit(docs)
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(docs, model).collect()}
    assert {(None, "und"), (4, "und"), (5, "und")} <= got and (6, model.languages[-1]) in got
    none = docs.limit(0)
    assert langid.fit(none).languages == [] and langid.predict(none, langid.fit(none)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(none)).collect()} == {"und"}
