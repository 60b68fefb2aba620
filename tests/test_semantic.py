"""Latent semantic vectors: the decomposition, and what it is worth."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from statuta.operators import segment, semantic


def test_vectors_span_the_leading_singular_vectors(spark):
    rng = random.Random(1)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(4)]
    texts = [" ".join(rng.choice(topics[i % 4]) for _ in range(15)) for i in range(200)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("n", None), ("e", "")], "id string, content string")
    m = semantic.SemanticVectors(df, dim=4, rounds=4)
    a = semantic.weighted([t.split() for t in texts], m.places, m.idf)
    want = np.linalg.svd(a, full_matrices=False)[2][:4]
    assert np.linalg.norm(want @ m.vectors, ord=2) == pytest.approx(1, abs=1e-3) and np.allclose(m.vectors.T @ m.vectors, np.eye(4), atol=1e-8)
    got = {r.id: np.array(r.embedding) for r in m.embed(df.withColumn("x", F.lit(1))).collect()}
    same, other = got["0"] @ got["4"], got["0"] @ got["1"]
    assert same > 0.9 > 0.5 > other and not got["n"].any() and not got["e"].any()
    again = semantic.SemanticVectors(df.repartition(3), dim=4, rounds=4)
    assert again.places == m.places and np.allclose(again.vectors, m.vectors, atol=1e-6)
    empty = semantic.SemanticVectors(df.limit(0), dim=4)
    assert all(not any(r.embedding) and len(r.embedding) == 4 for r in empty.embed(df).collect())


def retrieved(vectors, copies, k=5):
    """Share of copies whose original is among the k nearest."""
    order = np.argsort(-(copies @ vectors.T), axis=1, kind="stable")[:, :k]
    return np.mean([i in row for i, row in enumerate(order)])


def test_remnants_of_texts_find_their_originals(spark):
    """Texts of which a share of the words is left, against all others: of light revisions both embeddings
    find nearly all, of remnants the learned one finds more."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect()]
    docs = [t for t in dict.fromkeys(docs) if len(t.split()) >= 20]
    df = spark.createDataFrame([(f"d{i:05}", t) for i, t in enumerate(docs)], "id string, content string")
    m = semantic.SemanticVectors(df)
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    for left, least, better in ((0.5, 0.95, False), (0.15, 0.8, True)):
        rng = random.Random(7)
        cut = [" ".join(w for w in t.split() if rng.random() < left) for t in docs]
        learned = [semantic.weighted([t.lower().split() for t in x], m.places, m.idf) @ m.vectors for x in (docs, cut)]
        hashed = [np.array(segment.hashing_model()(x)) for x in (docs, cut)]
        a, b = (retrieved(*map(unit, pair)) for pair in (learned, hashed))
        print("left", left, "found within 5: semantic", a, "hashed", b)
        assert a > least and bool(a > b) is better
