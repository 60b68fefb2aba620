import random
import re

import numpy as np
from statuta.llm import neardup, shingle

LOWER = {c: c + 32 for c in range(65, 91)}


def word_sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute(rows, percent=85):
    sets = word_sets(rows)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ids, meet = sorted(sets), {}
    for i in ids:
        for s in sets[i]:
            meet.setdefault(s, []).append(i)
    pairs = {(a, b) for own in meet.values() for n, a in enumerate(own) for b in own[n + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}


def family(rng, base, n, first):
    """Copies of a text with a few private edits each."""
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"e{first + i}x{rng.randrange(999)}"
        out.append((first + i, " ".join(w)))
    return out


def test_families_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    rows = [r for f in range(6) for r in family(rng, [rng.choice(words) for _ in range(rng.choice((60, 120, 150)))], 40, 1000 * f)]
    rows += [(9000 + i, " ".join([rng.choice(words) for _ in range(60)] + passage)) for i in range(80)]
    rows += [(9500 + i, rows[3][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)


def test_documents_equal_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One two"), (3, "one TWO"), (9, "one two three"), (10, "x " * 60_000), (11, "x " * 50_000), (12, "É a b c d"), (13, "é a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS component_id", "2 AS n_shingles")
    want = brute(rows)
    assert got(df) == want and want[8][1] == 3 and want[11][1] == 10 and want[13][1] == 13
    twice = neardup.near_duplicates(df.union(df)).collect()
    assert len(twice) == 20 and {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in twice} == want
    none = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.kept) for r in neardup.near_duplicates(none).collect()), key=str) == [(1, True), (None, True)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_pairs_under_the_distance_meet():
    p, rng = neardup.Params(), np.random.default_rng(3)
    a = rng.integers(0, 1 << 60, (300, p.chunks * p.size)).astype(np.uint64)
    b = a.copy()
    for row in b:
        row[rng.choice(len(row), p.distance, replace=False)] += np.uint64(1)
    x, y = neardup.index_keys(a, p), neardup.index_keys(b, p)
    assert (x == y).any(axis=1).all()


def test_shingles_equal_plain_words():
    hasher = shingle.WordHasher()
    texts = ["", "a", "a  B\tc d e F g", "A b c d e", "x y " * 500, "ünï cödé Ä b c d"]
    sizes = [len(shingle.shingle_set(hasher.words(np.frombuffer(t.encode(), np.uint8)))) for t in texts]
    assert sizes == [len(s) for s in word_sets(enumerate(texts)).values()]


def test_several_texts_under_one_id(spark):
    one, two = (" ".join(f"{w}{k}" for k in range(40)) for w in ("ab", "cd"))
    rows = [(1, one), (2, one + " x"), (2, two), (3, two), (3, two), (4, two + " y"), (None, one), (2, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, 36, 1, True), (2, 37, 1, False), (2, 36, 2, True), (3, 36, 2, False), (3, 36, 2, False), (4, 37, 2, False), (None, 36, None, True), (2, 0, 2, True)]
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got))) == sorted(map(str, want))


def test_linked_members_of_a_hub_do_not_meet_one_another(spark):
    """m linked members and an outsider under one key cost about 2m rows; every pair of different components meets."""
    p, m = neardup.Params(), 300
    rows = [(0, x, False, 1, 100, 20, 5, 3, True, True) for x in range(1, m)] + [(0, m, False, m, 100, 20, 5, 3, True, True)] + [(0, x, False, 1, 100, 20, 6, 3, True, True) for x in range(1, m)]
    keys = spark.createDataFrame(rows, neardup._DELTA)
    met = {(r.s_x, r.l_x) for r in neardup.meetings(keys, p).collect()}
    assert met == {(x, m) for x in range(1, m)} | {(m, x) for x in range(1, m)}


def test_revised_template_equals_brute_force(spark):
    """Families that are linked among themselves and share most words with one another's hub."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    template = [rng.choice(words) for _ in range(200)]
    rows = [r for f in range(3) for r in family(rng, template + [rng.choice(words) for _ in range(62)], 60, 1000 * f)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
