import re

from statuta.llm import decontam

SF = "/root/testdata/sf0.01"


def tokens(text):
    """The template by a plain loop over characters and words."""
    words = "".join(c if c.isalnum() or __import__("unicodedata").category(c)[0] == "M" else " " for c in text).split()
    out = []
    for w in words:
        t = re.sub("[0-9]+", "0", w)
        if out and out[-1] == "0" and t in decontam.UNITS.split():
            t = "1"
        elif t[:1].isupper() and all(not c.isnumeric() for c in t):
            t = "2"
        out.append(t.lower())
    return out


def test_passages_equal_brute_force(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    items = {r.item_id: tokens(r.text) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        own = tokens(r.text)
        grams = {tuple(own[i : i + 8]) for i in range(len(own) - 7)}
        for i, t in items.items():
            used = [w for w in (tuple(t[k : k + 8]) for k in range(len(t) - 7)) if sum(x not in "012" for x in w) >= 3]
            n = sum(w in grams for w in used)
            if used and n and (n / len(used) >= 0.3 or n >= 12):
                want.add((r.doc_id, i))
    assert got == want and want


ITEM = "Alice has 12 apples and gives 5 km of rope to Robert before she walks home with the remaining 7 apples in a basket"


def run(spark, text, item=ITEM):
    docs = spark.createDataFrame([(1, text, 0)], "doc_id long, text string, h int")
    return [r.asDict() for r in decontam.contaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()]


def test_reparameterised_question_is_caught(spark):
    text = "intro words here. " + ITEM.replace("Alice", "Bertha").replace("Robert", "Otto").replace("12", "31").replace("km", "miles").replace("5 miles", "6 mi") + " and more"
    (hit,) = run(spark, text)
    assert hit["changed_slots"] >= 4 and hit["consistency"] == 1 and hit["coverage"] == 1
    (copy,) = run(spark, "x y z " + ITEM)
    assert copy["changed_slots"] == 0 and copy["coverage"] == 1


def test_inconsistent_fillers_are_no_hit(spark):
    item = "Anna met Anna and then Anna saw Anna while Anna told Anna about Anna or Anna and so Anna left Anna with Anna by noon"
    names = iter("Bea Cid Dov Eli Fay Gus Hal Ida Jan Kai Lea".split())
    assert run(spark, re.sub("Anna", lambda m: next(names), item), item) == []
    assert len(run(spark, item.replace("Anna", "Bea"), item)) == 1


def test_exact_copies_of_any_length_case_and_slots(spark):
    short, named, numbers = "What is the capital of France?", "Do Anna Maria Jones and Peter Paul Smith know Berlin", "1 2 3 4 5 6 7 8 9 10 11 12"
    bench = [(1, short), (2, named), (3, numbers), (4, ITEM), (5, "Why?"), (6, "«a a a»"), (7, "a a a a"), (8, "!?"), (9, "0 0 0 0 0 0 0 0 0"), (10, "Große Straße")]
    texts = {
        1: ("he asked: " + short + " Paris", {1}),
        2: ("WHAT IS THE CAPITAL OF FRANCE", {1}),
        3: ("what is the capital of Spain", set()),
        4: ("so: " + named.lower() + " well", {2}),
        5: ("count " + numbers + " done", {3}),
        6: (ITEM.upper(), {4}),
        7: ("why", {5}),
        8: ("b a a a b", {6}),
        9: ("b a a a a", {6, 7}),
        10: ("11 22 33 44 55 66 77 88 99", set()),
        11: ("What is the capital", set()),
        12: ("GROSSE STRASSE", {10}),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()] + [(13, None), (14, "")], "doc_id long, text string")
    found = decontam.contaminated(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()
    got = {i: {r.item_id for r in found if r.doc_id == i} for i in range(1, 15)}
    assert got == {i: w for i, (_, w) in texts.items()} | {13: set(), 14: set()}
    assert len(found) == sum(map(len, got.values())) and all(r.consistency == 1 for r in found)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, ITEM), (3, ITEM), (3, ITEM), (4, ITEM + " x" * 60_000)], "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS windows")
    bench = spark.createDataFrame([(9, ITEM), (10, None), (None, ITEM), (11, "too short"), (12, ITEM)], "item_id long, text string").selectExpr("*", "1 AS doc_id")
    got = sorted(((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()), key=str)
    assert got == sorted([(d, i) for d in (None, 3, 4) for i in (9, 12)], key=str)
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == [1, 2]


def test_no_python_in_the_plan(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    plan = decontam.contaminated(docs, bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
