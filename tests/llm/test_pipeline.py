import re

import corpus_pipeline
import public_tokenizers
from statuta.llm import common, neardup, pieces

SF = "/root/testdata/sf0.001"


def copied(texts, items):
    """Ids of the texts that hold 12 different windows of eight words of an item, or 30 % of all."""
    grams = lambda t: {tuple(w[k : k + 8]) for w in [re.findall(r"[^\W_]+", t.lower().replace("ß", "ss"))] for k in range(len(w) - 7)}
    wanted = [grams(x) for x in items]
    return {i for i, t in texts.items() for own in [grams(t)] for item in wanted if len(own & item) >= 12 or len(own & item) >= 0.3 * len(item)}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def hidden(text):
    """The text with what the plain patterns find replaced by its kind; the leftmost of overlapping finds counts."""
    found = []
    for order, (kind, pattern) in enumerate([("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+){3}"), ("card", r"[0-9](?:[\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                found.append((m.start(), order, m.end(), kind))
    out, last = "", 0
    for start, _, end, kind in sorted(found):
        if start >= last:
            out += text[last:start] + f"[{kind}]"
        last = max(last, end)
    return out + text[last:]


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(9_000_001, "12 34 !!", None, "s", 8), (9_000_002, None, "en", "s", 0)], docs.schema)
    rows, got = docs.union(junk), {}
    for name, stage in corpus_pipeline.STAGES:
        rows = common.written(stage(spark, rows, SF))
        got[name] = rows
        assert name == "sentencepiece" or rows.columns == docs.columns
    told = {r.doc_id: r.text for r in got["language id"].collect()}
    assert not {9_000_001, 9_000_002} & set(told) and len(told) > 0.95 * docs.count()

    sets = {}
    for i, t in told.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    single = {i for i in ids if find(i) == i}
    assert {r.doc_id for r in got["near duplicates"].collect()} == single

    leaks = copied(told, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert leaks and {r.doc_id for r in got["decontamination"].collect()} == single - leaks
    masked = {r.doc_id: r.text for r in got["personal data"].collect()}
    assert masked == {i: hidden(told[i]) for i in single - leaks} and any(masked[i] != told[i] for i in masked)
    last = got["sentencepiece"]
    assert {r.doc_id: r.text for r in pieces.decode(last, public_tokenizers.path("piece_bpe_32k.model")).collect()} == masked


def test_rows_without_an_id_or_with_a_shared_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    one, other, third = (" ".join(f"{w}{k}" for k in range(40)) for w in ("ab", "cd", "ef"))
    rows = [(None, one), (None, other), (None, item), (None, None), (1, one), (2, one + " x"), (3, other), (3, item), (4, other), (5, third), (5, third + " y"), (6, None), (7, third)]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema)
    stages = dict(corpus_pipeline.STAGES)

    def got(df):
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    single = common.written(stages["near duplicates"](spark, rows, SF))
    assert single.columns == docs.columns
    want = [(None, one), (None, other), (None, item), (None, None), (1, one), (3, other), (3, item), (6, None)]
    fifth = [x for x in got(single) if x[0] == 5]
    assert len(fifth) == 1 and got(single) == sorted(want + fifth, key=str)
    want = [x for x in want + fifth if x[1] != item]
    assert got(stages["decontamination"](spark, single, SF)) == sorted(want, key=str)
    distinct = rows.filter("doc_id IS NULL OR doc_id IN (1, 2, 4, 6)")
    want = [(None, one), (None, other), (None, item), (None, None), (1, one), (4, other), (6, None)]
    assert got(stages["near duplicates"](spark, distinct, SF)) == sorted(want, key=str)


CLASHING = ["_row", "_row_", "_digest", "row", "h", "t", "score", "lang_pred", "kept", "component_id", "ids", "item_id", "part", "n"]


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    wide = docs.selectExpr("*", *(f"concat('{c}', doc_id) AS `{c}`" for c in CLASHING))
    wide = common.written(wide.union(wide.filter("doc_id < 5")).union(wide.limit(3).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", *wide.columns[2:])))
    for name, stage in corpus_pipeline.STAGES:
        none, some = stage(spark, wide.limit(0), SF), stage(spark, wide, SF)
        assert none.count() == 0
        if name == "sentencepiece":
            assert some.count() == wide.count()
            continue
        assert some.columns == wide.columns and none.columns == wide.columns
        plain = sorted(map(str, (tuple(r) for r in stage(spark, wide.select(docs.columns), SF).collect())))
        got = some.collect()
        assert sorted(str(tuple(r)[: len(docs.columns)]) for r in got) == plain
        assert all(r[c] == f"{c}{r['_row'].removeprefix('_row')}" for r in got for c in CLASHING)
        assert all(r.doc_id is None or r["_row"] == f"_row{r.doc_id}" for r in got)


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and [n for n, _ in corpus_pipeline.STAGES] == ["language id", "near duplicates", "decontamination", "personal data", "sentencepiece"]
    assert neardup.Params().percent == 85
