import duckdb
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from statuta.llm import tokencount
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def lib(texts):
    return [len(e.ids) for e in LIB.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(texts):
    assert tokencount.counter(PATH).count(texts) == lib(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab'stre1<|>. \x1c　é", max_size=80), max_size=5))
def test_white_space_and_contractions(texts):
    texts = [*texts, "a<|endoftext|> b <|endoftext|>"]
    assert tokencount.counter(PATH).count(texts) == lib(texts)


def test_documents_and_long_runs():
    texts = [r[0] for r in duckdb.connect().sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    texts += ["a" * 20_000, "aaa" * 7 + " " * 500, "", "x y  z"]
    assert tokencount.counter(PATH).count(texts) == lib(texts)


def test_frame(spark):
    df = spark.createDataFrame([(1, "hello world", 0), (1, "hello world", 1), (2, None, 2), (3, "", 3)], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, tokencount.token_counts(df, PATH, limit=1).collect()))
    assert got == [(1, 11, 2, True), (1, 11, 2, True), (2, 0, 0, False), (3, 0, 0, False)]
    assert tokencount.token_counts(df.limit(0), PATH).count() == 0
