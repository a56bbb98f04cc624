import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evenkeel.llm import bpe, queries

PATH = queries.tokenizer_path()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_vocabulary(PATH))


def ids_of(encoder, texts):
    ids, counts = encoder.encode(texts)
    out, at = [], 0
    for n in counts:
        out.append(ids[at : at + n].tolist())
        at += n
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs", "Cn"))), max_size=4))
def test_ids_are_the_librarys(encoder, library, texts):
    assert ids_of(encoder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize(
    "text",
    ["", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "a" * 5000, "ab" * 3001, " \n\n  x", "it's we'LL", "\0\0"],
)
def test_special_long_and_odd_words(encoder, library, text):
    assert ids_of(encoder, [text]) == [library.encode(text, add_special_tokens=False).ids]


def test_long_words_by_the_heap_are_the_same(encoder):
    word = (b"thereandback" * 40)[:450]
    assert bpe.merge_long(word, encoder.v).tolist() == bpe.merge_rounds([word], encoder.v)[0].tolist()


def test_words_are_forgotten_and_learnt_again(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 3)
    encoder = bpe.Encoder(bpe.load_vocabulary(PATH))
    for text in ("one two three", "four five six", "one two seven eight nine"):
        assert ids_of(encoder, [text]) == [library.encode(text, add_special_tokens=False).ids]


def test_query_on_all_documents(spark, library):
    rows = {r.doc_id: r for r in queries.QUERIES["op1_bpe"].run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        r = rows[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_null_empty_and_repeated(spark, frame):
    df = frame([(1, None), (2, ""), (3, "same"), (3, "same")])
    out = df.select("doc_id", bpe.bpe_encode(spark, F.col("text"), PATH).alias("got"))
    out = out.select("doc_id", "got", bpe.bpe_decode(spark, F.col("got"), PATH).alias("back")).collect()
    assert [(r.got, r.back) for r in out[:2]] == [([], ""), ([], "")]
    assert out[2][1:] == out[3][1:] and out[2].back == "same"
    assert df.limit(0).select(bpe.bpe_encode(spark, F.col("text"), PATH).alias("x")).collect() == []


def test_decoding_odd_ids(spark):
    df = spark.createDataFrame([([-1, 10**6, 64],), (None,), ([], ), ([187],)], "ids array<int>")
    got = [r[0] for r in df.select(bpe.bpe_decode(spark, F.col("ids"), PATH)).collect()]
    v = bpe.load_vocabulary(PATH)
    byte = v.spelled[v.spelled_at[187] : v.spelled_at[188]].tobytes()
    a = v.spelled[v.spelled_at[64] : v.spelled_at[65]].tobytes().decode()
    assert got == [a, "", "", byte.decode("utf-8", "replace")]
