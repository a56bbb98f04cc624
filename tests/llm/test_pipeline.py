import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from evenkeel.llm.bpe import bpe_decode, bpe_encode
from evenkeel.llm.decontaminate import find_overlaps
from evenkeel.llm.pii import Finder
from test_minhash import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_every_query_is_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


def test_stages_and_run(spark, documents):
    docs = documents
    for name, stage in pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        if name != "bpe":
            assert docs.columns == documents.columns
        assert docs.count() <= before.count()
    rows = {r.doc_id: r for r in docs.collect()}
    assert all(r.exact and r.n_tokens == len(r.ids) for r in rows.values())
    whole = {r.doc_id: r.ids for r in pipeline.run(spark, SF).collect()}
    assert whole == {i: r.ids for i, r in rows.items()}


def test_copies_stage_keeps_the_first_of_each_group(spark, documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    kept = {i for i, (_, _, keep) in brute(docs, 5).items() if keep}
    assert {r.doc_id for r in pipeline.drop_copies(spark, documents, SF).collect()} == kept


def test_leaks_stage_drops_passages_only(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    left = {r.doc_id for r in pipeline.drop_leaks(spark, documents, SF).collect()}
    hit = {r.doc_id for r in find_overlaps(documents, items).collect()}
    assert hit and left == {r.doc_id for r in documents.collect()} - hit


def test_personal_data_is_gone(spark, documents):
    finder = Finder()
    for r in pipeline.hide_personal(spark, documents, SF).collect():
        assert not [s for s in finder.spans(r.text) if s[1] < 4] and r.n_chars == len(r.text)


def test_toxic_stage_keeps_clean_documents(spark, documents):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in pipeline.drop_toxic(spark, documents, SF).collect()}
    clean = [i for i, t in labels.items() if t == 0]
    assert sum(i in left for i in clean) >= 0.95 * len(clean)


def test_odd_rows_pass_every_stage(spark, frame):
    rows = [(1, None), (2, ""), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "A b c d e f"), (4, "z")]
    for some in (rows, []):
        docs = frame(some) if some else frame(rows).limit(0)
        for name, stage in pipeline.STAGES:
            columns = docs.columns
            docs = stage(spark, docs, SF)
            assert name == "bpe" or docs.columns == columns
        left = sorted((str(r.doc_id), r.n_tokens) for r in docs.collect())
        assert [i for i, _ in left] == (["1", "2", "3", "4", "None"] if some else [])


def test_columns_of_any_name_and_type_pass(spark):
    schema = (
        "doc_id long, text string, `a.b` string, m map<string, string>, __toxicity double, toxicity double, "
        "gone string, again string, row long, n_chars long"
    )
    text = "a b c d e f g"
    rows = [(i, t, "x", {"k": "v"}, 0.5, 0.5, "g", "a", 7, 3) for i, t in ((1, text), (1, text), (1, "z"), (2, text), (3, "q"), (None, text))]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in pipeline.STAGES:
        columns = docs.columns
        docs = pipeline.written(stage(spark, docs, SF), name)
        assert name == "bpe" or docs.columns == columns
        if name != "bpe":
            assert {(r["a.b"], tuple(r["m"].items()), r["row"]) for r in docs.collect()} == {("x", (("k", "v"),), 7)}
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "3", "None"]


def test_ids_and_their_text_come_from_one_python_worker_a_task(spark, frame):
    docs = frame([(1, None), (2, ""), (3, "some words, twice <|endoftext|> ünï"), (4, "x" * 3000)])
    coded = pipeline.to_ids(spark, docs, SF)
    assert coded._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    path = pipeline.tokenizer_path()
    apart = docs.select("doc_id", bpe_encode(spark, F.col("text"), path).alias("ids"))
    apart = apart.select("doc_id", "ids", bpe_decode(spark, F.col("ids"), path).alias("decoded"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    expected = [(r.doc_id, len(r.ids), r.ids, r.decoded == texts[r.doc_id]) for r in apart.collect()]
    assert [tuple(r) for r in coded.collect()] == expected and all(e[3] for e in expected)
