import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import queries, toxicity
from evenkeel.llm.toxicity import Scorer, subwords, toxicity_model, train

SF = "/root/testdata/sf0.1"
BAD = ["horrid", "wretched", "vileness"]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    vocab = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 8))) for _ in range(800)]
    bad = ["horrid", "wretched", "vileness"]
    texts, toxic = [], []
    for i in range(900):
        words = rng.choices(vocab, k=rng.randint(5, 200))
        if i % 4 == 0:
            words += rng.choices(bad, k=3)
            rng.shuffle(words)
        texts.append(" ".join(words))
        toxic.append(int(i % 4 == 0))
    return train(texts, toxic), vocab


def scores(model, texts):
    return Scorer(model).score(texts)


def test_misspellings_not_seen_score_like_their_word(model):
    model, vocab = model
    plain = " ".join(vocab[:30])
    clean, seen, unseen = scores(model, [plain, f"{plain} horrid wretched horrid", f"{plain} horridd wretchedd horridd"])
    assert clean < 0.3 and seen > 0.7 and unseen > 0.7


def test_a_few_words_count_in_longer_texts_too(model):
    model, vocab = model
    long = " ".join(vocab[:90])
    clean, toxic = scores(model, [long, long + " horrid wretched vileness"])
    assert toxic > 0.7 > clean


@pytest.mark.parametrize("times", [1, 10])
def test_a_few_words_count_among_hundreds_and_thousands_of_clean_ones(model, times):
    model, vocab = model
    long = vocab * times
    half = len(long) // 2
    clean, last, amid = scores(
        model,
        [" ".join(ws) for ws in (long, long + BAD, long[:half] + BAD + long[half:])],
    )
    assert last > 0.7 > 0.3 > clean and amid > 0.7


def test_training_texts_are_taken_by_hash_whatever_their_length(spark, frame, monkeypatch):
    docs = frame([(i, "word " * (10 + 40 * (i % 5))) for i in range(100)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 20_000)
    lens = [len(t) for t in toxicity.training_rows(docs, labels)[0]]
    assert 15_000 < sum(lens) <= 20_000 and len(set(lens)) == 5


@pytest.mark.parametrize("ids", [[], [1, 2, 2, 3]])
def test_training_rows_start_no_python_workers(spark, monkeypatch, ids):
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 4)], "doc_id long, toxic int")

    def refused(*args, **kwargs):
        raise AssertionError("rows went through Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    assert toxicity.training_rows(docs, labels) == ((["text 1", "text 2"], [1, 0]) if ids else ([], []))


def test_words_met_in_a_few_texts_count_too():
    rng = random.Random(2)
    vocab = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 8))) for _ in range(800)]
    texts = [" ".join(rng.choices(vocab, k=40) + BAD * (i % 10 == 0)) for i in range(300)]
    few = train(texts, [int(i % 10 == 0) for i in range(300)])
    plain = " ".join(vocab[:40])
    clean, seen, unseen = scores(few, [plain, f"{plain} horrid wretched", f"{plain} horridd wretchedd vilenesss"])
    assert clean < 0.3 and seen > 0.7 and unseen > 0.7


def plain_score(model, text):
    """The forward pass, one n-gram, word and window at a time."""
    evidence = []
    for word in toxicity.words_of(text):
        buckets, _ = subwords([word])
        per_gram = [sum(float(v) * float(w) for v, w in zip(model.vectors[b], model.layer[:, 0])) for b in buckets.tolist()]
        evidence.append(sum(per_gram) / len(per_gram))
    size = toxicity.WINDOW
    starts = [*range(0, len(evidence) - size, size // 2), max(0, len(evidence) - size)]
    windows = [evidence[a : a + size] for a in starts]
    strongest = max(size * sum(w) / max(1, len(w)) for w in windows)
    return 1 / (1 + math.exp(-strongest - float(model.window_bias[0])))


def test_scores_are_those_of_a_plain_forward_pass(model):
    model, vocab = model
    rng = random.Random(7)
    sizes = [0, 1, 10, 24, 25, 26, 49, 50, 51, 74, 75, 76, 100, 333]
    texts = [" ".join(rng.choices(vocab + BAD * 10, k=n)) for n in sizes] + ["Horrid, WRETCHED é中!", "..."]
    assert scores(model, texts) == pytest.approx([plain_score(model, t) for t in texts], abs=1e-5)


@pytest.mark.parametrize("before", [0, 24, 49, 74, 98])
def test_words_that_stand_together_count_wherever_they_stand(model, before):
    model, vocab = model
    alone, torn = scores(model, [" ".join(BAD), " ".join([*vocab[:before], *BAD[:2], "horrid", *vocab[before : before + 100]])])
    assert alone > 0.7 and torn > 0.7


@pytest.mark.parametrize("n", [1, 2, 5, 10])
def test_a_short_text_has_the_average_of_its_words(model, n):
    model, vocab = model
    words = [*vocab[:9], "horrid"]
    once, often = scores(model, [" ".join(words[:n]), " ".join(words[:n] * 4)])
    assert once == pytest.approx(often, abs=1e-9)


@pytest.mark.parametrize("n", [0, 1, 49, 50, 51, 74, 75, 76, 100, 101, 333])
def test_windows_are_whole_and_hold_every_word(n):
    for step in (25, 50):
        starts = toxicity.window_starts(n, step)
        held = {w for a in starts for w in range(a, min(n, a + toxicity.WINDOW))}
        assert held == set(range(n)) and starts[-1] == max(0, n - toxicity.WINDOW)
        assert np.all(np.diff(starts) > 0) and np.all(np.diff(starts) <= step)


def test_order_of_scoring_does_not_matter(model, monkeypatch):
    model, vocab = model
    texts = [" ".join(vocab[i : i + 40]) for i in range(0, 400, 40)] + ["", "horrid"]
    together = scores(model, texts)
    monkeypatch.setattr(toxicity, "MEMORY_WORDS", 50)
    assert np.allclose(together, [scores(model, [t])[0] for t in texts], rtol=0, atol=1e-12)


def test_subwords_of_a_word_do_not_depend_on_its_neighbours():
    words = [b"ab", b"longer", "été".encode(), b"x"]
    together, sizes = subwords(words)
    alone = [subwords([w]) for w in words]
    assert sizes.tolist() == [a[1][0] for a in alone]
    assert sorted(together[: sizes[0]]) == sorted(alone[0][0])
    assert sorted(together[sizes[0] : sizes[0] + sizes[1]]) == sorted(alone[1][0])


def test_nulls_repeats_and_tables_without_labels(spark, frame):
    docs = frame([(1, None), (2, ""), (3, "some words"), (3, "some words"), (None, "some words")])
    labels = spark.createDataFrame([(1, None), (3, 0), (3, 0)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        model = toxicity_model(docs, some)
        got = [r[0] for r in docs.select(toxicity.toxicity(docs, F.col("text"), model)).collect()]
        assert got == [0.0] * 5
    both = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    model = toxicity_model(docs, both)
    got = [r[0] for r in docs.select(toxicity.toxicity(docs, F.col("text"), model)).collect()]
    assert got[0] == got[1] and got[2] == got[3] == got[4] and all(0 <= s <= 1 for s in got)
    assert docs.limit(0).select(toxicity.toxicity(docs, F.col("text"), model)).collect() == []


def test_query_on_held_out_documents(spark):
    rows = {r.doc_id: r for r in queries.QUERIES["op9_toxicity"].run(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)
    held = [(r.predicted, labels[i]) for i, r in rows.items() if r.held_out and i in labels]
    right = sum(p == t for p, t in held) / len(held)
    caught = sum(p for p, t in held if t) / max(1, sum(t for _, t in held))
    alarms = sum(p for p, t in held if not t) / sum(not t for _, t in held)
    assert right > 0.93 and caught > 0.6 and alarms < 0.02
