import hashlib
import random
import re

import numpy as np
import pytest
from oracle import connect, spark_rows, sql_rows

from evenkeel.llm import queries, substrings
from evenkeel.llm.substrings import cut_repeats

SF = "/root/testdata/sf0.001"


def brute(docs, window=13):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    least = {}
    for i, w in split:
        for k in range(len(w) - window + 1 if i is not None else 0):
            x = tuple(w[k : k + window])
            least[x] = min(i, least.get(x, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        left = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def cut(df, **options):
    rows = cut_repeats(df, **options).collect()
    for r in rows:
        assert sum(s.end - s.first for s in r.spans) == r.n_removed
        assert all(a.end < b.first for a, b in zip(r.spans, r.spans[1:]))
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in rows), key=str)


def planted(seed, docs=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passages = [rng.choices(vocab, k=rng.choice([5, 11, 12, 13, 14, 20, 60])) for _ in range(12)]
    # short runs that many texts share in other surroundings, so that hits are more than repeats
    common = [rng.choices(vocab, k=rng.choice([6, 7, 8, 10, 12])) for _ in range(6)]
    out = []
    for i in rng.sample(range(1000), docs):
        words = []
        for _ in range(rng.randint(0, 8)):
            words += rng.choice([rng.choice(passages), rng.choice(common), rng.choices(vocab, k=rng.randint(1, 30))])
        out.append((i, "".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in words)))
    return out


@pytest.mark.parametrize("seed, window", [(1, 13), (2, 13), (3, 5), (4, 3), (5, 21)])
def test_as_by_all_windows(spark, frame, seed, window):
    docs = planted(seed)
    assert cut(frame(docs), window=window) == brute(docs, window)


def test_many_groups_and_ranges(spark, frame, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP_BYTES", 500)
    monkeypatch.setattr(substrings, "RANGE_BYTES", 300)
    docs = planted(6, 120)
    assert cut(frame(docs)) == brute(docs)


def test_few_values_of_words(spark, frame):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choices("ab", k=rng.randint(0, 60)))) for i in range(40)]
    assert cut(frame(docs), window=7) == brute(docs, 7)
    docs = [(i, "a " * n) for i, n in enumerate([3, 12, 13, 14, 40, 200])]
    assert cut(frame(docs)) == brute(docs)


def test_nulls_empties_repeats_and_no_rows(spark, frame):
    text = " ".join(f"v{i}" for i in range(20))
    docs = [(None, text), (4, text), (4, text), (4, text + " tail"), (9, "Start " + text), (5, None), (6, ""), (7, " \n"), (8, "a b"), (None, text), (-3, text[:20])]
    assert cut(frame(docs)) == brute(docs)
    assert cut(frame(docs).limit(0)) == []


def test_a_passage_in_every_text_and_a_very_long_text(spark, frame):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, f"{i} start {passage} end {i}") for i in range(400)]
    docs += [(500, " ".join(f"x{i}" for i in range(150_000)) + " " + passage), (501, "y" * 300_000 + " " + passage)]
    assert cut(frame(docs)) == brute(docs)


def test_hashes_of_words_depend_on_the_word_alone():
    rng = random.Random(8)
    words = ["".join(rng.choices("abé日", k=rng.choice([1, 2, 3, 20, 63, 64, 65, 200]))).encode() for _ in range(500)]
    whole = substrings.word_hashes(b" ".join(words), two=True)
    for k in range(2):
        by_word = {}
        for w, h in zip(words, whole[k].tolist()):
            assert by_word.setdefault(w, h) == h
        assert len(set(by_word.values())) == len(by_word)
        assert all(substrings.word_hashes(w, two=True)[k][0] == h for w, h in by_word.items())
    assert np.array_equal(substrings.word_hashes(b" ".join(words))[0], whole[0])


def test_even_windows_are_refused(spark, frame):
    with pytest.raises(ValueError):
        cut_repeats(frame([(1, "a")]), window=12)


def test_query_against_sql_and_by_hand(spark):
    df = queries.QUERIES["op13_substrings"].run(spark, SF)
    columns, expected = sql_rows(connect(SF), queries.QUERIES["op13_substrings"].sql)
    assert sorted(df.columns) == columns and spark_rows(df) == expected
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str) == brute(docs)
