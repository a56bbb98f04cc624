import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from oracle import connect, spark_rows, sql_rows

from evenkeel.llm import queries, resample
from evenkeel.llm.resample import importance_resample

SF = "/root/testdata/sf0.001"


def features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, longest=1, buckets=10_000, least=20, percent=10):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    split = [(i, *features(t, longest)) for i, t in docs]
    s = Counter(bucket(f) for _, _, fs in split for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x, longest)[1])
    s_all, t_all = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)

    def gain(b):
        return math.floor(1000 * math.log(float(t[b] + 1) * s_all / (float(s[b] + 1) * t_all)))

    rows = []
    for i, words, fs in split:
        weight = sum(gain(bucket(f)) for f in fs)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(words), len(fs), weight, score))
    pool = sorted((-r[4], r[0], n) for n, r in enumerate(rows) if r[1] >= least and r[0] is not None)
    rank = {n: k for k, (_, _, n) in enumerate(pool[: percent * len(pool) // 100], 1)}
    return sorted(((r[0], *r[2:], rank.get(n)) for n, r in enumerate(rows)), key=str)


def drawn(df, target, **options):
    rows = importance_resample(df, target, **options).collect()
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rows), key=str)


def planted(seed):
    rng = random.Random(seed)
    vocab = ["The", "of", "é", "naïve", "x1", "日本", *(f"w{i}" for i in range(300))]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    seps = [" ", ", ", "\n", "--", "\t"]
    docs = [
        (i, "".join(w + rng.choice(seps) for w in rng.choices(vocab, weights, k=rng.choice([0, 1, 2, 19, 20, 21, 300]))))
        for i in range(120)
    ]
    return docs, [" ".join(rng.choices(vocab[40:], k=30)) for _ in range(20)]


@pytest.mark.parametrize("longest, head", [(1, 30_000), (1, 3), (2, 30_000), (2, 4), (3, 5)])
def test_as_by_hand_whatever_is_in_the_head(spark, frame, monkeypatch, longest, head):
    monkeypatch.setattr(resample, "HEAD_WORDS", head)
    monkeypatch.setattr(resample, "HEAD_PAIRS", head)
    docs, target = planted(longest)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = drawn(frame(docs), goal, longest_run=longest, buckets=977, percent=25)
    assert got == brute(docs, target, longest, 977, percent=25)
    assert any(r[4] for r in got)


def test_nulls_empties_repeats_and_no_rows(spark, frame):
    long = "one two three " * 10
    docs = [(1, None), (2, ""), (3, "-- \t"), (None, long), (5, long), (5, long), (6, long + "four")]
    for target in (["one one"], [None, ""], []):
        goal = spark.createDataFrame([(t,) for t in target], "text string")
        assert drawn(frame(docs), goal, percent=100) == brute(docs, target, percent=100)
    assert drawn(frame(docs).limit(0), goal) == []


def test_a_very_long_text_and_a_word_in_every_text(spark, frame):
    docs = [(0, " ".join(f"v{i}" for i in range(200_000))), *((i, "the same " * 30) for i in range(1, 300))]
    goal = spark.createDataFrame([("the same",)], "text string")
    assert drawn(frame(docs), goal) == brute(docs, ["the same"])


def test_query_against_sql_and_by_hand(spark):
    df = queries.QUERIES["op11_resampling"].run(spark, SF)
    columns, expected = sql_rows(connect(SF), queries.QUERIES["op11_resampling"].sql)
    assert sorted(df.columns) == columns and spark_rows(df) == expected
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)
    assert got == brute(docs, target)
