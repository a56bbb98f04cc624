import random
from itertools import combinations

import numpy as np

from evenkeel.llm import decontaminate, queries
from evenkeel.llm.decontaminate import best_stretch, find_overlaps, item_classes

SF = "/root/testdata/sf0.001"
VOCAB = [f"word{i}" for i in range(3000)]


def found(docs, items):
    return {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.n_agree) for r in find_overlaps(docs, items).collect()}


def best(doc, item):
    """The overlap with most agreeing words over every offset, one by one."""
    result = None
    for s in range(1 - len(item), len(doc)):
        a, b = max(0, s), min(len(doc), s + len(item))
        same = [doc[p] == item[p - s] for p in range(a, b)]
        if sum(same) >= 0.8 * len(item):
            found = (sum(same), a, b - a)
        else:
            fit = best_of_all(same)
            if fit is None:
                continue
            found = (fit[0], a - fit[2], -fit[1])
        if result is None or (found[0], -found[2], -found[1]) > (result[0], -result[2], -result[1]):
            result = found
    return result


def test_substitutions_up_to_a_fifth_are_found_and_clean_texts_left_alone(spark, frame):
    rng = random.Random(3)
    items = [(i, rng.choices(VOCAB, k=rng.choice([15, 20, 37]))) for i in range(20)]
    docs, expected = [], set()
    for d in range(60):
        text = rng.choices(VOCAB, k=rng.randint(5, 200))
        if d % 2:
            i, item = rng.choice(items)
            copy = list(item)
            for p in rng.sample(range(len(copy)), len(copy) // 5):
                copy[p] = "other"
            at = rng.randint(0, len(text))
            text[at:at] = copy
            expected.add((d, i))
        docs.append((d, " ".join(text)))
    got = found(frame(docs), frame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    assert set(got) == expected


def test_stretches_are_those_of_all_offsets(spark, frame):
    rng = random.Random(9)
    items = [(i, rng.choices(VOCAB, k=16)) for i in range(4)]
    docs = []
    for d in range(8):
        text = rng.choices(VOCAB, k=12)
        copy = list(items[d % 4][1])[d % 5 :]
        for p in rng.sample(range(len(copy)), d % 3):
            copy[p] = "zz"
        docs.append((d, text[:5] + copy + text[5:]))
    got = found(
        frame([(d, " ".join(t)) for d, t in docs]), frame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    )
    expected = {(d, i): (b[1], b[2], b[0]) for d, t in docs for i, w in items if (b := best(t, w))}
    assert got == expected


def best_of_all(same):
    """The stretch with 13 or more agreeing words and a share of 0.8 among all stretches, one by one."""
    fit = [
        (sum(same[start:end]), start - end, -start)
        for start in range(len(same))
        for end in range(start + 1, len(same) + 1)
        if sum(same[start:end]) >= 13 and 10 * sum(same[start:end]) >= 8 * (end - start)
    ]
    return max(fit, default=None)


def test_every_stretch_counts_not_only_the_one_of_highest_score():
    rng = random.Random(5)
    cases = [[True] * 13 + [False] * 6 + [True] * 13 + [False] * 6 + [True] * 13]
    cases += [[rng.random() > 0.25 for _ in range(rng.randint(13, 59))] for _ in range(150)]
    for same in cases:
        start, end, n = best_stretch(np.array(same))
        assert ((n, start - end, -start) if n >= 13 else None) == best_of_all(same)


def test_short_items_are_found_whichever_fifth_is_replaced(frame):
    items, docs = [], []
    for n in range(5, 12):
        word = [f"n{n}w{k}" for k in range(n)]
        items.append((n, " ".join(word)))
        for gone in combinations(range(n), n // 5):
            docs.append((n, " ".join("other" if k in gone else w for k, w in enumerate(word))))
    docs = [(100 * d + n, text) for d, (n, text) in enumerate(docs)]
    got = found(frame(docs), frame(items, "item_id long, text string"))
    assert set(got) == {(d, d % 100) for d, _ in docs}


def test_a_longer_overlap_is_found_where_a_shorter_one_is(frame):
    item = VOCAB[:51]
    doc = [f"x{k}" if 13 <= k < 19 or 32 <= k < 38 else w for k, w in enumerate(item)]
    items = frame([(1, " ".join(item))], "item_id long, text string")
    assert found(frame([(1, " ".join(doc)), (2, " ".join(doc[:13]))]), items) == {(1, 1): (0, 32, 26), (2, 1): (0, 13, 13)}


def test_case_punctuation_blocks_and_repeats(spark, frame, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)
    item = "One, two three -- four five (six) seven."
    docs = frame([(1, "x one two Three four! five six seven y"), (1, "x one two Three four! five six seven y"), (2, "one two")])
    items = frame([(8, item), (5, item), (6, "too short"), (None, item), (7, None)], "item_id long, text string")
    assert found(docs, items) == {(1, 5): (1, 7, 7)}


def test_items_of_one_to_four_words_are_found_as_a_whole(frame):
    items = [(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in range(1, 5)]
    docs = [(10 * n, f"a b {text.upper()}, c {text} d") for n, text in items]
    docs += [(10 * n + 1, f"a b {text.rsplit(' ', 1)[0]} c {text.split(' ', 1)[-1]} d") for n, text in items if n > 1]
    got = found(frame(docs), frame([*items, (9, "...")], "item_id long, text string"))
    assert got == {(10 * n, n): (2, n, n) for n, _ in items}


def test_short_and_long_items_of_the_same_word(frame):
    docs = frame([(1, "spam " * 50_000), (2, "ham")])
    got = found(docs, frame([(n, "spam " * n) for n in (1, 2, 4, 5, 30)], "item_id long, text string"))
    # of five words four agree anywhere at the edges, but all five are more
    assert got == {(1, n): (0, n, n) for n in (1, 2, 4, 5, 30)}


def test_words_that_recur_everywhere_are_compared_at_once(frame):
    import time

    rng = random.Random(2)
    common = ["of", "the", "of", "the", "of"]
    items = [(i, " ".join([*common, *rng.choices(VOCAB, k=20), *common])) for i in range(100)]
    docs = [(d, " ".join(common * 600)) for d in range(4)]
    started = time.perf_counter()
    assert found(frame(docs), frame(items, "item_id long, text string")) == {}
    assert time.perf_counter() - started < 30


def test_random_texts_against_all_offsets(frame):
    rng = random.Random(21)
    few = VOCAB[:6]
    items = [(i, rng.choices(VOCAB[:40], k=rng.randint(1, 4)) if i % 3 else rng.choices(few, k=rng.randint(13, 20))) for i in range(30)]
    docs = [(d, rng.choices(few if d % 2 else VOCAB[:40], k=rng.randint(0, 60))) for d in range(40)]
    planted = set()
    for d, text in docs[::2]:
        i, item = items[3 * rng.randrange(10)]
        text[3:3] = [w if rng.random() > 0.15 else "zz" for w in item]
        planted.add((d, i))
    got = found(
        frame([(d, " ".join(t)) for d, t in docs]), frame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    )
    for d, text in docs:
        for i, item in items:
            n = len(item)
            if n < 5:
                at = next((k for k in range(len(text) - n + 1) if text[k : k + n] == item), None)
                assert got.get((d, i)) == (None if at is None else (at, n, n))
            else:
                expected = best(text, item)
                assert (d, i) not in got if expected is None else (d, i) not in planted or (d, i) in got
                # other offsets with as many words may share no seed
                assert (d, i) not in got or got[d, i][2] <= expected[0]
    assert len(planted & set(got)) > 10


def test_classes_of_equal_items(frame):
    items = frame([(5, "a b"), (3, "a b"), (3, "a b"), (9, "c"), (None, "c"), (7, None), (8, "")], "item_id long, text string")
    assert sorted(map(tuple, item_classes(items).collect())) == [(3, 3), (5, 3), (9, 9)]
    assert item_classes(items.limit(0)).collect() == []


def test_nulls_and_empty_tables(spark, frame):
    docs = frame([(1, None), (2, ""), (None, "a b c d e f g")])
    items = frame([(1, "a b c d e f g")], "item_id long, text string")
    assert found(docs, items) == {}
    assert found(docs.limit(0), items) == {} and found(docs, items.limit(0)) == {}


def test_one_word_again_and_again(spark, frame):
    docs = frame([(1, "spam " * 20_000)])
    assert found(docs, frame([(1, "spam " * 30)], "item_id long, text string")) == {(1, 1): (0, 30, 30)}


def test_query_finds_every_whole_passage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    whole = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op4_decontamination"].run(spark, SF).collect()}
    assert whole and whole <= got
