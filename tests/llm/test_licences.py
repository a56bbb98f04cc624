import random
import re

import pytest
from pyspark.sql import functions as F

from evenkeel.llm import queries
from evenkeel.llm.licences import GAP, GAP_SHARE, LEAST_COVER, PHRASES, TEMPLATES, Scanner, chained, licence_scan, words_of

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCANNER = Scanner()


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def base(text):
    words = WORD.findall(lower(text or ""))
    places = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), sorted({x for _, x in places})


def row(text):
    r = SCANNER.row(text or "")
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]


def test_words_are_those_of_the_pattern():
    text = "aB-c_é'ß\u0085x y 12.3 中文\x7fz ÀB"
    assert [w.decode() for w in words_of(text)] == WORD.findall(lower(text))


@pytest.mark.parametrize("seed", range(20))
def test_base_places_are_those_of_a_search(seed):
    rng = random.Random(seed)
    vocab = "cc by general public license all rights reserved gnu licensed under the x y".split()
    for _ in range(50):
        text = " ".join(rng.choices(vocab, k=rng.randint(0, 60)))
        assert row(text) == base(text)


def test_matching_statistics_are_those_of_all_stretches():
    rng = random.Random(5)
    templates = {"a": ["p q r s t p q x", "q r s"], "b": ["s t p z q"]}
    scanner = Scanner(templates, {"q r": "x"})
    texts = [words_of(t) for g in templates.values() for t in g] + [[b"q", b"r"]]
    inside = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(200):
        words = [rng.choice("pqrstxzo").encode() for _ in range(rng.randint(0, 25))]
        lengths = [max((n for n in range(i + 2) if n == 0 or tuple(words[i + 1 - n : i + 1]) in inside)) for i in range(len(words))]
        runs = {
            (i + 1 - n, i + 1)
            for i, n in enumerate(lengths)
            if n > 1 and (i + 1 == len(lengths) or lengths[i + 1] <= n)
        }
        import numpy as np

        ids = np.array([scanner.ids.get(w, 0) for w in words], np.int64)
        got = {(a, b) for a, b, _ in scanner.matches(ids)[0]}
        assert got == runs


@pytest.mark.parametrize("label", TEMPLATES)
def test_every_template_gives_its_label_in_a_text(label):
    for template in TEMPLATES[label]:
        r = SCANNER.row(f"Some words before.\n{template.upper()} and words after it")
        assert label in r["labels"] and r["covered"] >= len(words_of(template))


def test_a_template_with_other_words_in_it_is_chained():
    words = TEMPLATES["apache-2.0"][1].split()
    words[8] = "DIFFERENT"
    assert SCANNER.row(" ".join(words))["labels"] == ["apache-2.0"]
    assert SCANNER.row(" ".join(words[:8]))["labels"] == []


MIT = TEMPLATES["mit"]
WARRANTY = [t for t in MIT if "AS IS" in t or "NO EVENT" in t]


def test_a_paragraph_without_its_licence_gives_the_label():
    assert SCANNER.row("\n".join(WARRANTY))["labels"] == ["mit"]
    for paragraph in WARRANTY:
        assert SCANNER.row(f"x y z {paragraph} x y z")["labels"] == ["mit"]


@pytest.mark.parametrize("foreign", [1, 3, 4, 5, 7])
def test_words_put_into_a_long_paragraph_do_not_hide_it(foreign):
    words = MIT[0].split()
    r = SCANNER.row(" ".join([*words[:32], *["foreign"] * foreign, *words[32:]]))
    assert r["labels"] == ["mit"] and r["spans"] == [{"label": "mit", "start": 0, "end": len(words_of(MIT[0])) + foreign}]


def test_far_parts_and_parts_in_another_order_are_no_paragraph():
    words = MIT[0].split()
    assert SCANNER.row(" ".join([*words[:32], *["foreign"] * 60, *words[32:]]))["labels"] == []
    assert SCANNER.row(" ".join([*words[32:], *words[:32]]))["labels"] == []
    assert SCANNER.row(" ".join(words[:20] * 4))["labels"] == []


def test_licences_with_one_other_word_are_told_apart():
    for label, name in (("gpl", "gnu"), ("lgpl", "gnu lesser"), ("agpl", "gnu affero")):
        mine = [t for t in TEMPLATES[label] if len(words_of(t)) > 12]
        for template in mine:
            assert {s["label"] for s in SCANNER.row(template)["spans"]} == {label}, (name, template)


def test_repeated_licences_have_a_span_each():
    r = SCANNER.row(" and then ".join([MIT[0]] * 300))
    assert len(r["spans"]) == 300 and r["labels"] == ["mit"]


def longest_chain(parts, size):
    """Most words of a template any chain of parts covers, by trying all of them."""

    def follow(i, covered):
        start, end, at = parts[i]
        most = covered
        for j in range(i + 1, len(parts)):
            a, b, t = parts[j]
            fresh = b - a - max(0, end - a, at - (t - (b - a)))
            if fresh > 0 and a - end <= max(GAP, covered // GAP_SHARE):
                most = max(most, follow(j, covered + fresh))
        return most

    return max((follow(i, p[1] - p[0]) for i, p in enumerate(parts)), default=0)


def test_chains_are_the_longest_there_are():
    rng = random.Random(11)
    found = 0
    for _ in range(3000):
        size, parts, a, b = rng.randint(8, 28), [], 0, 0
        for _ in range(rng.randint(1, 8)):
            a, b = a + rng.randint(1, 9), max(b + 1, a + rng.randint(4, 12))
            if b - a <= size and b > a:
                parts += [(a, b, rng.randint(b - a, size)) for _ in range(rng.randint(1, 2))]
        got = chained(parts, size)
        assert bool(got) == (longest_chain(parts, size) >= LEAST_COVER * size)
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
        found += bool(got)
    assert found > 300


def test_clean_long_and_empty_texts():
    assert SCANNER.row("of the and the terms of a license to the " * 5000)["labels"] == []
    assert SCANNER.row("all rights reserved " * 50_000)["n_base"] == 50_000
    assert row("") == (0, 0, None, None, [])


def test_null_and_repeated_rows(spark, frame):
    df = frame([(1, None), (2, ""), (3, "CC BY"), (3, "CC BY")])
    got = [r[0] for r in df.select(licence_scan(F.col("text"))).collect()]
    assert got[0] == got[1] and got[0].n_words == 0 and got[2] == got[3] and got[2].labels == ["cc-by"]
    assert df.limit(0).select(licence_scan(F.col("text"))).collect() == []


def test_query_on_all_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op10_licences"].run(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, k, first, last, labels = base(docs[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, k, first, last, ",".join(labels))
        assert set(labels) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        if "Released under the MIT License" in docs[r.doc_id]:
            assert "mit" in r.labels.split(",")
