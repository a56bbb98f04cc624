import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evenkeel.llm import queries
from evenkeel.llm.pii import KINDS, Finder, luhn, personal_spans, redacted

SF = "/root/testdata/sf0.001"
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
FINDER = Finder()


def by_pattern(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            good = [
                True,
                all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else True,
                14 <= len(digits) <= 19 and luhn(digits),
                10 <= len(digits) <= 15,
            ][kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def base(text):
    return [s for s in FINDER.spans(text) if s[1] < 4]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a@.-+0123456789 ()%é:/\n", max_size=60))
def test_base_kinds_are_those_of_the_patterns(text):
    assert base(text) == by_pattern(text)


@settings(max_examples=300, deadline=None)
@given(
    st.lists(
        st.sampled_from(
            ["a@b.c", "x@y", "1.2.3.4", "999.1.1.1", "5.6.7.8.9.10.11.12", "4111111111111111", "4111-1111 1111 1111",
             "+1 (386) 555-3733", "+12", "..", "@", "@@", " ", "é", "+", "-", "1", "a"]
        ),
        max_size=12,
    )
)
def test_base_kinds_in_pieces(parts):
    assert base("".join(parts)) == by_pattern("".join(parts))


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("see https://example.com/a?b=c.", "url", "https://example.com/a?b=c"),
        ("(http://x.org)", "url", "http://x.org"),
        ("nothing :// here", "url", None),
        ("IBAN: DE89 3704 0044 0532 0130 00.", "iban", "DE89 3704 0044 0532 0130 00"),
        ("IBAN GB29NWBK60161331926819", "iban", "GB29NWBK60161331926819"),
        ("IBAN DE89 3704 0044 0532 0130 01", "iban", None),
        ("Account number: 12345678", "account", "12345678"),
        ("SSN 078-05-1120", "account", "078-05-1120"),
        ("of no account 5", "account", None),
        ('token = "747e8edd6430861f"', "secret", "747e8edd6430861f"),
        ("password=f8cb0ab732d29a210e and", "secret", "f8cb0ab732d29a210e"),
        ("a password is needed", "secret", None),
    ],
)
def test_added_kinds(text, kind, found):
    got = [text[a:b] for a, k, b in FINDER.spans(text) if KINDS[k] == kind]
    assert got == ([found] if found else [])


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "@" * 300_000, "+1" * 150_000):
        FINDER.spans(text)


def test_null_empty_repeated_and_redacted(spark, frame):
    df = frame([(1, None), (2, ""), (3, "mail a.b@c.de now"), (3, "mail a.b@c.de now"), (4, "é 10.0.0.1")])
    got = [[tuple(s) for s in r[0]] for r in df.select(personal_spans(F.col("text"))).collect()]
    assert got == [[], [], [("email", 5, 13)], [("email", 5, 13)], [("ip", 2, 10)]]
    assert [r[0] for r in df.select(redacted(F.col("text"))).collect()] == [
        None, "", "mail [EMAIL] now", "mail [EMAIL] now", "é [IP]",
    ]
    assert df.limit(0).select(personal_spans(F.col("text"))).collect() == []


def test_query_on_all_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op6_pii"].run(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = by_pattern(docs[r.doc_id])
        listed = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in spans) for n in range(4)]
        assert not listed or set(listed.split(",")) <= set(r.spans.split(","))


def test_leading_zeros_and_long_schemes():
    def found(text):
        return [(KINDS[k], text[a:b]) for a, k, b in Finder().spans(text)]

    zeros = "0" * 40 + "1.2.3.4"
    assert ("ip", zeros) in found(f"at {zeros} now") and ("ip", "0000.00000.1.255") in found("0000.00000.1.255")
    assert not [f for f in found("256.1.1.1 and 1.1.1.0000256") if f[0] == "ip"]
    scheme = "a" * 100
    assert any(text.startswith(scheme) for _, text in found(f"see {scheme}://example.org/x"))
