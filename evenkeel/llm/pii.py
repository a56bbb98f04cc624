"""Personal data in texts, by anchors and local parsers.

One pass of an Aho-Corasick automaton finds the places where something can start:
at-signs, plus signs, digits, schemes and words that announce an identifier. At
each of them a small parser looks left and right as far as the thing may reach
and says where it ends, or that it is none. No pattern is run over the text.

Kinds ``email``, ``ip``, ``card`` and ``phone`` are what their patterns find,
leftmost and without overlap within the kind; a match that fails its check (parts
over 255, Luhn, number of digits) is dropped and its characters are not tried
again. ``url``, ``iban``, ``account`` and ``secret`` come from schemes and cue words.
Spans are in code points, the end exclusive, ordered by start and then by kind as
listed in KINDS. NULL and empty texts have none. Equal texts have equal spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from evenkeel.llm.common import bounded_batches

KINDS = ("email", "ip", "card", "phone", "url", "iban", "account", "secret")
BASE = KINDS[:4]
SPANS = "array<struct<kind:string,start:int,end:int>>"

# Cue words, each read in lower, upper and title case.
CUES = {
    "iban": "iban",
    "account": "account",
    "acct": "account",
    "konto": "account",
    "compte": "account",
    "cuenta": "account",
    "ssn": "account",
    "passport": "account",
    "password": "secret",
    "passwd": "secret",
    "token": "secret",
    "secret": "secret",
    "api key": "secret",
    "api_key": "secret",
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_DIGITS = re.compile(r"[0-9]+").match
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").match
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+").match
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").match
_REST_OF_URL = re.compile(r"[^\s\"'<>`{}|\\^\x00-\x1f]+").match
_HOST = re.compile(r"(?:[^\s/@]*@)?(?:\[[0-9A-Fa-f:.]+\]|[^\W_](?:[\w-]*\w)?(?:\.\w(?:[\w-]*\w)?)*)(?::[0-9]+)?(?=[/?#]|$)").match
_IBAN = re.compile(r"[\s:=#.]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])").match
_ACCOUNT = re.compile(r"(?:[ ]?(?:number|no\.?|nr\.?|id))?[ ]?[:=#]?[ ]?([A-Z]{0,3}[0-9](?:[ -]?[0-9]){4,33})(?![A-Za-z0-9])", re.I).match
_SECRET = re.compile(r"[ ]?[:=][ ]?[\"']?([A-Za-z0-9_./+=-]{8,})").match


def anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    automaton.add_word("@", ("at", 1))
    automaton.add_word("+", ("plus", 1))
    automaton.add_word("://", ("scheme", 3))
    for d in "0123456789":
        automaton.add_word(d, ("digit", 1))
    for cue, kind in CUES.items():
        for form in (cue, cue.upper(), cue.title(), cue.capitalize()):
            automaton.add_word(form, (kind, len(form)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid_iban(compact: str) -> bool:
    if not 15 <= len(compact) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _iban(text: str, end: int) -> tuple[int, int] | None:
    m = _IBAN(text, end)
    if not m:
        return None
    # what follows an IBAN may look like more of it: the longest valid start of the run counts
    for stop in range(m.end(1), m.start(1) + 14, -1):
        if text[stop - 1] != " " and valid_iban(text[m.start(1) : stop].replace(" ", "")):
            return m.start(1), stop
    return None


def _url(text: str, colon: int, after: int) -> tuple[int, int] | None:
    start = colon
    while start and text[start - 1] in _SCHEME:
        start -= 1
    while start < colon and not text[start].isalpha():
        start += 1
    rest = _REST_OF_URL(text, after)
    if start == colon or not rest:
        return None
    end = rest.end()
    while end > after and text[end - 1] in ".,;:!?)]":
        end -= 1
    return (start, end) if _HOST(text[after:end]) else None


class Finder:
    def __init__(self):
        self.anchors = anchors()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, place of the kind in KINDS, end), in order."""
        found = set()
        mail_end = ip_end = card_end = 0
        for last, (what, length) in self.anchors.iter(text):
            if what == "digit":
                if last >= ip_end:
                    m = _IP(text, last)
                    parts = (p.lstrip("0") for p in m.group().split(".")) if m else ()
                    if m and all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                        found.add((last, 1, m.end()))
                    ip_end = m.end() if m else _DIGITS(text, last).end()
                if last >= card_end:
                    m = _CARD(text, last)
                    card_end = m.end() if m else last + 1
                    if m and m.end() - last <= 40:
                        digits = m.group().replace(" ", "").replace("-", "")
                        if 14 <= len(digits) <= 19 and luhn(digits):
                            found.add((last, 2, m.end()))
            elif what == "at":
                start = last
                while start > mail_end and text[start - 1] in _LOCAL:
                    start -= 1
                m = _DOMAIN(text, last + 1)
                if m and start < last:
                    found.add((start, 0, m.end()))
                    mail_end = m.end()
            elif what == "plus":
                m = _PHONE(text, last)
                if m and 10 <= sum(map(str.isdigit, m.group())) <= 15:
                    found.add((last, 3, m.end()))
            elif what == "scheme":
                if hit := _url(text, last - 2, last + 1):
                    found.add((hit[0], 4, hit[1]))
            elif what == "iban":
                if hit := _iban(text, last + 1):
                    found.add((hit[0], 5, hit[1]))
            else:
                m = (_ACCOUNT if what == "account" else _SECRET)(text, last + 1)
                if m:
                    found.add((m.start(1), KINDS.index(what), m.end(1)))
        return sorted(found)


def personal_spans(text: Column) -> Column:
    """Array of (kind, start, end) of a text column."""
    bounded_batches()

    @F.arrow_udf(SPANS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = Finder()
        for batch in batches:
            offsets, kinds, starts, ends = [0], [], [], []
            for value in batch:
                for start, kind, end in finder.spans(value.as_py() or ""):
                    kinds.append(KINDS[kind])
                    starts.append(start)
                    ends.append(end)
                offsets.append(len(kinds))
            fields = [pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
            rows = pa.StructArray.from_arrays(fields, names=["kind", "start", "end"])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return find(text)


def redacted_text(text: str, finder: Finder) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    out, at, inside = [], 0, 0
    for start, kind, end in finder.spans(text):
        if start >= inside:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        inside = max(inside, end)
        at = inside
    return "".join([*out, text[at:]])


def redacted(text: Column) -> Column:
    """A text column without personal data; NULL stays NULL."""
    bounded_batches()

    @F.arrow_udf("string")
    def redact(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = Finder()
        for batch in batches:
            yield pa.array([None if v is None else redacted_text(v, finder) for v in batch.to_pylist()], pa.string())

    return redact(text)
