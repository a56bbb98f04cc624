"""Passages that an earlier document has word for word, found by fixed-block anchors.

A window of WINDOW words holds exactly one whole block of every grid of blocks of
(WINDOW + 1) / 2 words. So it is enough to index each document's non-overlapping
blocks, and to probe that index with the block-long run at every word of every
document: two equal windows cannot lie anywhere without a hit. Three jobs over the texts, each
written:

1. Anchors. Hashes of the aligned blocks and of all probes meet by range of hash. Those
   that hold a block and come from two documents are hits.
2. Extension. Around each hit the windows that contain it are hashed anew, to 96 bits and
   the range they fall in, and meet again: a window learns the smallest document that has it.
   Overlapping windows of an earlier document make up the maximal repeats.
3. Cut. Every word inside such a window is taken out.

Documents are dealt into groups by hash, of about GROUP_BYTES of text. A group sends each hash once,
however many of its documents hold it, so a passage in every document makes one number a group, and
no task gets rows by how common a passage is. Nothing is paired: hits and
windows are judged by equality alone, and all that grows is linear in the words.

Words part at ASCII white space and are compared as they are. NULL and empty texts, and
those shorter than a window, lose nothing. Of equal doc_ids none comes before the
other, so repeated rows lose nothing to each other and each is returned. Rows with a NULL
doc_id are no references and lose nothing. A text has to fit in a task's memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import bounded_batches, runs_of, tidy_shuffles, written
from evenkeel.session import forget

WINDOW = 13
#: Text of a group, whose distinct hashes a task holds at once, and text whose hashes make one range.
GROUP_BYTES = 32 << 20
RANGE_BYTES = 128 << 20
#: Words longer than this are hashed one by one.
LONG_WORD = 64

_RANDOM = np.random.default_rng(20_261)
_BYTES = _RANDOM.integers(0, 2**64, (2, 256), dtype=np.uint64)
_POWERS = np.cumprod(
    np.concatenate([np.ones((2, 1), np.uint64), np.repeat(_RANDOM.integers(0, 2**64, (2, 1), dtype=np.uint64) | np.uint64(1), LONG_WORD, axis=1)], axis=1),
    axis=1,
)
_FOLDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
_LOW = np.uint64(2**32 - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: bytes, two: bool = False) -> list[np.ndarray]:
    """One or two 64-bit hashes of every word of a text whose words are parted by single blanks."""
    if not words:
        return [np.zeros(0, np.uint64)] * (1 + two)
    b = np.frombuffer(words, np.uint8)
    blanks = np.flatnonzero(b == 32)
    starts = np.concatenate([[0], blanks + 1])
    lengths = np.concatenate([blanks, [len(b)]]) - starts
    place = np.arange(len(b)) - np.repeat(starts, np.minimum(lengths + 1, len(b) - starts))
    place = np.minimum(place, LONG_WORD)
    long = np.flatnonzero(lengths > LONG_WORD)
    found = []
    for k in range(1 + two):
        terms = _BYTES[k][b] * _POWERS[k][place]
        terms[blanks] = 0
        h = np.add.reduceat(terms, starts)
        for i in long.tolist():
            word = words[starts[i] : starts[i] + lengths[i]]
            h[i] = xxhash.xxh3_64_intdigest(word, seed=k)
        found.append(_mixed(h))
    return found


def runs(h: np.ndarray, size: int, fold: np.uint64) -> np.ndarray:
    """A hash of the ``size`` words from every word on."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * fold + h[k : k + n]
    return _mixed(out)


def _ranges(h: np.ndarray, ranges: int) -> np.ndarray:
    """The range each hash falls in; ascending hashes are in ascending ranges."""
    return ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _anchor_keys(h: np.ndarray, ranges: int) -> np.ndarray:
    """The range and 30 low bits: a false hit costs a window's hash and no more."""
    return (_ranges(h, ranges) << np.uint64(30)) | (h & np.uint64(2**30 - 1))


def _firsts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def _by_range(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    starts = _firsts(keys)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
        yield int(keys[a]), slice(a, b)


def normal(text: str | None) -> bytes:
    """The words of a text with one blank between them."""
    return b" ".join((text or "").encode().split())


def _texts(pieces: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    for piece in pieces:
        for doc_id, text in zip(piece.column("doc_id"), piece.column("text")):
            yield doc_id.as_py(), normal(text.as_py())


def _replies(pieces: Iterator[pa.RecordBatch]) -> tuple[list[list[bytes]], Iterator[pa.RecordBatch]]:
    """What a group was sent, and the rest of its rows, which are its texts."""
    sent: list[list[bytes]] = []
    for piece in pieces:
        reply = piece.column("reply").to_numpy(zero_copy_only=False)
        n = int(reply.sum())
        for row in range(n):
            sent.append([int(piece.column("range")[row].as_py()), *(piece.column(c)[row].as_py() for c in "abc")])
        if n < piece.num_rows:
            return sent, _chained(piece.slice(n), pieces)
    return sent, iter(())


def _chained(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


_MESSAGE = "range long, group long, a binary, b binary, c binary"


def _messages(rows: list[tuple[int, int, bytes, bytes, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
    return pa.record_batch(columns, names=["range", "group", "a", "b", "c"])


def _anchors(window: int, ranges: int):
    """For each group the distinct keys of blocks and probes: is one a block, and is it of two documents."""
    block = (window + 1) // 2

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, pieces in runs_of(batches, "group"):
            keys, owners, aligned = [], [], []
            ids: dict[int, int] = {}
            for doc_id, words in _texts(pieces):
                if doc_id is None:
                    continue
                k = _anchor_keys(runs(word_hashes(words)[0], block, _FOLDS[0]), ranges)
                if not len(k):
                    continue
                keys.append(k)
                owners.append(np.full(len(k), ids.setdefault(doc_id, len(ids)), np.int32))
                aligned.append(np.arange(len(k)) % block == 0)
            if not keys:
                continue
            k = np.concatenate(keys)
            order = np.argsort(k, kind="stable")
            k, owner, is_block = k[order], np.concatenate(owners)[order], np.concatenate(aligned)[order]
            starts = _firsts(k)
            blocks = np.logical_or.reduceat(is_block, starts)
            several = np.minimum.reduceat(owner, starts) < np.maximum.reduceat(owner, starts)
            k = k[starts]
            packed = ((k & np.uint64(2**30 - 1)) << np.uint64(2)).astype(np.uint32) | (blocks * 2 + several).astype(np.uint32)
            some = [(r, group, packed[at].tobytes(), b"", b"") for r, at in _by_range(k >> np.uint64(30))]
            yield _messages(some)

    return send


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every range the keys that are a block somewhere and come from two documents, to each group that has them."""
    for number, pieces in runs_of(batches, "range"):
        groups, sent = [], []
        for piece in pieces:
            groups += piece.column("group").to_pylist()
            sent += [np.frombuffer(a.as_py(), np.uint32) for a in piece.column("a")]
        sender = np.repeat(np.arange(len(sent), dtype=np.int32), [len(s) for s in sent])
        packed = np.concatenate(sent)
        order = np.argsort(packed >> 2, kind="stable")
        packed, sender = packed[order], sender[order]
        keys = packed >> 2
        starts = _firsts(keys)
        sizes = np.diff(np.append(starts, len(keys)))
        good = (np.bitwise_or.reduceat(packed, starts) & 2 > 0) & ((sizes > 1) | (packed[starts] & 1 > 0))
        some = np.repeat(good, sizes)
        keys, sender = keys[some], sender[some]
        back = np.argsort(sender, kind="stable")
        keys, sender = keys[back], sender[back]
        yield _messages([(number, groups[i], keys[at].tobytes(), b"", b"") for i, at in _by_range(sender)])


def _windows(window: int, ranges: int):
    """For each group the distinct windows around its hits, with the smallest document of the group that has each."""
    block = (window + 1) // 2

    def around(hit: np.ndarray, n: int) -> np.ndarray:
        """The windows that contain a block that was hit."""
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, np.maximum(hit - (window - block), 0), 1)
        np.add.at(change, np.minimum(hit, n - 1) + 1, -1)
        return np.flatnonzero(np.cumsum(change[:-1]))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, pieces in runs_of(batches, "group"):
            sent, texts = _replies(pieces)
            if not sent:
                continue
            wanted = [np.frombuffer(s[1], np.uint32).astype(np.uint64) | np.uint64(s[0] << 30) for s in sent]
            wanted = np.sort(np.concatenate(wanted))
            first, second, owners = [], [], []
            for doc_id, words in _texts(texts):
                if doc_id is None:
                    continue
                h, g = word_hashes(words, two=True)
                n = len(h) - window + 1
                if n <= 0:
                    continue
                k = _anchor_keys(runs(h, block, _FOLDS[0]), ranges)
                hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, k), len(wanted) - 1)] == k)
                if not len(hit):
                    continue
                at = around(hit, n)
                first.append(runs(h, window, _FOLDS[0])[at])
                second.append((runs(g, window, _FOLDS[1])[at] & _LOW).astype(np.uint32))
                owners.append(np.full(len(at), doc_id, np.int64))
            if not first:
                continue
            a, b, doc = np.concatenate(first), np.concatenate(second), np.concatenate(owners)
            order = np.lexsort((doc, b, a))
            a, b, doc = a[order], b[order], doc[order]
            starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            ends = np.append(starts[1:], len(a)) - 1
            several = doc[ends] > doc[starts]
            a, b, doc = a[starts], b[starts], doc[starts]
            # the sign of what is stored beside a hash says whether the group has it in several documents
            b = b.astype(np.int64) * np.where(several, -1, 1) - several
            yield _messages(
                [(r, group, a[at].tobytes(), b[at].tobytes(), doc[at].tobytes()) for r, at in _by_range(_ranges(a, ranges))]
            )

    return send


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest document of every window, to each group that has it in a larger one."""
    for number, pieces in runs_of(batches, "range"):
        groups, sent = [], []
        for piece in pieces:
            groups += piece.column("group").to_pylist()
            sent += zip(*([np.frombuffer(x.as_py(), kind) for x in piece.column(c)] for c, kind in (("a", np.uint64), ("b", np.int64), ("c", np.int64))))
        sender = np.repeat(np.arange(len(sent), dtype=np.int32), [len(s[0]) for s in sent])
        a, b, doc = (np.concatenate(x) for x in zip(*sent))
        several = b < 0
        b = np.where(several, -b - 1, b)
        order = np.lexsort((doc, b, a))
        a, b, doc, several, sender = (x[order] for x in (a, b, doc, several, sender))
        starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        least = np.repeat(doc[starts], np.diff(np.append(starts, len(a))))
        some = several | (doc > least)
        a, b, least, sender = a[some], b[some], least[some], sender[some]
        back = np.argsort(sender, kind="stable")
        a, b, least, sender = a[back], b[back], least[back], sender[back]
        yield _messages(
            [
                (number, groups[i], a[at].tobytes(), b[at].astype(np.uint32).tobytes(), least[at].tobytes())
                for i, at in _by_range(sender)
            ]
        )


def _known(a: np.ndarray, b: np.ndarray, doc: np.ndarray, x: np.ndarray, y: np.ndarray, doc_id: int) -> np.ndarray:
    """Which windows (x, y) are among (a, b), ascending, with a document before ``doc_id``."""
    at = np.searchsorted(a, x)
    found = np.zeros(len(x), bool)
    left = np.flatnonzero(at < len(a))
    while len(left):  # more than once only where 64 bits agree and 96 do not
        left = left[a[at[left]] == x[left]]
        found[left] |= (b[at[left]] == y[left]) & (doc[at[left]] < doc_id)
        at[left] += 1
        left = left[at[left] < len(a)]
    return found


def _cut(window: int):
    """doc_id, n_words, the spans of words an earlier document has, and the words that are left."""
    kinds = {"spans": pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))}
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", kinds["spans"]), ("kept", pa.string())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in runs_of(batches, "group"):
            sent, texts = _replies(pieces)
            if sent:
                parts = ([np.frombuffer(s[k], kind) for s in sent] for k, kind in ((1, np.uint64), (2, np.uint32), (3, np.int64)))
                a, b, doc = map(np.concatenate, parts)
                order = np.argsort(a, kind="stable")
                a, b, doc = a[order], b[order], doc[order]
            rows, size = [], 0
            for doc_id, words in _texts(texts):
                n_words = words.count(b" ") + 1 if words else 0
                spans, left, gone = [], words, 0
                if sent and doc_id is not None and n_words >= window:
                    h, g = word_hashes(words, two=True)
                    x, y = runs(h, window, _FOLDS[0]), (runs(g, window, _FOLDS[1]) & _LOW).astype(np.uint32)
                    starts = np.flatnonzero(_known(a, b, doc, x, y, doc_id))
                    if len(starts):
                        new = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + window]))
                        firsts, ends = starts[new], starts[np.append(new[1:], len(starts)) - 1] + window
                        spans = [{"first": i, "end": j} for i, j in zip(firsts.tolist(), ends.tolist())]
                        keep = np.ones(n_words, bool)
                        for i, j in zip(firsts, ends):
                            keep[i:j] = False
                        left, gone = b" ".join(compress(words.split(b" "), keep.tolist())), n_words - int(keep.sum())
                rows.append((doc_id, n_words, gone, spans, left.decode()))
                size += len(left)
                if len(rows) >= 500 or size > 8 << 20:
                    yield _table(rows, fields)
                    rows, size = [], 0
            if rows:
                yield _table(rows, fields)

    return read


def _table(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


_CUT = "doc_id long, n_words long, n_removed long, spans array<struct<first: long, end: long>>, kept string"


def cut_repeats(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (first word, word after the last) and the kept words of every row of ``docs``.

    ``window`` is odd, so that blocks of half of it, rounded up, meet every window exactly once.
    """
    if window < 3 or window % 2 == 0:
        raise ValueError("a window has an odd number of words, three or more")
    bounded_batches()
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).head().n
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(3 * tasks, math.ceil(size / GROUP_BYTES))
    ranges = max(tasks, math.ceil(size / RANGE_BYTES))
    texts = texts.withColumn("group", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))

    def by_range(rows: DataFrame) -> DataFrame:
        return rows.repartition("range").sortWithinPartitions("range")

    def by_group(replies: DataFrame) -> DataFrame:
        """Texts dealt by group, each group's replies before its texts."""
        asked = texts.select("group", F.lit(0).alias("reply"), "doc_id", "text")
        asked = asked.withColumns({"range": F.lit(None).cast("long"), **{c: F.lit(None).cast("binary") for c in "abc"}})
        sent = replies.select("group", F.lit(1).alias("reply"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "range", "a", "b", "c")
        return asked.unionByName(sent).repartition("group").sortWithinPartitions("group", F.desc("reply"))

    with tidy_shuffles(spark):
        anchors = texts.repartition("group").sortWithinPartitions("group").mapInArrow(_anchors(window, ranges), _MESSAGE)
        hits = written(by_range(anchors).mapInArrow(_hits, _MESSAGE), "anchor-hits")
        found = by_group(hits).mapInArrow(_windows(window, ranges), _MESSAGE)
        earlier = written(by_range(found).mapInArrow(_earliest, _MESSAGE), "earlier-windows")
        forget(hits)
    return by_group(earlier).mapInArrow(_cut(window), _CUT)
