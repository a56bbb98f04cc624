"""Importance resampling towards a target: documents drawn by how much their words look like the target's.

A feature is a run of words, its bucket the CRC-32 of its bytes modulo BUCKETS. The
totals of all buckets over the documents and over the target give every bucket a
gain; a document's weight is the sum of the gains of its features, and the highest
weights, each with a Gumbel term that only the id decides, are drawn.

Words come in two kinds. The head is the most frequent words and pairs, found by
summaries of every task; their CRC states and buckets are broadcast (HEAD_WORDS
words and HEAD_PAIRS pairs of at most LONGEST bytes, whatever the data). Everything
else is the tail, and its CRC is taken on the spot, continued from the state of its first
word where that is known. Both give the same number, so the totals are exact whatever is in
the head. Buckets are hashed once and written; totals and weights read them.

NULL and empty texts have no features and weight 0; they count as documents without
words. Repeated rows count and are returned each; those that tie in score and id take
their ranks in any order. Rows with a NULL doc_id count in the totals and have a
weight, but no score: they cannot be drawn and are none of those a share is drawn of.
Empty tables give no rows; an empty target leaves all gains to the documents.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import bounded_batches, id_and_text, written
from evenkeel.operators.constraints import identity_fill

BUCKETS = 10_000
#: The head: so many words and pairs, none longer than LONGEST bytes. Bounds what is broadcast.
HEAD_WORDS, HEAD_PAIRS, LONGEST = 30_000, 30_000, 64
#: A task's summary drops its rarest entries when it has grown to so many.
SUMMARY = 200_000

# A-Z read as a-z; every other byte below 0x80 that is no digit or letter parts words.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class Head(dict):
    """CRC states of frequent words; any other word's is taken when asked for, and not kept."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


class FeatureHash:
    """The buckets of all runs of 1 to ``longest_run`` words."""

    def __init__(self, words: list[bytes], pairs: list[bytes], longest_run: int, buckets: int):
        self.head = Head((w, zlib.crc32(w)) for w in words)
        self.pairs = {tuple(p.split(b" ")): zlib.crc32(p) % buckets for p in pairs}
        self.longest_run, self.buckets = longest_run, buckets

    def of(self, words: list[bytes]) -> np.ndarray:
        states = np.fromiter(map(self.head.__getitem__, words), np.uint32, len(words))
        found = [states % np.uint32(self.buckets)]
        if self.longest_run > 1:
            pair, n, state = self.pairs.get, self.buckets, states.tolist()
            both = zip(words, words[1:], state)
            # a bucket of 0 is found, too
            found.append(np.fromiter(
                (zlib.crc32(b" " + b, s) % n if (k := pair((a, b))) is None else k for a, b, s in both),
                np.uint32,
                max(0, len(words) - 1),
            ))
            for size in range(3, self.longest_run + 1):
                runs = range(max(0, len(words) - size + 1))
                found.append(np.fromiter(
                    (zlib.crc32(b" " + b" ".join(words[i + 1 : i + size]), state[i]) % n for i in runs),
                    np.uint32,
                    len(runs),
                ))
        return np.concatenate(found)


def frequent(texts: DataFrame, most: int, size: int) -> list[bytes]:
    """About the ``most`` most frequent runs of ``size`` words (1 or 2); which ones only decides the speed.

    A task counts its own and reports those that hold their share of its words,
    ``most`` of them at most, so neither a task nor the driver holds a vocabulary.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        total = 0
        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                total += len(words)
                seen.update(words if size == 1 else map(b" ".join, zip(words, words[1:])))
                if len(seen) > SUMMARY:
                    seen = Counter(dict(seen.most_common(SUMMARY // 2)))
        least = max(2, total // most)
        some = [(w, n) for w, n in seen.most_common(most) if n >= least and len(w) <= LONGEST]
        yield pa.record_batch(
            [pa.array([w for w, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())], names=["run", "n"]
        )

    counted = texts.select("text").mapInArrow(count, "run binary, n long").groupBy("run").agg(F.sum("n").alias("n"))
    return [bytes(r.run) for r in counted.orderBy(F.desc("n"), "run").limit(most).collect()]


def hashed(texts: DataFrame, hasher) -> DataFrame:
    """doc_id, n_words, and the buckets of all features as unsigned 32-bit numbers; ``hasher`` is a broadcast."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, buckets = [], []
            for text in batch.column(1):
                some = words_of(text.as_py())
                words.append(len(some))
                buckets.append(hasher.value.of(some).tobytes())
            yield pa.record_batch(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(buckets, pa.binary())],
                names=["doc_id", "n_words", "buckets"],
            )

    return texts.mapInArrow(read, "doc_id long, n_words long, buckets binary")


def bucket_totals(rows: DataFrame, buckets: int) -> list[int]:
    """How many features each bucket holds; a task sums its own, so ``buckets`` numbers a task are all that moves."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_py(), np.uint32), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    found = rows.select("buckets").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    totals = [0] * buckets
    for r in found.collect():
        totals[r.bucket] = r.n
    return totals


def gains(documents: list[int], target: list[int]) -> np.ndarray:
    """What a feature of each bucket adds to a weight, in thousandths."""
    k = len(documents)
    s_all, t_all = float(sum(documents) + k), float(sum(target) + k)
    return np.array(
        [math.floor(1000 * math.log(float(t + 1) * s_all / (float(s + 1) * t_all))) for s, t in zip(documents, target)],
        np.int64,
    )


def gumbel(seed: int, doc_id: str) -> Column:
    """A document's own Gumbel term in thousandths, from the hash of its id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    longest_run: int = 1,
    buckets: int = BUCKETS,
    least_words: int = 20,
    percent: int = 10,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (NULL if not drawn) of every row of ``docs``.

    Of the documents with ``least_words`` words, ``percent`` in a hundred are drawn.
    """
    bounded_batches()
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col)
    goal = target.select(F.lit(0).cast("long").alias("doc_id"), F.coalesce(F.col(f"`{target_col}`"), F.lit("")).alias("text"))
    words = frequent(texts, HEAD_WORDS, 1)
    pairs = frequent(texts, HEAD_PAIRS, 2) if longest_run > 1 else []
    hasher = spark.sparkContext.broadcast(FeatureHash(words, pairs, longest_run, buckets))
    features = written(hashed(texts, hasher), "features")
    gain = gains(bucket_totals(features, buckets), bucket_totals(hashed(goal, hasher), buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [np.frombuffer(v.as_py(), np.uint32) for v in batch.column(2)]
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(b) for b in some], pa.int64()),
                    pa.array([int(gain[b].sum()) for b in some], pa.int64()),
                ],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    weighed = features.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    scored = written(weighed.withColumn("score", F.col("weight") + gumbel(seed, "doc_id")), "scored")
    eligible = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    asked = scored.filter(eligible).count() * percent // 100
    # the last column parts rows that are equal, so that no range has to hold all of them
    tie = F.xxhash64(F.monotonically_increasing_id())
    order = [F.desc("score"), F.asc("doc_id"), F.asc("tie")]
    ranked = identity_fill(scored.filter(eligible).withColumn("tie", tie), "rank", order, 0, broadcast_rows=0)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= asked, F.col("rank")))
    rest = scored.filter(~eligible).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*names).unionByName(rest.select(*names))
