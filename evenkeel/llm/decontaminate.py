"""Benchmark passages in documents, by spaced-seed hashing.

A mask fixes which of a few neighbouring words count and which are ignored. Under
each mask every place of a benchmark item and of a document gets a hash of the
words that count, so two texts still meet where a word in between was replaced.
Each hit names a document, an item and the offset between them; along that offset
the words are compared one by one. It is an overlap if LEAST_SHARE of the item's
words agree, or if there is any stretch in which LEAST_SHARE of the words agree and
these are LEAST_WORDS or more. Of several stretches the one with most agreeing words
is reported, of those the shortest, then the first.

Words are lower-cased (A-Z) and freed of punctuation at both ends; words of
punctuation alone are left out, and positions count the words that remain. Items
of fewer than SHORTEST words are found where all their words stand in a row, and reported at
the first such place; whether they say anything about a document is for the caller to decide
(``n_words`` tells). Items of equal text are one item, reported under its smallest
id; ``item_classes`` has the others. NULL and empty texts, and texts of punctuation,
overlap with nothing. Repeated rows are reported once. Rows with a NULL id are left out.

The benchmark goes to the tasks in blocks of about BLOCK_WORDS words, each with a
pass over the documents; the documents are never shuffled.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import attach, bounded_batches, id_and_text, written

# Any three replaced words in fifteen leave one of these whole somewhere.
MASKS = ("11111", "110111")
# Whatever fifth is replaced in an item of fewer than FEW words, one of these is left too.
FEW_MASKS = ("1111", "11011", "10111", "11101")
FEW = 12
# Items of fewer words have to stand as a whole.
SHORTEST = 5
LEAST_WORDS = 13
LEAST_SHARE = 0.8
BLOCK_WORDS = 200_000
FILTER_BITS = 22
MEMORY_WORDS = 150_000
#: Documents (words), hits and compared places worked on at once.
SLICE_WORDS = 400_000
HITS = 1_000_000
PLACES = 4_000_000

OVERLAP = ["doc_id", "item_id", "first_word", "n_words", "n_agree", "item_words"]

_ODD = np.uint64(0x9E3779B97F4A7C15)
_EDGES = (string.punctuation).encode()


class Words:
    """Word hashes of texts, 0 for none; remembers up to MEMORY_WORDS of them."""

    def __init__(self):
        self.memory: dict[bytes, int] = {}

    def hashes(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        memory = self.memory
        if len(memory) > MEMORY_WORDS:
            memory.clear()
        for w in set(words).difference(memory):
            bare = w.strip(_EDGES)
            memory[w] = xxhash.xxh64_intdigest(bare) | 1 if bare else 0
        h = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
        return h[h != 0]


def offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """A hash for every place the mask fits."""
    n = max(0, len(h) - len(mask) + 1)
    out = np.zeros(n, np.uint64)
    for k in offsets(mask):
        out = out * _ODD + h[k : k + n]
    return out ^ (out >> np.uint64(32))


class Index:
    """The items of one block, end to end, and the places of their seeds under each mask."""

    def __init__(self, ids: list[int], texts: list[str]):
        words = Words()
        sets = [words.hashes(t) for t in texts]
        keep = [i for i, s in enumerate(sets) if len(s)]
        self.ids = np.array([ids[i] for i in keep], np.int64)
        self.lens = np.array([len(sets[i]) for i in keep], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.words = np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in keep)])
        self.item_of = np.repeat(np.arange(len(keep)), self.lens)
        self.tables = []
        # which lengths a mask is for
        uses = [(m, SHORTEST, None) for m in MASKS] + [(m, SHORTEST, FEW) for m in FEW_MASKS]
        uses += [("1" * n, n, n + 1) for n in range(1, SHORTEST)]
        for mask, least, below in uses:
            key = seeds(self.words, mask)
            at = np.flatnonzero(self.item_of[: len(key)] == self.item_of[len(mask) - 1 :][: len(key)])
            size = self.lens[self.item_of[at]]
            at = at[(size >= least) & (size < below if below else True)]
            order = np.argsort(key[at], kind="stable")
            some = np.zeros(1 << FILTER_BITS, bool)
            some[(key[at] & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
            self.tables.append((mask, key[at][order], at[order], some))

    def hits(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of h and of the items that share a seed."""
        for mask, keys, places, some in self.tables:
            if not len(keys):
                continue
            key = seeds(h, mask)
            at = np.flatnonzero(some[(key & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
            low, high = np.searchsorted(keys, key[at]), np.searchsorted(keys, key[at], "right")
            at, low, count = at[high > low], low[high > low], (high - low)[high > low]
            first = 0
            upto = np.cumsum(count)
            while first < len(at):
                last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + HITS)))
                n = count[first:last]
                ends = np.cumsum(n)
                which = np.arange(ends[-1]) + np.repeat(low[first:last] - (ends - n), n)
                yield np.repeat(at[first:last], n), places[which]
                first = last

    def _agreeing(self, h: np.ndarray, at: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How many of ``size`` words from places of h and of the items agree."""
        agree = np.zeros(len(at), np.int64)
        upto = np.cumsum(size)
        first = 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PLACES)))
            n = size[first:last]
            starts = np.cumsum(n) - n
            step = np.arange(int(n.sum())) - np.repeat(starts, n)
            same = h[np.repeat(at[first:last], n) + step] == self.words[np.repeat(place[first:last], n) + step]
            agree[first:last] = np.add.reduceat(same.astype(np.int64), starts)
            first = last
        return agree

    def overlaps(self, h: np.ndarray, text_of: np.ndarray, text_starts: np.ndarray, text_lens: np.ndarray):
        """(text, item, first word in the text, words of the stretch, words that agree) for each overlap."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}

        def offer(key, first, size, agree):
            old = best.get(key, (0, 0, 0))
            if (agree, -size, -first) > (old[2], -old[1], -old[0]):
                best[key] = (first, size, agree)

        for at, place in self.hits(h):
            text, item = text_of[at], self.item_of[place]
            shift = (at - text_starts[text]) - (place - self.starts[item])
            some = np.unique(np.stack([text, item, shift], axis=1), axis=0)
            text, item, shift = some.T
            a = np.maximum(0, shift)
            size = np.minimum(text_lens[text], shift + self.lens[item]) - a
            from_text, from_item = text_starts[text] + a, self.starts[item] + a - shift
            agree = self._agreeing(h, from_text, from_item, size)
            few = self.lens[item] < SHORTEST
            whole = np.where(few, agree == self.lens[item], agree >= LEAST_SHARE * self.lens[item])
            # of those that have the share the best of each pair
            order = np.flatnonzero(whole)
            order = order[np.lexsort((a[order], size[order], -agree[order], item[order], text[order]))]
            pair = np.stack([text[order], item[order]], axis=1)
            order = order[np.concatenate([np.ones(min(len(order), 1), bool), (pair[1:] != pair[:-1]).any(axis=1)])]
            for k in order.tolist():
                offer((int(text[k]), int(item[k])), int(a[k]), int(size[k]), int(agree[k]))
            # a stretch of the others has no more agreeing words than all of it
            part = np.flatnonzero(~whole & ~few & (agree >= LEAST_WORDS))
            for k in part[np.argsort(-agree[part], kind="stable")].tolist():
                key = (int(text[k]), int(item[k]))
                if agree[k] < best.get(key, (0, 0, 0))[2]:
                    continue
                x = h[from_text[k] : from_text[k] + size[k]] == self.words[from_item[k] : from_item[k] + size[k]]
                start, end, n = best_stretch(x)
                if n >= LEAST_WORDS:
                    offer(key, int(a[k]) + start, end - start, n)
        return [(t, i, *b) for (t, i), b in best.items()]


def best_stretch(agree: np.ndarray) -> tuple[int, int, int]:
    """Start, end and agreeing words of the stretch with most of these among all that have LEAST_SHARE."""
    # a stretch has the share if its sum of +1 and -4 is not negative, or its two prefix sums do not fall
    upto = np.concatenate([[0], np.cumsum(np.where(agree, 1, -4))])
    count = np.concatenate([[0], np.cumsum(agree)])
    best = (0, 0, 0)
    # it begins and ends with a word that agrees, or a shorter one has as many of them
    places = np.flatnonzero(agree)
    ends = places + 1
    for k, start in enumerate(places.tolist()):
        if len(places) - k < max(best[2], 1):
            break
        fit = np.flatnonzero(upto[ends[k:]] >= upto[start])
        end = int(ends[k + fit[-1]])
        n = int(count[end] - count[start])
        if (n, start - end) > (best[2], best[0] - best[1]):
            best = (start, end, n)
    return best


def _slices(column: pa.Array, words: Words) -> Iterator[tuple[int, list[np.ndarray]]]:
    first, run, size = 0, [], 0
    for row, text in enumerate(column):
        run.append(words.hashes(text.as_py()))
        size += len(run[-1])
        if size >= SLICE_WORDS:
            yield first, run
            first, run, size = row + 1, [], 0
    if run:
        yield first, run


def item_classes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, class_id: the id under which ``find_overlaps`` reports each item, one row an id and text.

    Items without a text, which overlap with nothing, are left out. Smallest ids combine before they shuffle, and a
    text that many items have is broadcast to these.
    """
    items = id_and_text(benchmark, item_col, text_col).filter(F.col("doc_id").isNotNull() & (F.col("text") != ""))
    keyed = items.select(F.col("doc_id").alias("item_id"), F.sha2("text", 256).alias("key")).distinct()
    least = written(keyed.groupBy("key").agg(F.min("item_id").alias("class_id"), F.count("*").alias("n")), "classes")
    return attach(keyed, least, "key").select("item_id", "class_id")


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """doc_id, item_id, first_word, n_words, n_agree, item_words: the best overlap of each pair that has one."""
    bounded_batches()
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col).filter(F.col("doc_id").isNotNull())
    items = id_and_text(benchmark, item_col).filter(F.col("doc_id").isNotNull() & (F.col("text") != ""))
    items = written(items.groupBy("text").agg(F.min("doc_id").alias("item_id")), "items")
    total = items.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0)).alias("n")).head().n
    blocks = max(1, math.ceil(total / BLOCK_WORDS))
    found = None
    for block in range(blocks):
        # one block of about BLOCK_WORDS words, whatever the size of the benchmark
        some = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()
        index = spark.sparkContext.broadcast(Index([r.item_id for r in some], [r.text for r in some]))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            words = Words()
            for batch in batches:
                for first, sets in _slices(batch.column(1), words):
                    lens = np.array([len(s) for s in sets], np.int64)
                    of = np.repeat(np.arange(len(sets)), lens)
                    rows = index.value.overlaps(np.concatenate(sets), of, np.cumsum(lens) - lens, lens)
                    columns = [
                        pa.array([batch.column(0)[first + r[0]].as_py() for r in rows], pa.int64()),
                        pa.array([int(index.value.ids[r[1]]) for r in rows], pa.int64()),
                        *(pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3, 4)),
                        pa.array([int(index.value.lens[r[1]]) for r in rows], pa.int64()),
                    ]
                    yield pa.record_batch(columns, names=OVERLAP)

        part = texts.mapInArrow(scan, ", ".join(f"{c} long" for c in OVERLAP))
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("n_agree", (-F.col("n_words")).alias("n_words"), (-F.col("first_word")).alias("first_word")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b"), F.max("item_words").alias("item_words")).select(
        "doc_id",
        "item_id",
        (-F.col("b.first_word")).alias("first_word"),
        (-F.col("b.n_words")).alias("n_words"),
        "b.n_agree",
        "item_words",
    )
