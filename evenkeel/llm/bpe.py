"""Byte-level BPE, encoding and decoding, by batched merge rounds in numpy.

A slice of texts is split into words, the words not seen before are laid end to
end in one flat array of symbols, and every round finds the rank of every pair by
binary search over the sorted pair keys, takes the lowest of each word and merges
it wherever it stands in that word. Words without a pair left leave the array.

NULL texts read as empty; an empty text has no ids. Ids outside the vocabulary
decode to nothing. Ids are the same as those of a tokenizer that merges one pair
at a time, because a merged symbol's own merges always have higher ranks.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm.common import bounded_batches

# Fixed value: the pattern by which this family of tokenizers cuts words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NO_PAIR = np.iinfo(np.int32).max
#: Words of more symbols merge by a heap; rounds times length would be quadratic.
LONG_WORD = 2000
#: Characters of text worked on at once, and words a worker remembers.
SLICE_CHARS = 500_000
MEMORY_WORDS = 120_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next from U+0100."""
    letters, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            letters.append(chr(b))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


@dataclass
class Vocabulary:
    """A tokenizer file as arrays; about 3 MB for 50,000 merges, so it can be broadcast."""

    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    pair_ids: np.ndarray
    spelled: np.ndarray
    spelled_at: np.ndarray
    special: dict[str, int]

    @property
    def size(self) -> int:
        return len(self.spelled_at) - 1


def load_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE file; other kinds are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space"):
        raise ValueError("only byte-level BPE without a prefix space is read")
    if spec.get("normalizer") or spec["model"].get("ignore_merges") or not cut.get("use_regex", True):
        raise ValueError("normalizers, whole-word lookups and other word patterns are not read")
    letters = byte_letters()
    byte_of = {c: b for b, c in enumerate(letters)}
    ids = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    size = max([*ids.values(), *special.values()]) + 1
    spelled = [b""] * size
    for token, i in ids.items():
        spelled[i] = bytes(byte_of[c] for c in token)
    for token, i in special.items():
        spelled[i] = token.encode()
    keys, ranks, merged = [], [], []
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        keys.append(ids[left] * size + ids[right])
        ranks.append(rank)
        merged.append(ids[left + right])
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return Vocabulary(
        byte_ids=np.array([ids[c] for c in letters], np.int64),
        pair_keys=np.array(keys, np.int64)[order],
        pair_ranks=np.array(ranks, np.int32)[order],
        pair_ids=np.array(merged, np.int64)[order],
        spelled=np.frombuffer(b"".join(spelled), np.uint8),
        spelled_at=np.concatenate([[0], np.cumsum([len(s) for s in spelled])]).astype(np.int64),
        special=special,
    )


def _pairs(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each pair (NO_PAIR if it has none) and its place among the sorted keys."""
    key = left * v.size + right
    at = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
    return np.where(v.pair_keys[at] == key, v.pair_ranks[at], NO_PAIR), at


def _spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The positions start .. start + len - 1 of every range, end to end."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


def merge_rounds(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words end to end, and how many each has."""
    n = len(words)
    lens = np.fromiter(map(len, words), np.int64, n)
    symbol = v.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(n), lens)
    out_word, out_symbol = [], []
    while len(symbol):
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        rank, at = _pairs(v, symbol[:-1], symbol[1:])
        rank = np.append(rank, NO_PAIR)
        rank[starts[1:] - 1] = NO_PAIR  # a pair lies within one word
        lowest = np.minimum.reduceat(rank, starts)
        lowest = np.repeat(lowest, np.diff(np.append(starts, len(symbol))))
        over = lowest == NO_PAIR
        out_word.append(word[over])
        out_symbol.append(symbol[over])
        place = np.flatnonzero((rank == lowest) & ~over)
        if len(place):
            # of pairs that overlap (one symbol repeated) every other one merges, from the left
            first = np.concatenate([[True], np.diff(place) != 1])
            run_start = place[np.maximum.accumulate(np.where(first, np.arange(len(place)), 0))]
            place = place[(place - run_start) % 2 == 0]
            symbol[place] = v.pair_ids[at[place]]
            keep = ~over
            keep[place + 1] = False
        else:
            keep = ~over
        symbol, word = symbol[keep], word[keep]
    if not out_word:
        return np.zeros(0, np.int64), lens
    word, symbol = np.concatenate(out_word), np.concatenate(out_symbol)
    order = np.argsort(word, kind="stable")
    return symbol[order], np.bincount(word, minlength=n)


def merge_long(word: bytes, v: Vocabulary) -> np.ndarray:
    """Ids of one long word, its pairs kept in a heap by rank and place."""
    symbol = v.byte_ids[np.frombuffer(word, np.uint8)]
    rank, at = _pairs(v, symbol[:-1], symbol[1:])
    symbol = symbol.tolist()
    n = len(symbol)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(int(r), i, symbol[i], symbol[i + 1], int(a)) for i, (r, a) in enumerate(zip(rank, at)) if r != NO_PAIR]
    heapq.heapify(heap)

    def push(i: int, j: int) -> None:
        r, a = _pairs(v, np.array([symbol[i]]), np.array([symbol[j]]))
        if r[0] != NO_PAIR:
            heapq.heappush(heap, (int(r[0]), i, symbol[i], symbol[j], int(a[0])))

    while heap:
        _, i, left, right, a = heapq.heappop(heap)
        j = after[i]
        if symbol[i] != left or j >= n or symbol[j] != right:
            continue
        symbol[i], symbol[j] = int(v.pair_ids[a]), -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            push(i, after[i])
        if before[i] >= 0:
            push(before[i], i)
    return np.array([s for s in symbol if s >= 0], np.int64)


class Encoder:
    """Encodes texts in slices and remembers the words of earlier ones, up to MEMORY_WORDS."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.cut = regex.compile(WORDS).findall
        names = sorted(v.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.at, self.lens = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def words(self, text: str) -> list[str]:
        if self.split is None or not any(s in text for s in self.v.special):
            return self.cut(text)
        out: list[str] = []
        for part in self.split(text):
            # a leading NUL pair marks a special token; it cannot be the word of a text
            out.extend([("\0", part)] if part in self.v.special else self.cut(part))
        return out

    def learn(self, words: list) -> None:
        plain = [w for w in words if isinstance(w, str)]
        raw = [w.encode() for w in plain]
        short = [i for i, w in enumerate(raw) if len(w) <= LONG_WORD]
        ids, lens = merge_rounds([raw[i] for i in short], self.v)
        blocks, names, counts = [ids], [plain[i] for i in short], [lens]
        for i, w in enumerate(raw):
            if len(w) > LONG_WORD:
                blocks.append(merge_long(w, self.v))
                names.append(plain[i])
                counts.append([len(blocks[-1])])
        for w in words:
            if not isinstance(w, str):
                blocks.append(np.array([self.v.special[w[1]]]))
                names.append(w)
                counts.append([1])
        lens = np.concatenate(counts).astype(np.int64)
        for k, name in enumerate(names, len(self.place)):
            self.place[name] = k
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.ids = np.concatenate([self.ids, *blocks])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        words = [self.words(t) for t in texts]
        flat = [w for ws in words for w in ws]
        fresh = set(flat).difference(self.place)
        if len(self.place) + len(fresh) > MEMORY_WORDS:
            self.forget()
            fresh = set(flat)
        if fresh:
            self.learn(list(fresh))
        k = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        lens = self.lens[k]
        text_of = np.repeat(np.arange(len(texts)), np.fromiter(map(len, words), np.int64, len(words)))
        counts = np.bincount(text_of, weights=lens, minlength=len(texts)).astype(np.int64)
        return self.ids[_spread(self.at[k], lens)], counts


def slices(texts: Iterable, chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    """The texts, strings or Arrow scalars, in runs of about so many characters."""
    run, size = [], 0
    for t in texts:
        run.append((t.as_py() if isinstance(t, pa.Scalar) else t) or "")
        size += len(run[-1])
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def decode_batch(ids: np.ndarray, counts: np.ndarray, v: Vocabulary) -> list[str]:
    """Text of each run of ids; bytes that are no UTF-8 become U+FFFD."""
    known = (ids >= 0) & (ids < v.size)
    ids = np.where(known, ids, 0)
    lens = np.where(known, np.diff(v.spelled_at)[ids], 0)
    upto = np.concatenate([[0], np.cumsum(lens)])
    ends = upto[np.cumsum(counts)]
    raw = v.spelled[_spread(v.spelled_at[ids], lens)].tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]


def encoded_lists(batch: pa.Array, encoder: Encoder) -> pa.ListArray:
    """The ids of each text of a batch."""
    ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for run in slices(batch):
        some, n = encoder.encode(run)
        ids.append(some.astype(np.int32))
        counts.append(n)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))


def decoded_lists(batch: pa.ListArray, v: Vocabulary) -> pa.Array:
    """The text of each list of ids of a batch."""
    counts = np.asarray(batch.value_lengths().fill_null(0)).astype(np.int64)
    ids = batch.flatten()
    upto = np.cumsum(counts)
    texts, row = [], 0
    while row < len(counts):
        first = int(upto[row] - counts[row])
        last = max(row + 1, int(np.searchsorted(upto, first + SLICE_CHARS // 4)))
        some = ids.slice(first, int(upto[last - 1]) - first).fill_null(-1)
        run = decode_batch(np.asarray(some).astype(np.int64), counts[row:last], v)
        texts.append(pa.array(run, pa.string()))
        row = last
    return pa.concat_arrays([pa.array([], pa.string()), *texts])


def bpe_encode(spark: SparkSession, text: Column, path: str) -> Column:
    """Ids (array of int) of a text column, by the tokenizer file at ``path`` on the driver."""
    bounded_batches()
    vocabulary = spark.sparkContext.broadcast(load_vocabulary(path))

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            yield encoded_lists(batch, encoder)

    return encode(text)


def bpe_decode(spark: SparkSession, ids: Column, path: str) -> Column:
    """Text of an id column; NULL and empty arrays give an empty text, NULL ids nothing."""
    bounded_batches()
    vocabulary = spark.sparkContext.broadcast(load_vocabulary(path))

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield decoded_lists(batch, vocabulary.value)

    return decode(ids)


def bpe_round_trip(spark: SparkSession, text: Column, path: str) -> Column:
    """A struct of ``ids`` and their text ``decoded``, as ``bpe_encode`` and ``bpe_decode`` give them.

    A task encodes and decodes in one Python worker, where the two columns take a worker each.
    """
    bounded_batches()
    vocabulary = spark.sparkContext.broadcast(load_vocabulary(path))

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            ids = encoded_lists(batch, encoder)
            yield pa.StructArray.from_arrays([ids, decoded_lists(ids, vocabulary.value)], names=["ids", "decoded"])

    return both(text)
