"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (FEWEST to MOST characters, with marks at
its ends) and itself, each hashed to one of BUCKETS vectors; its vector is their
mean. A text is read in windows of WINDOW words, the last of which ends where the text does; a shorter text is
one window. A window is the average of its words' vectors. Windows stand end to end in training; in scoring they
overlap by half, so that words that stand together are together in one of them. A linear layer
gives the window's evidence, toxic less clean, on the average times WINDOW, a fixed scale. A text has the evidence of its
strongest window, however many others stand around it, and a softmax over the two
classes (of which only their difference counts) makes it a score. Vectors and layer
are trained together by Adam, in the same way: through the strongest windows. A
misspelling shares most n-grams with its word, so it scores like it without having
been seen.

All vectors met in training are trained. Each is scaled by what its n-gram says about
the class: with z its toxic texts over those expected, in standard errors, by
z^2 / (z^2 + CHANCE). So the n-grams that a text has by chance cannot be learnt by
heart, and a bound on how often one must be met is not needed.

Training reads at most TRAIN_ROWS labelled texts of TRAIN_BYTES together, those
with the lowest hash of their id, whatever their length: a fixed sample, whatever the
size of the corpus. A text that no longer fits into the bytes is passed over.

Words are runs of letters and digits, lower-cased. NULL and empty texts have no
words and score what the bias says. Labels that are NULL or other than 0 and 1 are
not read; an id with several labels counts as toxic if one of them says so, and
one with several texts is read once. Without any label of either class the score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import bounded_batches

FEWEST, MOST = 3, 7
BUCKETS = 1 << 18
DIM = 8
WINDOW = 50
TRAIN_ROWS = 10000
TRAIN_BYTES = 32 << 20
EPOCHS = 6
BATCH = 40
RATE = 0.01
DECAY = 0.003
WINDOW_BIAS = -3.0
CHANCE = 16.0
LEAST_STEPS = 800
MEMORY_WORDS = 200_000

_LETTERS = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_LETTERS).split()


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams end to end, and how many each word has."""
    marked = [f"<{w.decode().lower()}>" for w in words]
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(marked)), lens)
    grams, owners = [], []
    rolled = np.zeros(len(code), np.uint64)
    for size in range(1, MOST + 1):
        n = max(0, len(code) - size + 1)
        rolled = rolled[:n] * _ODD + code[size - 1 : size - 1 + n] + np.uint64(1)
        if size >= FEWEST:
            whole = word[:n] == word[size - 1 : size - 1 + n]
            grams.append(rolled[whole] ^ (rolled[whole] >> np.uint64(29)))
            owners.append(word[:n][whole])
    # the word itself, by a hash of all its characters
    starts = np.cumsum(lens) - lens
    place = np.arange(len(code)) - np.repeat(starts, lens)
    mix = (code + np.uint64(1)) * (place.astype(np.uint64) * _ODD + np.uint64(0xD6E8FEB86659FD93))
    mix = mix ^ (mix >> np.uint64(32))
    grams.append(np.add.reduceat(mix * _ODD, starts) if len(starts) else np.zeros(0, np.uint64))
    owners.append(np.arange(len(marked)))
    gram, owner = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    gram = gram[order] * _ODD
    return (gram >> np.uint64(40)).astype(np.int32) % BUCKETS, np.bincount(owner, minlength=len(marked))


@dataclass
class Model:
    vectors: np.ndarray
    layer: np.ndarray
    window_bias: np.ndarray

    def bucket_evidence(self) -> np.ndarray:
        """What each bucket adds: the linear layer applied to its vector."""
        return (self.vectors @ self.layer)[:, 0].astype(np.float64)


def softmax(x: np.ndarray) -> np.ndarray:
    """The toxic share of a softmax over (0, x)."""
    return np.exp(-np.logaddexp(0.0, -x))


def strongest(raw: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Of every text, in order, the window with most evidence."""
    order = np.lexsort((-raw, text))
    return order[np.diff(text[order], prepend=-1) > 0]


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The positions start .. start + len - 1 of every range, end to end."""
    return np.arange(lens.sum()) + np.repeat(starts - (np.cumsum(lens) - lens), lens)


def window_starts(n: int, step: int) -> np.ndarray:
    """Where the windows of a text of ``n`` words start, every ``step`` words; the last one ends with the text."""
    return np.append(np.arange(0, n - WINDOW, step), max(0, n - WINDOW))


class Corpus:
    """Training texts as numbers of words, and the trained buckets of every word."""

    def __init__(self, texts: list[str]):
        ids: dict[bytes, int] = {}
        self.texts = [np.array([ids.setdefault(w, len(ids)) for w in words_of(t)], np.int32) for t in texts]
        words, met = list(ids), np.zeros(BUCKETS, bool)
        del ids
        held, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 10_000):
            buckets, lens = subwords(words[at : at + 10_000])
            met[buckets] = True
            held.append(buckets)
            sizes.append(lens)
        self.shared = np.flatnonzero(met)
        place = np.cumsum(met, dtype=np.int32) - np.int32(1)
        self.buckets, self.sizes = np.concatenate([place[b] for b in held]), np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def scale(self, toxic: np.ndarray) -> np.ndarray:
        """Between 0 and 1 for each trained bucket: how far its texts are of one class beyond chance."""
        held = np.zeros((2, len(self.shared)))
        for text, label in zip(self.texts, toxic):
            words = np.unique(text)
            held[label, np.unique(self.buckets[spread(self.starts[words], self.sizes[words])])] += 1
        share = toxic.mean()
        expected = held.sum(axis=0) * share
        square = (held[1] - expected) ** 2 / (expected * (1 - share) + 1)
        return (square / (square + CHANCE)).astype(np.float32)

    def batch(self, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
        """Buckets and their words, words and their windows, windows and their texts; sizes of words and windows."""
        word, window, text, sizes, n = [], [], [], [], 0
        for t, i in enumerate(chosen):
            k = self.texts[i]
            starts = window_starts(len(k), WINDOW)
            lens = np.full(len(starts), min(WINDOW, len(k)))
            word.append(k[spread(starts, lens)])
            window.append(n + np.repeat(np.arange(len(starts)), lens))
            text.append(np.full(len(starts), t))
            sizes.append(lens)
            n += len(starts)
        words, word = np.unique(np.concatenate(word), return_inverse=True)
        owner = np.repeat(np.arange(len(words)), self.sizes[words])
        buckets = self.buckets[spread(self.starts[words], self.sizes[words])]
        window, text, lens = np.concatenate(window), np.concatenate(text), np.concatenate(sizes)
        return buckets, owner, word, window, text, self.sizes[words], lens


def train(texts: list[str], toxic: list[int], seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    corpus, toxic = Corpus(texts), np.array(toxic)
    shared = len(corpus.shared)
    scale = corpus.scale(toxic)[:, None]
    vectors = rng.normal(0, 0.1, (shared, DIM)).astype(np.float32)
    layer = rng.normal(0, 0.3, (DIM, 1)).astype(np.float32)
    params = [vectors, layer, np.full(1, WINDOW_BIAS, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(texts)))
    cuts = np.arange(BATCH, len(texts), BATCH)
    step, steps = 0, epochs * (len(cuts) + 1)
    for _ in range(epochs):
        for chosen in np.split(rng.permutation(len(texts)), cuts):
            step += 1
            buckets, owner, word, window, text, sizes, lens = corpus.batch(chosen)
            evidence = (vectors @ layer * scale)[:, 0]
            n_windows, n_words = len(text), len(sizes)
            per_word = np.bincount(owner, evidence[buckets], n_words) / sizes
            average = WINDOW / np.maximum(1, lens)
            raw = np.bincount(window, per_word[word], n_windows) * average + params[2]
            top = strongest(raw, text)
            d_raw = np.zeros(n_windows)
            d_raw[top] = (softmax(raw[top]) - toxic[chosen]) / len(chosen)
            per_word = np.bincount(word, (d_raw * average)[window], n_words) / sizes
            per_bucket = np.bincount(buckets, per_word[owner], shared).astype(np.float32)[:, None] * scale
            grads = [
                per_bucket @ layer.T + np.float32(DECAY * BATCH / len(texts)) * vectors,
                vectors.T @ per_bucket,
                np.array([d_raw.sum()], np.float32),
            ]
            rate = RATE * (1 - step / (steps + 1))
            for value, g, m, s in zip(params, grads, first, second):
                m += np.float32(0.1) * (g - m)
                s += np.float32(0.01) * (g * g - s)
                fit = np.sqrt(s / np.float32(1 - 0.99**step)) + np.float32(1e-8)
                value -= np.float32(rate / (1 - 0.9**step)) * m / fit
    full = np.zeros((BUCKETS, DIM), np.float32)
    full[corpus.shared] = vectors * scale
    return Model(full, layer, params[2])


class Scorer:
    """Scores texts; remembers the evidence of words, up to MEMORY_WORDS."""

    def __init__(self, model: Model):
        self.evidence, self.window_bias = model.bucket_evidence(), float(model.window_bias[0])
        self.place: dict[bytes, int] = {}
        self.known = np.zeros(0)

    def learn(self, words: list[bytes]) -> None:
        buckets, sizes = subwords(words)
        starts = np.cumsum(sizes) - sizes
        fresh = np.add.reduceat(self.evidence[buckets], starts) / sizes
        for k, w in enumerate(words, len(self.place)):
            self.place[w] = k
        self.known = np.concatenate([self.known, fresh])

    def score(self, texts: list[str]) -> np.ndarray:
        words = [words_of(t) for t in texts]
        fresh = set().union(*words).difference(self.place)
        if len(self.place) + len(fresh) > MEMORY_WORDS:
            self.place, self.known = {}, np.zeros(0)
            fresh = set().union(*words)
        if fresh:
            self.learn(list(fresh))
        get = self.place.__getitem__
        logits = np.empty(len(texts))
        for t, ws in enumerate(words):
            seen = self.known[np.fromiter(map(get, ws), np.int64, len(ws))]
            upto = np.concatenate([[0.0], np.cumsum(seen)])
            starts = window_starts(len(ws), WINDOW // 2)
            size = min(WINDOW, len(ws))
            strongest_sum = (upto[starts + size] - upto[starts]).max()
            logits[t] = strongest_sum * (WINDOW / max(1, size)) + self.window_bias
        return softmax(logits)


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """The bounded sample of labelled texts; both frames with doc_id, docs with text, labels with toxic."""
    labels = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sizes = texts.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("bytes"))
    fit, left = [], TRAIN_BYTES
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r.bytes <= left:
            fit.append(r.doc_id)
            left -= r.bytes
    # as an Arrow table, which the executors read without Python workers
    wanted = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(fit, pa.int64())}))
    rows = texts.join(F.broadcast(wanted), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    return [r.text for r in rows], [r.toxic for r in rows]


def toxicity_model(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model trained on the labelled texts; None if they are not of both classes."""
    texts, toxic = training_rows(docs, labels)
    return train(texts, toxic) if len(set(toxic)) == 2 else None


def toxicity(docs: DataFrame, text: Column, model: Model | None) -> Column:
    """Score between 0 and 1 of a text column."""
    if model is None:
        return F.lit(0.0)
    bounded_batches()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(sent.value)
        for batch in batches:
            out = [np.zeros(0)]
            for at in range(0, len(batch), 200):
                out.append(scorer.score([v.as_py() or "" for v in batch.slice(at, 200)]))
            yield pa.array(np.concatenate(out), pa.float64())

    return score(text)
