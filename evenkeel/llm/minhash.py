"""Near-duplicates by b-bit MinHash.

Every text becomes its set of word shingles as 64-bit hashes, and the set its
minima under HASHES functions. Runs of ROWS minima are band keys: texts that share
one are candidates. Of each minimum the BITS low bits are kept, packed in bit
planes of 64-bit words; counting equal ones and correcting for chance
(p = J + (1 - J) / 2^BITS) estimates the similarity J of a candidate pair, and only
pairs that come within five standard errors of the threshold, or of sets of at most
SMALL_SET shingles, are compared on their full sets. A minimum is mixed with a constant of its
function before its low bits are taken, so that the bits agree by chance under each function anew.

Texts of equal sets are one class from the start. A band key shared by many
classes does not make pairs of all of them: each is first compared with the
smallest one. What that links is one component, and only keys whose classes are
still apart are looked at again: first each class with its likeliest
partner in another component, and in the end all likely pairs of different
components, inside the task that holds both. Large keys that hold much the same classes
are looked at as one group, in which a class stands once and not once a key. A group is dealt
to tasks by pairs of blocks. Links decide components exactly; none
within a component is needed, and no task writes more pairs than it has rows.

With 42 bands of 6 rows a pair at similarity 0.8 shares no band with probability
(1 - 0.8^6)^42 < 3e-6, one at 0.85 with less than 1e-9.

NULL and empty texts, and texts without words, have no shingles and link with
nothing. Texts of fewer words than a shingle are one shingle. Rows of one doc_id
count as one document. Rows with a NULL doc_id take no part: they have no
component and are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.bounded import broadcast_if_fits
from evenkeel.llm.common import attach, bounded_batches, id_and_text, scratch, written
from evenkeel.llm.components import components

HASHES = 256
BANDS, ROWS = 42, 6
BITS = 2
PLANE = HASHES // 64
#: Classes, and shingles of their full sets, of a group that a task compares at once with as many others.
BLOCK = 8192
BLOCK_SHINGLES = 4_000_000
#: Sets up to this size are compared whatever their estimate says.
SMALL_SET = 32
#: Keys of up to so many classes are always groups of their own.
SMALL_KEY = 256
MEMORY_WORDS = 150_000

_MULTIPLIERS = np.random.default_rng(20_260).integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_SALTS = np.random.default_rng(20_262).integers(0, 2**32, HASHES, dtype=np.uint32)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass(frozen=True)
class Rule:
    """What counts as a near-duplicate: words a shingle, and similarity in hundredths."""

    words: int = 5
    percent: int = 80

    @property
    def least_estimate(self) -> float:
        j = self.percent / 100
        p = j + (1 - j) / 2**BITS
        return j - 5 * (p * (1 - p) / HASHES) ** 0.5 / (1 - 2**-BITS)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes of texts; remembers word hashes up to MEMORY_WORDS."""

    def __init__(self, words: int):
        self.words = words
        self.memory: dict[bytes, int] = {}

    def shingles(self, text: str) -> np.ndarray:
        """Distinct hashes, ascending. Upper case A-Z reads as lower; words part at ASCII white space."""
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        memory = self.memory
        if len(memory) > MEMORY_WORDS:
            memory.clear()
        for w in set(words).difference(memory):
            memory[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
        size = min(self.words, len(h))
        folded = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            folded = folded * _ODD + h[k : len(h) - size + 1 + k]
        return np.unique(mixed(folded))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set under each hash function."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(least, (x[at : at + 256, None] * _MULTIPLIERS).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each row of minima and each band."""
    runs = least[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), runs.shape[:2])
    for k in range(ROWS):
        key = mixed(key * _ODD + runs[:, :, k])
    return key.view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """Low bits of each row of minima, each mixed by its own function: BITS planes of PLANE words."""
    least = least ^ _SALTS
    least = (least ^ (least >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    least = (least ^ (least >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    least = least ^ (least >> np.uint32(16))
    planes = [np.packbits(((least >> b) & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(BITS)]
    return np.concatenate(planes, axis=1).view(np.int64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many minima differ in their low bits, for rows of packed signatures that broadcast."""
    x = (a ^ b).view(np.uint64)
    x = x.reshape(*x.shape[:-1], BITS, PLANE)
    any_bit = x[..., 0, :]
    for k in range(1, BITS):
        any_bit = any_bit | x[..., k, :]
    return np.bitwise_count(any_bit).sum(axis=-1, dtype=np.int64)


def estimated(different: Column | np.ndarray) -> Column | np.ndarray:
    """Similarity, corrected for minima whose low bits agree by chance."""
    chance = 2.0**-BITS
    return (1.0 - different / float(HASHES) - chance) / (1.0 - chance)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_key (NULL for an empty set), bands, signature; one row a document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, keys = [], []
                least = np.full((part.num_rows, HASHES), 2**32 - 1, np.uint32)
                for i, text in enumerate(part.column(1)):
                    s = shingler.shingles(text.as_py())
                    sizes.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    if len(s):
                        least[i] = minima(s)
                some = np.array(sizes) > 0
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array(keys, pa.binary()),
                        _lists(band_keys(least), some),
                        _lists(packed(least), some),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "bands", "signature"],
                )

    schema = "doc_id long, n_shingles long, set_key binary, bands array<long>, signature array<long>"
    return docs.mapInArrow(sign, schema)


def _lists(rows: np.ndarray, some: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(np.where(some, rows.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows[some].ravel()))


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """node, shingles: the whole set of each document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingler.shingles(t.as_py()).view(np.int64) for t in part.column(1)]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = np.concatenate([np.zeros(0, np.int64), *sets])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.record_batch([part.column(0), lists], names=["node", "shingles"])

    return docs.mapInArrow(read, "node long, shingles array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs u, v whose full sets are similar enough."""
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    sets = written(full_sets(docs.join(broadcast_if_fits(nodes), "doc_id", "left_semi"), rule.words), "sets")
    sides = pairs.select("u", "v")
    for side in ("u", "v"):
        sides = sides.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"s{side}")), side)
    both = F.size(F.array_intersect("su", "sv")).cast("long")
    union = F.size("su") + F.size("sv") - both
    return sides.filter(100 * both >= rule.percent * union).select("u", "v")


def _hopeful(n_u: Column, n_v: Column, sig_u: str, sig_v: str, rule: Rule) -> tuple[Column, Column]:
    """The estimate of a pair, and whether it is worth comparing."""
    different = F.lit(0)
    for k in range(PLANE):
        word = F.lit(0).cast("long")
        for b in range(BITS):
            at = b * PLANE + k
            word = word.bitwiseOR(F.get(sig_u, F.lit(at)).bitwiseXOR(F.get(sig_v, F.lit(at))))
        different = different + F.bit_count(word)
    estimate = estimated(different)
    sizes = 100 * F.least(n_u, n_v) >= rule.percent * F.greatest(n_u, n_v)
    return estimate, ((estimate >= rule.least_estimate) | (F.greatest(n_u, n_v) <= SMALL_SET)) & sizes


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches cut where the key columns change."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in keys]
        changes = np.zeros(batch.num_rows, bool)
        for c in cols:
            changes[1:] |= c[1:] != c[:-1]
        changes[0] = last is not None and last != tuple(c[0] for c in cols)
        at = 0
        for cut in np.flatnonzero(changes):
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], int(cut)
        held.append(batch.slice(at))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def _columns(run: pa.Table, names: str) -> list[np.ndarray]:
    return [run[c].to_numpy() for c in names.split()]


def _likely(a: int, b: np.ndarray, part, n, sig, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``b`` in another component than ``a`` that are worth comparing with it, and the estimates."""
    b = b[part[b] != part[a]]
    b = b[100 * np.minimum(n[a], n[b]) >= rule.percent * np.maximum(n[a], n[b])]
    estimate = estimated(differing(sig[a], sig[b]))
    some = (estimate >= rule.least_estimate) | (np.maximum(n[a], n[b]) <= SMALL_SET)
    return b[some], estimate[some]


def _similar(a: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rule: Rule) -> np.ndarray:
    """Which of the sets that lie end to end in ``flat`` are similar enough to ``a``; all are ascending."""
    which = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    others = flat[which]
    at = np.minimum(np.searchsorted(a, others), len(a) - 1)
    both = np.add.reduceat((a[at] == others).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= rule.percent * (len(a) + sizes - both)


def _sides(run: pa.Table, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the two blocks of a task, one and the same for a block with itself."""
    i, j = run["i"][0].as_py(), run["j"][0].as_py()
    left = np.flatnonzero(block == i)
    return left, left if i == j else np.flatnonzero(block == j)


def _nearest_apart(rule: Rule):
    """For each row of two blocks of a group the likeliest partner in another component, if it has one."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, ["key", "i", "j"]):
            node, part, block, n = _columns(run, "node part block n_shingles")
            sig = np.stack(run["signature"].to_numpy())
            left, right = _sides(run, block)
            best, found = np.full(len(node), -np.inf), np.full(len(node), -1)
            for a in left:
                b, estimate = _likely(a, right[right > a] if left is right else right, part, n, sig, rule)
                if len(b):
                    top = np.argmax(estimate)
                    if estimate[top] > best[a]:
                        best[a], found[a] = estimate[top], b[top]
                    better = estimate > best[b]
                    best[b[better]], found[b[better]] = estimate[better], a
            rows = np.flatnonzero(found >= 0)
            some = run.take(pa.array(rows)).select(["key", "node"]).combine_chunks()
            yield from some.append_column("other", pa.array(node[found[rows]], pa.int64())).to_batches()

    return find


def _links_apart(rule: Rule):
    """Confirmed links between components in two blocks of a group; none between what they already join."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, ["key", "i", "j"]):
            node, part, block, n = _columns(run, "node part block n_shingles")
            sig = np.stack(run["signature"].to_numpy())
            sets = [np.sort(s) for s in run["shingles"].to_numpy()]
            flat, starts = np.concatenate(sets), np.cumsum(n) - n
            left, right = _sides(run, block)
            part = part.copy()
            links = []
            for a in left:
                b, estimate = _likely(a, right[right > a] if left is right else right, part, n, sig, rule)
                b = b[np.argsort(-estimate, kind="stable")]
                while len(b):
                    few = b[: max(1, int(np.searchsorted(np.cumsum(n[b]), BLOCK_SHINGLES)))]
                    for k in few[_similar(sets[a], flat, starts[few], n[few], rule)]:
                        if part[k] != part[a]:
                            links.append((max(node[a], node[k]), min(node[a], node[k])))
                            part[part == part[k]] = part[a]
                    b = b[len(few) :]
                    b = b[part[b] != part[a]]
            u, v = ([x[c] for x in links] for c in (0, 1))
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return find


def _open_groups(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, part: groups of classes in several components, one for each key or for a cluster of large keys.

    Keys over SMALL_KEY classes that share classes are a cluster. Where comparing all pairs of the cluster is
    less work than those of all its keys, which much the same classes in many keys make it, the cluster is
    the group, and its classes stand in it once. It holds every pair of the keys it holds.
    """
    parted = _with_parts(members.select("key", "node"), labels)
    keys = written(
        parted.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("low"), F.max("part").alias("high"), F.min("node").alias("first"))
        .filter("n > 2 AND low <> high")
        .select("key", "n", "first"),
        "open-keys",
    )
    large = keys.filter(F.col("n") > SMALL_KEY)
    if not large.take(1):
        return attach(parted, keys.select("key", "n"), "key").select("key", "node", "part")

    rows = written(attach(parted, large, "key"), "open-rows")
    links = rows.select(F.col("node").alias("u"), F.col("first").alias("v")).filter("u <> v")
    clusters = components(links)
    nodes = rows.select("node", F.col("part").alias("component")).distinct()
    nodes = written(_with_parts(nodes, clusters).withColumnRenamed("part", "cluster"), "cluster-nodes")
    firsts = _with_parts(large.withColumnRenamed("first", "node"), clusters).withColumnRenamed("part", "cluster")
    firsts = written(firsts, "cluster-keys")
    pairs = firsts.groupBy("cluster").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
    sizes = nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    dense = sizes.join(pairs, "cluster").filter(F.col("n").cast("double") * F.col("n") <= F.col("pairs"))
    dense = written(dense.select("cluster", "n"), "dense-clusters")
    once = attach(nodes, dense, "cluster").select(
        F.xxhash64(F.lit("cluster"), "cluster").alias("key"), "node", F.col("component").alias("part")
    )
    # A key is left out if one such cluster holds all its classes, whatever its size.
    homes = written(attach(nodes, dense, "cluster").select("node", F.col("cluster").alias("home")), "homes")
    held = attach(parted, keys.select("key", "n"), "key").join(homes, "node", "left")
    held = held.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.count("home").alias("at_home"), F.min("home").alias("a"), F.max("home").alias("b")
    )
    single = written(held.filter("at_home < n OR a <> b").select("key", "n"), "single-keys")
    return attach(parted, single, "key").select("key", "node", "part").unionByName(once)


def _in_blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows of every group for each pair of blocks they take part in; ``sizes`` has key, n and blocks."""
    rows = attach(rows, sizes, "key")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("block", "__other"), "j": F.greatest("block", "__other")})
    return _by_blocks(rows.drop("__other", "blocks"))


def _by_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _with_parts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    names = labels.select(F.col("u").alias("node"), F.col("v").alias("__part"))
    return rows.join(names, "node", "left").withColumn("part", F.coalesce("__part", "node")).drop("__part")


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    bounded_batches()
    with scratch() as keep:
        signed, named = _grouped(id_and_text(docs, id_col, text_col), rule)
        keep(signed), keep(named)
    linkable = signed.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    mine = attach(linkable.select("doc_id", "n_shingles", "set_key"), named, "set_key").drop("set_key")
    alone = signed.filter(F.col("set_key").isNull() | F.col("doc_id").isNull())
    alone = alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return mine.select("doc_id", "n_shingles", "component_id").unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def _grouped(texts: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """The signature of every document, and the component of every set; both written."""
    signed = written(signatures(texts, rule.words), "signatures")
    linkable = signed.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = written(
        linkable.groupBy("set_key")
        .agg(F.min(F.struct("doc_id", "n_shingles", "bands", "signature")).alias("first"), F.count(F.lit(1)).alias("n"))
        .select("set_key", "n", F.col("first.doc_id").alias("node"), "first.n_shingles", "first.bands", "first.signature"),
        "classes",
    )
    facts = classes.select("node", "n_shingles", "signature")

    # 1. Band keys that several classes share, and the smallest class of each.
    banded = classes.select(F.explode("bands").alias("key"), "node")
    shared = written(
        banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("centre")).filter("n > 1"), "keys"
    )
    members = written(attach(banded, shared, "key"), "members")

    # 2. Every class against the smallest of its keys; its best link first, then the rest that is still apart.
    star = members.filter("node <> centre").select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct()
    for side in ("u", "v"):
        star = star.join(
            facts.select(
                F.col("node").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("signature").alias(f"sig{side}")
            ),
            side,
        )
    estimate, hopeful = _hopeful(F.col("nu"), F.col("nv"), "sigu", "sigv", rule)
    star = written(star.filter(hopeful).select("u", "v", estimate.alias("estimate")), "star")
    best = star.groupBy("u").agg(F.max(F.struct("estimate", (-F.col("v")).alias("v"))).alias("b"))
    best = written(best.select("u", (-F.col("b.v")).alias("v")), "best")
    labels = components(confirmed(best, texts, rule))
    rest = star.select("u", "v").join(best, ["u", "v"], "left_anti")
    rest = _with_parts(rest.withColumnRenamed("u", "node"), labels).withColumnRenamed("node", "u")
    rest = rest.withColumnRenamed("part", "pu").withColumnRenamed("v", "node")
    rest = written(_with_parts(rest, labels).filter("pu <> part").select("u", F.col("node").alias("v")), "rest")
    if rest.take(1):
        labels = components(confirmed(rest, texts, rule), labels)

    # 3. Groups whose classes are still apart: each row with its likeliest partner elsewhere, and then whatever
    # is left, in tasks that hold the sets of two blocks.
    groups = written(_open_groups(members, labels).join(facts, "node"), "open-groups")
    count = F.count(F.lit(1)).alias("n")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
    sizes = written(groups.groupBy("key").agg(count).select("key", "n", blocks), "group-sizes")
    apart = _in_blocks(groups, sizes).mapInArrow(_nearest_apart(rule), "key long, node long, other long")
    apart = written(apart, "apart")
    if apart.take(1):
        pairs = apart.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct()
        labels = components(confirmed(pairs, texts, rule), labels)
        rows = apart.select("key", "node").distinct()
        nodes = broadcast_if_fits(written(rows.select(F.col("node").alias("doc_id")).distinct(), "nodes"))
        sets = written(full_sets(texts.join(nodes, "doc_id", "left_semi").dropDuplicates(["doc_id"]), rule.words), "sets")
        rows = written(_with_parts(rows, labels).join(facts, "node"), "apart-rows")
        weight = F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)
        sizes = rows.groupBy("key").agg(count, F.sum("n_shingles").alias("shingles"))
        sizes = written(sizes.select("key", "n", F.ceil(weight).cast("int").alias("blocks")), "apart-sizes")
        links = _in_blocks(rows.join(sets, "node"), sizes)
        links = written(links.mapInArrow(_links_apart(rule), "u long, v long").distinct(), "links")
        labels = components(links, labels)

    named = _with_parts(classes.select("set_key", "n", "node"), labels)
    return signed, written(named.select("set_key", "n", F.col("part").alias("component_id")), "named")
