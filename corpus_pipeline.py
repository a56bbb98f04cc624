"""The corpus pipeline: documents without toxic ones, copies, benchmark passages and personal data, as token ids.

Every stage takes (spark, docs, sf_dir) and returns a frame; each is written and
read again before the next. All but the last return the columns they were given,
whatever these are called and of whatever type. Empty tables pass through. NULL texts read as empty:
they are not toxic, copies of nothing, clean of passages, and become no ids. Rows
with a NULL doc_id cannot be named in a decision on copies or passages, so those two
stages keep them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.bounded import broadcast_if_fits
from evenkeel.llm.bpe import bpe_round_trip
from evenkeel.llm.common import written
from evenkeel.llm.decontaminate import SHORTEST, find_overlaps
from evenkeel.llm.minhash import Rule, near_duplicates
from evenkeel.llm.pii import redacted
from evenkeel.llm.queries import TOXIC_FROM, learnable, tokenizer_path
from evenkeel.llm.toxicity import toxicity, toxicity_model
from evenkeel.plans.base import table


def fresh(name: str, docs: DataFrame) -> str:
    """A column name that none of the documents' columns has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is not among ``ids``."""
    gone = fresh("gone", docs)
    ids = broadcast_if_fits(written(ids.select(F.col("doc_id").alias(gone)).distinct(), "gone"))
    return docs.join(ids, docs["doc_id"] == ids[gone], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC_FROM, by a model of the learnable labels."""
    model = toxicity_model(docs.filter(learnable("doc_id")), table(spark, sf_dir, "labels"))
    score = fresh("toxicity", docs)
    return docs.withColumn(score, toxicity(docs, F.col("text"), model)).filter(F.col(score) < TOXIC_FROM).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and one row of each document."""
    judged = near_duplicates(docs, Rule(words=5, percent=80)).filter("doc_id IS NOT NULL")
    judged = judged.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    judged = written(judged.filter("NOT kept OR n > 1"), "judged")
    left = without(docs, judged.filter("NOT kept"))
    again = judged.filter("kept")
    if not again.take(1):
        return left
    # the rows of repeated ids are numbered as they are written, so that one of them can be named
    again_id, row = fresh("again", docs), fresh("row", docs)
    ids = broadcast_if_fits(again.select(F.col("doc_id").alias(again_id)))
    rows = left.join(ids, left["doc_id"] == ids[again_id], "left_semi")
    rows = written(rows.withColumn(row, F.monotonically_increasing_id()), "repeated")
    first = rows.groupBy("doc_id").agg(F.min(F.struct("text", F.col(row).alias("row"))).alias("first"))
    first = first.select(F.col("first.row").alias(row))
    return without(left, again).unionByName(rows.join(first, row, "left_semi").drop(row))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item of SHORTEST words or more; fewer words stand in clean texts too."""
    overlaps = find_overlaps(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, overlaps.filter(F.col("item_words") >= SHORTEST))


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the name of its kind in place of each piece of personal data."""
    docs = docs.withColumn("text", redacted(F.col("text")))
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    coded = docs.select("doc_id", text.alias("text"), bpe_round_trip(spark, F.col("text"), tokenizer_path()).alias("coded"))
    return coded.select(
        "doc_id",
        F.size("coded.ids").cast("long").alias("n_tokens"),
        F.col("coded.ids").alias("ids"),
        (F.col("coded.decoded") == F.col("text")).alias("exact"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("personal_data", hide_personal),
    ("bpe", to_ids),
]

# A trained model and a tokenizer have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
