"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import sql
from evenkeel.llm.ann import nearest
from evenkeel.llm.bpe import bpe_decode, bpe_encode
from evenkeel.llm.centroids import cluster_vectors
from evenkeel.llm.decontaminate import find_overlaps
from evenkeel.llm.html_text import article_text
from evenkeel.llm.licences import licence_scan
from evenkeel.llm.minhash import Rule, near_duplicates
from evenkeel.llm.pii import BASE, personal_spans
from evenkeel.llm.resample import importance_resample
from evenkeel.llm.sharding import shard_by_bytes
from evenkeel.llm.substrings import cut_repeats
from evenkeel.llm.toxicity import toxicity, toxicity_model
from evenkeel.llm.warc import read_warc, write_warc
from evenkeel.plans.base import Query, table
from evenkeel.session import new_path

SHARDS = 16
TOXIC_FROM = 0.7


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    ids = table(spark, sf_dir, "documents").select("doc_id", bpe_encode(spark, F.col("text"), path).alias("ids"))
    both = ids.select("doc_id", "ids", bpe_decode(spark, F.col("ids"), path).alias("decoded"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Rule(words=2, percent=80))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that overlap."""
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", personal_spans(F.col("text")).alias("found"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def of_kind(kind):
        return F.filter("found", lambda s: s.kind == kind)

    base = F.filter("found", lambda s: s.kind.isin(*BASE))
    return found.select(
        "doc_id",
        *(F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in BASE),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", article_text(F.col("html")).alias("text"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://", 1)
    write_warc(table(spark, sf_dir, "pages"), folder, at_least=0)
    return read_warc(spark, folder).drop("payload")


def remainder(id_col: str):
    """crc32 of the id as text, modulo 3; rows of remainder 1 are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def learnable(id_col: str):
    return remainder(id_col) != 1


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs.filter(learnable("doc_id")), table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity(docs, F.col("text"), model).alias("score"))
    return scored.select(
        "doc_id",
        (remainder("doc_id") == 1).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


def licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", licence_scan(F.col("text")).alias("f"))
    return found.select(
        "doc_id",
        "f.n_words",
        "f.n_base",
        "f.first_word",
        "f.last_word",
        F.array_join("f.base_labels", ",").alias("base_labels"),
        F.array_join("f.labels", ",").alias("labels"),
        F.when(F.col("f.n_words") > 0, F.col("f.covered") / F.col("f.n_words")).otherwise(0.0).alias("score"),
    )


def resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_bpe": Query(bpe),
    "op2_minhash": Query(minhash),
    "op3_sharding": Query(sharding),
    "op4_decontamination": Query(decontamination),
    "op5_html": Query(html),
    "op6_pii": Query(pii),
    "op7_ann": Query(ann),
    "op8_warc": Query(warc),
    "op9_toxicity": Query(toxic),
    "op10_licences": Query(licences),
    "op11_resampling": Query(resampling, sql.RESAMPLING),
    "op12_centroids": Query(clustering, sql.CENTROIDS),
    "op13_substrings": Query(substrings, sql.SUBSTRINGS),
}
