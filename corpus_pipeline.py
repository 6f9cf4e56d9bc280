"""The corpus pipeline: documents in, cleaned and tokenised documents out.

Each stage works on all rows its predecessor kept. ``run`` writes each
stage's result as Parquet in the session's shared folder and the next stage
reads it back, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm import decontaminate, exact_dedup, ngram_join, piece_codec, toxicity
from claimlens.llm.queries import vocabulary_file
from claimlens.llm.tables import written, written_and_told
from claimlens.session import scratch_path

#: a text with a toxicity of this or more goes
TOXIC_AT = 0.7


def without(docs: DataFrame, text_hash: Column, gone: DataFrame, kept: DataFrame) -> DataFrame:
    """docs less the rows that gone names by doc_id (null is an id like others)
    and text hash (x); of rows that kept names more than once, one stays."""
    columns = docs.columns
    rows = docs.withColumn("_x", text_hash)

    def told_by(names: DataFrame) -> Column:
        return (F.col("_x") == names["x"]) & F.col("_id").eqNullSafe(names["doc_id"])

    rows = rows.withColumnRenamed("doc_id", "_id")
    left = rows.join(gone, told_by(gone), "left_anti")
    several, told = written_and_told(kept.groupBy("doc_id", "x").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "x"), "several", n=F.count(F.lit(1)))
    if told["n"]:
        one = left.join(several, told_by(several), "left_semi").groupBy("_id", "_x").agg(F.min(F.struct(*[F.col(c) for c in left.columns])).alias("_row")).select("_row.*")
        left = left.join(several, told_by(several), "left_anti").unionByName(one)
    return left.withColumnRenamed("_id", "doc_id").select(*columns)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below TOXIC_AT; learnt from labelled rows of all folds."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_below(docs, model, TOXIC_AT)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row: that of the smallest id, or one without an id where none has any."""
    verdict = written(exact_dedup.exact_dedup(docs, keep="smallest").select("doc_id", F.unhex("text_sha256").alias("x"), "kept"), "verdict")
    sha = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    return without(docs, sha, verdict.where("not kept").select("doc_id", "x").distinct(), verdict.where("kept").select("doc_id", "x"))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links join one row: that of the smallest id (no id comes last), then the smallest text hash."""
    gone, kept = ngram_join.copies_and_kept(docs, shingle=5, similarity=0.8)
    return without(docs, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), gone, kept)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    return piece_codec.digests(docs, vocabulary_file("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("ngram_join", remove_near_copies),
    ("decontamination", remove_leaks),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch_path(spark, f"corpus-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: the classifier's scores and the tokenizer's ids have no SQL form: tests hold the stages against brute force
ORACLE_SQL = None
