"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.llm import langid, mixing, packing, simhash, toxicity
from sparkweft.llm.common import shared_folder, table
from sparkweft.llm.queries import tokenizer

#: A document is rejected if its language is undetermined or its mean probability is below this.
LEAST_LANGUAGE_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(docs, carry=True)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.score(docs, table(spark, sf_dir, "labels"), carry=True).where("predicted = 0").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the smallest id, if any has one, then the first by the text's hash, then by the row's."""
    key = F.concat(F.md5(F.coalesce("text", F.lit(""))), F.coalesce(F.concat(F.lit(":"), F.col("doc_id").cast("string")), F.lit("")))
    keyed = docs.withColumn("__key", key)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "__key")).alias("first")
    kept = simhash.near_duplicates(keyed, carry=["__key"]).groupBy("component").agg(first).select(F.col("first.__key").alias("__key"))
    # rows of one key differ in other columns at most; a partial aggregate leaves one of them before the exchange
    rows = keyed.groupBy("__key").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return rows.join(kept, "__key", "left_semi").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language ID", language),
    ("toxicity", toxic),
    ("SimHash near-dedup", one_of_each_group),
    ("mixing", mixed),
    ("packing", packed),
]

#: Trained models and hashes of whole texts are beyond SQL; tests compare near-dedup, mixing and packing with plain code,
#: the networks' scores with plain loops, and the stages' effects with their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            # the next stage reads what was just written, so the table before it can go
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return docs
