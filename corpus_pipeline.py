"""A training-corpus pipeline over documents; each stage's result is written and read again as the next one's docs.

Toxic documents go; one document of each near-duplicate group stays; secrets are masked; sources are mixed to their
target weights (a document taken twice is two rows); what is left is encoded with SentencePiece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.llm import mixing, secret_scan, sentencepiece_codec, simhash_dedup, toxicity
from revlake.llm.common import cut, row_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose toxicity is below 0.7.

    Null and wordless texts get the sample's share of toxic documents, so they stay; equal texts fare alike; repeated
    rows and null ids stay. Columns beside those of documents are dropped. An empty table stays empty.
    """
    net = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), net).filter("toxicity < 0.7").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group: that of the smallest id, rows without an id last.

    Rows are told apart by all their columns, so a row is never dropped for an id that it shares with another text; of
    equal rows one stays. Null and wordless texts are one group. An empty table stays empty.
    """
    return simhash_dedup.keep_one(docs.select(*COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; n_chars follows the text.

    Null texts stay null, with null n_chars; every row is judged by itself, so repeated rows and null ids stay. An
    empty table stays empty.
    """
    rows = docs.select("doc_id", "text", "lang", "source", F.col("text").isNull().alias("no_text"))
    found = secret_scan.scan(rows, keep=("lang", "source", "no_text"))
    text = F.when(~F.col("no_text"), secret_scan.redacted(F.col("body"), F.col("spans")))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    The mix judges rows by 128 bits of hash over all their columns, nulls included, so rows that share an id are taken apart; wholly equal rows
    are taken as often as all of them together. Null texts and texts without words are not taken. An empty table stays
    empty.
    """
    keyed = docs.select(*COLUMNS).withColumn("row_key", row_key(COLUMNS))
    taken = mixing.mix(keyed, key="row_key").filter("reps > 0").groupBy(F.col("row_key").alias("mix_key")).agg(F.sum("reps").cast("int").alias("reps"))
    rows = keyed.dropDuplicates(["row_key"]).join(taken, F.col("row_key") == F.col("mix_key"))
    return rows.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("reps")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the SentencePiece ids (packed 32-bit, and their number).

    Null and empty texts have no ids; every row is encoded by itself, so repeated rows and null ids stay. An empty
    table stays empty.
    """
    coded = sentencepiece_codec.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"), packed=True)
    return coded.select("doc_id", "source", F.expr("length(ids) div 4").alias("n_pieces"), "ids")


STAGES = [("toxicity", drop_toxic), ("simhash_dedup", drop_near_duplicates), ("secret_scan", mask_secrets), ("mixing", mix_sources), ("sentencepiece", encode)]
#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
