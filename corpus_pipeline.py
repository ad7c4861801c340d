"""From raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
stored and read again as the next one's ``docs``. All stages but the last
return the columns of ``documents``:

1. toxicity: documents scored one half or more go;
2. exact_dedup: of equal texts the largest doc_id stays;
3. jaccard_join: of each class of near-duplicates the least doc_id stays;
4. secret_scan: found secrets are replaced by their kind in the text;
5. packing: what is left becomes token pieces placed in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavelattice.llm import exact_dedup, jaccard_join, packing, secrets, toxicity
from wavelattice.llm.shared import stored

#: No stage but the exact one can be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("secret_scan", hide_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
