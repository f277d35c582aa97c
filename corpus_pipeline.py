"""The corpus pipeline: documents through five operators of pagelattice.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelattice.llm import common, digest_dedup, pair_bpe, set_join, source_mix, toxic_crf


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the random field predicts to be toxic; it learns from the labels of `documents`."""
    model = toxic_crf.train(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxic_crf.clean(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, leaves the one that the digest index keeps."""
    index = digest_dedup.new_index(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = digest_dedup.survivors(docs, index)
    index.forget()
    return out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at five words and a similarity of 0.8, leaves the one with the smallest doc_id."""
    return set_join.survivors(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as the source mix takes it."""
    return source_mix.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    import public_tokenizers

    # written here, in batches of a bounded size: workers and executors hold few of them at a time
    return common.staged(pair_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json")), "token-digests")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("bpe", tokens)]
#: SQL can't express the first stage's model. Tests hold run() to planted toxic rows, to plain Python versions of both dedups, to the SQL of the mix and to
#: the tokenizers library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
