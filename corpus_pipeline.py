"""From raw documents to packed training sequences, a stage at a time.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and reread as the next one's ``docs``.  All but the last return the columns of documents, whatever
further ones there are and however these are named.  Empty tables give empty results; texts
are read whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelframe.llm import decontamination, minhash, packing, secrets, toxicity
from labelframe.llm.common import table, write_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches their language's threshold go.

    Null and empty texts are scored as texts without words; repeated rows share their fate; a score
    equal to the threshold is toxic.  Without labels of both classes nothing is learned.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    # The row travels as a struct, so columns of the documents that are named like a result stay.
    scored = toxicity.score(docs.select(F.struct("*").alias("_row"), "text", "lang"), model)
    return scored.where(~F.col("toxic")).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that of the smallest id, once if its row is repeated.

    Null texts count as empty; all empty ones are copies of one another.  A null id is the smallest only in a class of null ids.
    """
    return minhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go.

    Null and empty texts leak nothing; repeated rows share their fate; repeated items count once.
    """
    return decontamination.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; documents without any stay as they are, null and empty texts too.

    Repeated rows are redacted alike; ``n_chars`` follows the text where it changes.
    """
    found = secrets.scan(docs.select(F.struct("*").alias("_row"), "text"), secrets.train(secrets.labelled_samples(docs)))
    any_found = F.size("found") > 0
    clean = found.withColumn("_clean", secrets.redacted(F.col("text"), F.col("found")))
    changed = {"text": F.col("_clean"), "n_chars": F.when(any_found, F.length("_clean").cast("long")).otherwise(F.col("_row.n_chars"))}
    return clean.select(*[changed[c].alias(c) if c in changed else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens; a row per piece.

    Null and empty texts are documents of the end id alone; repeated rows are packed each on their own.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secret_scans", redact_secrets),
    ("packing", pack),
]

#: The models, the signatures and the tokenizer have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
