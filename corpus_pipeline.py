"""Clean a corpus and pack it: toxicity, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run() applies them to
the documents table, each stage's output written as Parquet to the shared folder and read again as the next one's docs. Those folders
(stage-*) may go once the result of run() is written.

Columns of any name are carried along unchanged; none can clash with what a stage adds on its way. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.llm import decontamination, minhash_dedup, packing, pii, toxicity
from parallax.llm.common import staged, table

#: Words of a shingle, and the share of equal shingles (in per cent) from which documents are near duplicates.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold, learned from the labelled ones.

    Null and empty texts have the score of no evidence and stay unless nearly all labels are toxic; repeated rows are each judged alike;
    rows with a null id are judged but never learned from. Long texts and runs without white space are read to their end.
    """
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored_rows(docs, model, docs.columns).filter(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the least id.

    Of equal rows one stays; if an id repeats with different texts of a group, the one whose set of shingles has the least key. Rows with
    a null id stay only where their group has no id. Texts that are null or without words have no near duplicates and all stay.
    """
    return minhash_dedup.keep_one(docs, SHINGLE, PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts hold none and stay, repeated rows go or stay together, and null ids don't matter; null items match nothing.
    """
    found = decontamination.contamination_rows(docs, table(spark, sf_dir, "benchmark"), docs.columns)
    return found.filter(F.size("matches") == 0).select("row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind, and n_chars as it is then.

    Null and empty texts stay as they are; each row is masked for itself, repeated or null ids included. Without an n_chars column none is
    added.
    """
    masked = pii.redact(docs, pii.train_pii(docs))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of 4096.

    Each row is a document of its own, repeated or null ids included; null and empty texts are the end id alone.
    """
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
