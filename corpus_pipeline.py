"""The corpus pipeline: from documents to token files, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of
`documents`; the last one's rows are the documents of the token files it wrote.

Every stage passes extra columns through, also those named like a stage's own, reads texts whole, and
gives an empty table for an empty one. Rows without a doc_id are rows like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import decontaminate, minhash, mixing, quality, token_output
from quantloom.llm.common import fresh, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels' training rows among them.

    A null or empty text is scored by its statistics, which are zeros; repeated rows go or stay together;
    without a label to learn from every score is 0.5, and all stay.
    """
    name = fresh(docs, "score")
    return quality.with_score(docs, quality.learned(spark, sf_dir, docs), name).where(f"{name} >= 0.5").drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at five-word shingles and a similarity of 0.8.

    A group's smallest doc_id stays, null only if all are; repeated rows are one group. Texts without words
    are linked with nothing and all stay, null ones too.
    """
    return minhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't repeat the benchmark.

    A null or empty text has no words to be hit and stays; repeated rows go or stay together; an empty
    benchmark hits nothing.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    A null source is a source; documents without words stay once; repeated rows may get different numbers
    of copies; without any words every row stays once.
    """
    return mixing.mixed_documents(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the token files.

    A null or empty text is the end id alone; rows of one doc_id, null first, each have their own place.
    """
    return token_output.token_files(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix_sources),
    ("token files", write_token_files),
]

#: The classifier and the sketches have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over `documents` of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
