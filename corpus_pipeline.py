"""Stages that turn raw documents into clean token sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept: good texts, of near copies the one with
the smallest id, without those that hold benchmark items, with personal data replaced, as token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import pii_weak, pu_quality, simhash_covering, template_decontam, transducer_bpe
from foliary.llm.common import Workspace, load, without
from foliary.llm.queries import BYTE_BPE

#: The score from which a text is kept.
GOOD = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a score of GOOD or more, as learned from labels and from all documents it is given.

    Null and empty texts are scored like any other, very long ones whole; repeated rows stay or go together; an empty table
    gives none; all columns stay, whatever their names.
    """
    score = free_name(docs, "score")
    model = pu_quality.fit(docs, load(spark, sf_dir, "labels"))
    return pu_quality.score_documents(docs, model, score_col=score).where(F.col(score) >= GOOD).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest id, and rows without an id.

    Null texts are copies of each other and of texts without words, so one of all these stays; repeated rows of the
    document that stays stay; very long texts are compared whole; an empty table gives none; all columns stay.
    """
    return simhash_covering.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that share no window with an item of benchmark, and rows without an id.

    Rows of one id go together; null and empty texts hold nothing; very long ones are read whole; an empty table, or an
    empty benchmark, changes nothing; all columns stay, whatever their names.
    """
    work = Workspace(spark, "decontam")
    found = template_decontam.contaminated(docs, load(spark, sf_dir, "benchmark"), any_case=True)
    gone = work.write(found.select("doc_id").distinct(), "gone")
    return without(docs, {"doc_id": F.col("doc_id").cast("long")}, gone, work)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts, and counts the characters anew where there is a column n_chars.

    No row goes; a null text stays null; repeated rows are changed alike; very long texts are read whole; an empty table
    gives none; all other columns stay.
    """
    clean = pii_weak.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of each row; a null text is an empty one, repeated rows are repeated, an empty table gives none.

    Very long texts are encoded whole. Of docs the columns doc_id and text are read.
    """
    return transducer_bpe.encode_documents(docs, BYTE_BPE, ids=True)


def free_name(docs: DataFrame, name: str) -> str:
    """name, or name with as many underscores before it as no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("BPE encoding and decoding", encoding),
]
#: No stage can be written in SQL; tests/llm/test_pipeline.py compares each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each returns is written to the shared folder and read again.

    A stage's table is removed when the next one has been written; the last but one is read by the result.
    """
    work = Workspace(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = work.write(stage(spark, docs, sf_dir), f"stage-{k}")
        work.drop(f"stage-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
