"""The corpus pipeline: language ID, line dedup, near duplicates, benchmark decontamination, packing.

Each stage reads what the one before kept, written as Parquet. All but the last give the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmc.llm import decontam, langid, linededup, ngramjoin, packing
from panelmc.llm.queries import tokenizer_path
from panelmc.llm.shared import stored

#: Documents of which test items' passages are more than this share of the words go as a whole.
MOST_TEST_SHARE = 0.5
HAS_LETTER = r"\p{L}"
#: Bytes of a batch of rows that goes to a Python worker, about. Spark's are of 10,000 rows or 64 MB; an executor has several copies of each task's batch,
#: outside its heap and in the worker.
BATCH_BYTES = 2 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage in a session whose batches are of BATCH_BYTES. The session keeps that, since the result is read after the stage has returned."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


def with_text(docs: DataFrame, like: DataFrame) -> DataFrame:
    """docs with the columns of like; n_chars, where there is one, is that of the text as it is now."""
    out = docs.select(*[f"`{c}`" for c in like.columns])
    if "n_chars" in like.columns:
        out = out.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return out


@in_small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents' own texts and lang; documents of no language go: those that are null or without a letter, and those that the
    languages' contexts code in more bits than their bytes' shares alone. Where no row has a lang to learn from, the others stay."""
    model = langid.fit(docs.select("text", "lang"))
    if not model.languages:
        return docs.where(F.col("text").rlike(HAS_LETTER))
    return langid.predict(docs, model).where(~langid.unfit()).select(*[f"`{c}`" for c in docs.columns])


@in_small_batches
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that another document keeps go. Documents stay, those that were nothing but such lines with an empty text."""
    return with_text(linededup.drop_repeated_lines(docs), docs)


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group stays. Five words a shingle, a similarity of 0.8."""
    return ngramjoin.first_of_groups(docs, 5, 80)


@in_small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items (10 words and more) go, and documents that are mostly such."""
    out = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10, MOST_TEST_SHARE)
    out = out.where("clean_text is not null or text is null").withColumn("text", F.col("clean_text"))
    return with_text(out, docs)


@in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = packing.pack(docs, tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Code lengths, near-duplicate components and packing aren't for SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
