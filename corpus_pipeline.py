"""The corpus pipeline: five stages, each of which works on the Parquet files of the one before.

Runs over `documents` (doc_id, text, lang, source, n_chars). All stages but the
last return these columns; the last returns the digests of each document's tokens.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panewright.llm import bpe, exact_dedup, language_id, mixing, simhash
from panewright.llm.common import shared_dir, table
from panewright.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which a language is found. Prototypes are learnt from the rows with a language that are not held out."""
    train = docs.where(~language_id.held_out(F.col("doc_id")))
    found = language_id.predict(docs.select(*COLUMNS), language_id.fit(train), COLUMNS)
    return found.where(F.col("lang_pred") != language_id.NONE).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, by their chunk recipes, stays."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, or up to three times."""
    return mixing.repeat(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each document's tokens, and of the text that they decode to."""
    return bpe.digests(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: Trained prototypes, SimHash and BPE have no SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage keeps is written to the shared folder, read again by the next, and deleted when that has written in its turn."""
    docs, folder, last = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid4().hex}", ""
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(path := f"{folder}/{k}-{name}")
            docs = spark.read.parquet(path)
            if last:
                old = spark._jvm.org.apache.hadoop.fs.Path(last)
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
            last = path
    return docs
