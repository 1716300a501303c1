"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import crc_mod, last_only, materialize, table, unused, with_row_key
from lodestrata.llm.decontaminate import decontaminate
from lodestrata.llm.jaccard import jaccard_components
from lodestrata.llm.langid import fit, keep_identified
from lodestrata.llm.packing import best_fit_packing
from lodestrata.llm.pii import redact

NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def _without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows of docs, without their key, whose key is not in gone (of one column)."""
    other = unused(docs, "_gone")
    return docs.join(gone.toDF(other), F.col(key) == F.col(other), "left_anti").drop(key)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no text, no letter, or no language with a third of the text (mixtures of two stay).

    Null and empty texts go; other null columns, repeated rows, very long texts and further columns stay as they are.
    """
    return keep_identified(docs, fit(docs.where(crc_mod("doc_id", 4) != 2)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, that of the smallest id (a null id counts as larger than any other).

    Documents are linked at a Jaccard similarity of 0.8 on shingles of five words; four words and 0.85 bind op5_jaccard alone.
    Of repeated rows one stays; null and empty texts link with nothing and stay; further columns, of any name, are kept.
    """
    keyed, key = with_row_key(docs)
    gone = lambda: jaccard_components(keyed, shingle=NEAR_SHINGLE, percent=NEAR_PERCENT, key=key).where("not kept").select(key)
    return _without(keyed, key, last_only(spark, gone, "dropped"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts stay, each repeated row is judged alike; further columns, of any name, are kept.
    """
    keyed, key = with_row_key(docs)
    body = keyed.select(F.col(key).alias("doc_id"), "text")
    return _without(keyed, key, last_only(spark, lambda: decontaminate(body, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id"), "leaks"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no document goes.

    Null and empty texts stay as they are, repeated rows are treated alike; further columns, of any name, are kept.
    """
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences.

    A null or empty text is its separator alone, repeated rows are packed as often as they occur; further columns are left out.
    """
    return best_fit_packing(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packing)]

#: Language inference, the bootstrap and token ids are beyond SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
