"""A training corpus from raw documents: known language, not toxic, one of each group of copies, no benchmark, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of documents. Rows, repeated ones too, are handled as the
operators say; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clienttrace.llm import bpe, decontaminate, language, simhash, toxicity
from clienttrace.llm.common import fold, written
from clienttrace.llm.queries import TOKENIZER, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects: no letter, or no language likely enough."""
    return language.keep_known(docs, language.fit(docs, fold("doc_id", 4) != 2))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored 0.5 or more."""
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.keep_clean(docs, machine)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the document with the smallest id of each group of near copies."""
    return simhash.deduplicate(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item or a paraphrase of one."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and digests of ids and decoded text."""
    return bpe.digests(bpe.encode(docs, TOKENIZER))


STAGES = [("language ID", known_language), ("toxicity", not_toxic), ("SimHash near-dedup", near_duplicates),
          ("benchmark decontamination", benchmark_free), ("BPE encoding and decoding", tokens)]

#: Fitted models and fingerprints are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
