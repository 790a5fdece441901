"""A training-data pipeline of five stages over documents: quality, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; the first four return the
columns of docs. ``run`` writes each stage's rows as Parquet into the shared folder and reads them again, so that a
lost executor costs no more than the work of one stage.

quality  drops the documents that fail a base rule or score below the threshold (statistics over this stage's input)
dedup    keeps the smallest id of each group of near-duplicates (word shingles of five, similarity 0.8 or more)
secrets  replaces every secret by [SECRET]
mix      puts the rows in the order of the sources' schedule, which files and rows of the output follow
encode   replaces the text by its token ids; file, block and row give a row's place in the mixed order

Empty tables, nulls in any column, repeated rows and further columns are handled as the operators state; further
columns pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bottom_k, bpe_automaton, mixing, quality, secret_scan
from lodestone.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.trusted_ratios(spark, docs, sf_dir))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bottom_k.deduplicated(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_automaton.encoded_in_order(docs, bpe_automaton.default_path())


STAGES = [("quality", quality_stage), ("dedup", dedup_stage), ("secrets", secrets_stage), ("mix", mix_stage), ("encode", encode_stage)]

#: SQL can express neither the quality score nor the encoding; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
