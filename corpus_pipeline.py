"""A training-data pipeline over `documents`, each stage one operator of weir.llm.

toxicity      documents that the model rejects go
line_dedup    later repeats of two lines or more, or of one line of 50 words or more, go; documents left without a word stay as empty ones
near_dedup    of each group of near-duplicates (fingerprints within op6's bits, by its tries, or 5-word shingles of
              Jaccard 0.8 or more, by an exact join after them) the document of least doc_id stays
mix           each document is repeated, or dropped, as its source's target weight asks
encode        ids of what is left, and their decoding

run() applies them to the whole table. Every stage is written and read again, so a lost executor
costs at most the stage at hand. A stage first deletes the scratch tables of the one before it, whose
result must have been written by then.

Nulls and odd rows: null and blank texts pass all filters but the mix, which never takes a text
without words; texts may have any length. Rows with a null doc_id are scored, kept by both dedup
stages, and mixed. Rows of one doc_id with different texts are judged apart; rows alike in both are one
near-duplicate group, of which one stays. Other columns are passed through up to the last stage, whatever their names
(but for names that start with _weir_). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weir.llm.byte_bpe import round_trips
from weir.llm.common import cut, owned, read, sweep
from weir.llm.line_dedup import LONG_WORDS, dedup_lines
from weir.llm.mixing import mixed
from weir.llm.shingle_join import one_of_each
from weir.llm.toxicity import reject_toxic


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(work: Stage) -> Stage:
    def applied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, "pipeline")
        with owned("pipeline"):
            return work(spark, docs, sf_dir)

    return applied


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, read(spark, sf_dir, "labels"))


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs, long_words=LONG_WORDS)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trips(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]

#: SQL cannot express the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{name}", keep=True)
    return docs
