"""From documents to packed training sequences.

Five stages; each reads what the one before has kept, as Parquet. All but the last return the
columns of `documents`.

1. quality rules: documents that fail go, frequent lines of a host go from the others; a long line is frequent
   in a hundredth of the documents, others in a tenth
2. line dedup: runs of three lines or of fifty words that occurred before go, and documents that were nothing else
3. near duplicates on five-word shingles: one document of each group stays
4. mixing: all documents, in the order that keeps the sources at their target weights
5. packing: token pieces in sequences of 2048; by sequence_id they follow the mix

A row without doc_id passes as any other; it comes after all others where order matters and is linked
with nothing. A null text has no words and fails the first stage. An empty table gives no rows.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spendtide.llm import lines, minhash, mixing, packing, quality
from spendtide.llm.common import staged, table

# Weights of the mix; sources not named weigh 1.
WEIGHTS = {"src0": 4, "src1": 2, "src2": 2}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs, long_lines=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.clean(docs, words=lines.MIN_WORDS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_copies(docs, size=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, WEIGHTS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary, ranks = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
    # Files keep no order, so the places in the mix are worked out again from the rows that it has kept.
    placed = mixing.mix(docs.select("doc_id", "text", "source"), WEIGHTS)
    pieces = packing.cut_pieces(placed, vocabulary, ranks, also=("slot_", "start_"))
    return packing.pack(pieces, order=("slot_", "start_", "doc_id", "piece")).drop("slot_", "start_")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

# Components and best fit are not for SQL to state: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
