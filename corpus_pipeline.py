"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one
reads it back from Parquet.  All but the last return the columns of documents,
and any further ones that the table has; the last returns the ids of each
document of the mix, their count and digests.

Defined results: decisions are made by row, so a null id, or one that several
rows share, costs no other row its place; of rows equal in id and text one stays
after the dedup stages; a null text counts as empty; the mix leaves out texts
without words and repeats documents of sources below their target; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import common, op1_exact_dedup, op2_minhash, op5_mixing, op7_quality, op9_bpe

STAGES = [
    ("quality classifier", op7_quality.stage),
    ("exact dedup", op1_exact_dedup.stage),
    ("MinHash near-dedup", op2_minhash.stage),
    ("mixing to target weights", op5_mixing.stage),
    ("byte-level BPE", op9_bpe.stage),
]

#: SQL can't express the classifier, the sampling, or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        # what a stage has written goes with its result's being stored, its input with the next one's
        given, docs = docs, common.only(lambda: stage(spark, docs, sf_dir))  # noqa: B023
        if "stored_at" in vars(given):
            common.dropped(given)
    return STAGES[-1][1](spark, docs, sf_dir)
