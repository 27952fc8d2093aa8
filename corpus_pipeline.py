"""The corpus pipeline: five operators of hourgrid.llm one after the other."""

from pyspark.sql import DataFrame, SparkSession

from hourgrid.llm import bpe, minhash, mixing, suffixes, toxicity
from hourgrid.llm.common import staged, table

#: (name, function of (spark, docs, sf_dir)); each works on all that the one before it kept.
STAGES = [
    ("toxicity", toxicity.stage_toxicity),
    ("near_duplicates", minhash.stage_near_duplicates),
    ("repeated_passages", suffixes.stage_repeats),
    ("mixing", mixing.stage_mix),
    ("tokens", bpe.stage_encode),
]

#: The stages are not expressible in SQL; tests/llm compares them with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; between stages the rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
