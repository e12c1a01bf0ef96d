"""A corpus pipeline of five stages over the documents of a folder.

Toxic documents go, one document of each group of near copies stays, passages that
repeat a smaller doc_id go from the texts, personal data and the terms that reveal it
go from the texts, and what is left is packed into training sequences. Each stage
reads what the one before it wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from postwarden.llm.packing import pack_documents
from postwarden.llm.pii import sanitise
from postwarden.llm.simhash import keep_first
from postwarden.llm.substrings import drop_repeats
from postwarden.llm.toxicity import drop_toxic
from postwarden.session import bounded_parts, cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bounded(stage: Stage) -> Stage:
    """Executors that go through all stages keep the memory that the largest one took, so
    each stage moves its texts in small parts; this holds for the session from then on."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(bounded_parts(spark), docs, sf_dir)

    return run


#: (name, function of (spark, docs, sf_dir) to the next stage's docs)
STAGES = [
    ("toxicity", _bounded(drop_toxic)),
    ("simhash", _bounded(keep_first)),
    ("substrings", _bounded(drop_repeats)),
    ("pii", _bounded(sanitise)),
    ("packing", _bounded(pack_documents)),
]

#: SQL has neither the classifier nor the tokenizer; the tests hold each stage
#: against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences of all documents that are left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
