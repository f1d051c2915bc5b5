"""The training-text pipeline: quality rules, n-gram Jaccard join, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps: rejected documents are gone, one document of
each near-copy group stays, contaminated documents are gone, personal data is replaced by its type, and what is
left is packed into sequences. All stages but the last return the columns of documents.

The first stage follows the joint verdict of the rules alone, so that a short clean document stays.

Defined cases: as the operators state them; in short, null and empty texts fail the quality rules, repeated rows
of one id leave one row after the second stage, extra columns pass through all stages but the last, and empty
tables give an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospark.llm import decontaminate, jaccard_join, packing, pii, quality_rules
from heliospark.llm.shared import TABLES, drop_tables, stored, table

#: The rows depend on a fitted model, on union-find and on a search for a packing.
ORACLE_SQL = None


#: By session and input folder: tables that the last stage made for itself.
_made: dict[tuple[str, str], list[str]] = {}


def stage(f):
    """A stage that first deletes what the stage before it on the same input made for itself: that one's result has been written by then, or else docs still reads those tables, and they stay."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        old = _made.get(key, [])
        read = docs.inputFiles() if old else []
        drop_tables(spark, [t for t in old if t in TABLES and not any(t in x for x in read)])
        before = set(TABLES)
        out = f(spark, docs, sf_dir)
        _made[key] = [t for t in TABLES if t not in before]
        return out

    run_stage.__doc__, run_stage.__name__ = f.__doc__, f.__name__
    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.quality_filter(docs)


@stage
def dedupe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


@stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@stage
def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs).select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", dedupe), ("decontaminate", decontaminated), ("pii", private), ("pack", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = step(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
