"""Corpus pipeline over whole tables: quality rules, near-duplicate removal,
benchmark decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; all but the last return the columns of ``documents``. Rows that
are equal in id and text are one document to the stages that drop rows by
comparison. Nulls and empty texts follow the operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import decontaminate, jaccard_join, packing, quality, secrets
from basketry.llm.common import stored, table
from basketry.llm.queries import VOCABULARY


def _key() -> Column:
    """A document's name within a stage, 128 bits of its id and text."""
    return F.md5(F.concat(*[part for c in ("doc_id", "text") for part in (
        F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.lit("v"), F.length(F.col(c).cast("string")).cast("string"), F.lit(":"))),
        F.coalesce(F.col(c).cast("string"), F.lit("")))]))


def _documents(docs: DataFrame, *more: Column) -> DataFrame:
    """``docs`` with each row as one ``document``, so that no column of a user meets
    one of an operator."""
    return docs.select(F.struct(*docs.columns).alias("document"), *more)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(_key().alias("doc_id"), "text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    judged = quality.quality_rules(_documents(docs, F.col("text")))
    return judged.where(F.col("rejected_by").isNull()).select("document.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays, of its
    repeated rows the least."""
    groups = jaccard_join.jaccard_components(_named(docs), merge=True).select(F.col("doc_id").alias("key"), "component_id")
    ids = docs.select(_key().alias("key"), F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id").alias("id"))
    kept = (groups.distinct().join(ids, "key").groupBy("component_id")
            .agg(F.min(F.struct("id", "key")).alias("first")).select(F.col("first.key").alias("kept")))
    keyed = _documents(docs, _key().alias("kept")).join(kept, "kept", "left_semi")
    return keyed.groupBy("kept").agg(F.min("document").alias("document")).select("document.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    spans = decontaminate.contaminated_words(_named(docs), table(spark, sf_dir, "benchmark"))
    hit = spans.where(F.size("spans") > 0).select(F.col("doc_id").alias("key")).distinct()
    keyed = _documents(docs, _key().alias("key"))
    return keyed.join(hit, "key", "left_anti").select("document.*")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by marks of their kind."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids."""
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage),
          ("decontamination", decontamination_stage), ("secrets", secret_stage), ("packing", packing_stage)]

#: Neither components nor packing can be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
