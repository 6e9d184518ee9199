"""The corpus pipeline: stages over ``documents``, each on all that the one before kept.

1. toxicity: documents that score at or over the threshold go.
2. line_dedup: lines that several documents hold stay in one.
3. near_duplicates: of documents linked by shingle similarity the one with the smallest id stays.
4. pii: personal data is replaced by its kind.
5. packing: the texts as pieces of sequences of 2048 ids.

All but the last return the columns of ``documents``; where a text changes, ``n_chars`` follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import jaccard_join, line_dedup, packing, pii, toxicity
from millrace.llm.common import free_prefix
from millrace.llm.queries import WORD_MODEL, tokenizer_path
from millrace.scratch import written


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on all labelled documents that are here; a document without text is scored as the rest, by the share of labels alone."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.filter_toxic(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup.line_dedup(docs).select(*[F.col(f"`{c}`") for c in docs.columns]))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Documents without words are linked with nothing and stay, as do rows without id. Of rows repeated under one id one
    stays: the one with the smallest text, null first.
    """
    found = jaccard_join.jaccard_join(docs.where("doc_id is not null"))
    mark = free_prefix(docs.columns, "gone_")
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(f"{mark}id")).distinct()
    kept = docs.join(gone, F.col("doc_id") == F.col(f"{mark}id"), "left_anti")
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    one = kept.where("doc_id is not null").withColumn(f"{mark}turn", turn).where(F.col(f"{mark}turn") == 1).drop(f"{mark}turn")
    return one.union(kept.where("doc_id is null"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(WORD_MODEL), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_pii),
    ("packing", pack),
]
#: SQL can't express the trained classifier, the similarity join or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
