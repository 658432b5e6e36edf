"""A pipeline over ``documents``: toxic texts go, then repeated lines, near copies and secrets, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``. Results are written as Parquet and read again between stages.

Defined results, in every stage: a null text stays null and counts as empty, and its row stays unless it repeats another stage's
reason to go (an empty text is toxic by the model's bias only, has no lines to lose and no near copies); texts of any length are
read whole; rows of one id are one document, which stays or goes as a whole in near_dedup, and whose rows fare alike elsewhere;
null ids count as one document below all others; an empty table goes through all stages; other columns, whatever their names, are
kept up to the last stage, which returns its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollview.llm.common import ensure_checkpoint_dir, table
from rollview.llm.line_dedup import drop_lines
from rollview.llm.near_dedup import drop_near_copies
from rollview.llm.packing import Capacities, pack_documents
from rollview.llm.secrets import fit_field, redact
from rollview.llm.toxicity import drop_toxic, fit

#: SQL expresses neither the learnt stages nor the packing.
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars``, where there is one, set to what the texts have now."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that five documents share stay in one of them."""
    return _sized(drop_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return drop_near_copies(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; all documents stay."""
    return _sized(redact(docs, fit_field(docs)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens."""
    return pack_documents(docs, Capacities(2048)).drop("ids")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scans", secret_scans), ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what stages hand on lies in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    home = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs, folder = stage(spark, docs, sf_dir), f"{home}/{k}-{name}"
        if k + 1 < len(STAGES):
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
            if before:  # nothing reads it any more
                _remove(spark, before)
            before = folder
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
