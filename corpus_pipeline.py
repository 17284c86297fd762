"""The corpus pipeline: a document table through five stages, each written and read again.

Quality, near-dedup, substring dedup and mixing return the columns of documents; packing returns pieces.
A stage's decisions take effect: rejected documents, near copies but one and repeated passages go, and
the mix repeats a document as rows. Null texts and ids are treated as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.op1_minhash import one_of_each
from tessera.llm.op3_mixing import mix
from tessera.llm.op4_substring import remove_known
from tessera.llm.op5_packing import packed
from tessera.llm.op7_quality import fit, scored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (operator 7)."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs.select(*COLUMNS), model, *COLUMNS).where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (operator 1)."""
    return one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has (operator 4); those with nothing left go.

    A text that loses no word stays as it is; else its words are joined by single spaces.
    """
    clean = remove_known(docs.select(*COLUMNS), others=("lang", "source", "text"), with_kept=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    clean = clean.where("n_removed = 0 or n_removed < n_words").select("doc_id", text.alias("text"), "lang", "source")
    return clean.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them (operator 3)."""
    taken = mix(docs.select(*COLUMNS), whole=True).where("_passes > 0")
    return taken.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_passes")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens (operator 5)."""
    return packed(docs, with_ids=False).drop("ids")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("source_mix", source_mix), ("packing", packing)]

#: Training, signatures, the flow and tokenizing are no SQL. A test holds the score, near-dedup, substring dedup, the
#: mix's totals and the packed ids against plain versions on the rows of the stage before.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", free=True)
    return STAGES[-1][1](spark, docs, sf_dir)
