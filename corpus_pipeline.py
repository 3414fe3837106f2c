"""A corpus, from raw documents to shards: five stages, each on what the one before kept.

Every stage is written as Parquet and read again, so that none depends on the
lineage of another. Each row is judged by itself, whatever its doc_id: verdicts of
the classifier and of decontamination are filters on the row that was read, and the
near-duplicate stage numbers its rows by the files they are read from, so that no
text is copied or moved for the choice of what stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import decontam, minhash, mixing, quality, sharding
from lexiloom.llm.scratch import Scratch
from lexiloom.llm.spread import having_ids

#: Per cent; op2 alone has 85.
SIMILAR = 80
#: The classifier's scores, the groups and the mix have no SQL form.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier of ``labels.quality`` accepts."""
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(spark, docs, model, whole=True).filter(F.col("score") >= quality.ACCEPT).select(*docs.columns)


def _numbered(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """``docs`` with _row, a number that every reading gives the same row: the file's and the place in it.

    What is not a table of Parquet files as they are is written first.
    """
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or "parquet" not in plan.relation().toString().lower() or "_metadata" in docs.columns:
        docs = scratch.write(docs, "rows")
    files = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())  # a row a file
    numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), "_file long, _path string")
    rows = docs.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at")).join(F.broadcast(numbers), "_path")
    return rows.withColumn("_row", F.shiftleft("_file", 33) + F.col("_at")).drop("_path", "_file", "_at")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group at a similarity of 0.8 the row of the smallest doc_id, null last; of rows alike, one."""
    scratch = Scratch(spark, "groups")
    groups = Scratch(spark, "minhash")
    rows = _numbered(scratch, docs)
    found = minhash.near_duplicates(spark, rows.select(F.col("_row").alias("doc_id"), "text"), similar=SIMILAR, scratch=groups)
    ids = rows.select("_row", "doc_id")
    group = found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")).join(ids, "_row")
    first = group.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("f")).select("f._row")
    first = scratch.write(first, "first")
    groups.keep_only()
    return having_ids(rows, first, "_row").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontam.contamination(spark, docs, _table(spark, sf_dir, "benchmark"), whole=True).filter("n_hit = 0").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at the production weights: documents as often as it takes them."""
    return mixing.mix(spark, docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, text_crc32, shard and slot."""
    return sharding.shard(spark, docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the rows of the last."""
    scratch = Scratch(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
