"""Running totals over ordered blocks without a task that sees every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def totals_before(blocks: DataFrame, by: list[str], block: str, value: str, out: str, fan: int = 1024) -> DataFrame:
    """``blocks`` (one row a group and block) with the sum of ``value`` over the group's earlier blocks.

    Blocks are summed by runs of ``fan`` block numbers first, so that a window
    sees either the blocks of a run or the runs of a group.
    """
    wide = blocks.withColumn("_run", F.floor(F.col(block) / fan).cast("long"))
    runs = wide.groupBy(*by, "_run").agg(F.sum(value).alias("_v"))
    back = lambda part, key: Window.partitionBy(*part).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_far", F.coalesce(F.sum("_v").over(back(by, "_run")), F.lit(0).cast("long"))).drop("_v")
    near = F.coalesce(F.sum(value).over(back([*by, "_run"], block)), F.lit(0).cast("long"))
    return wide.withColumn("_near", near).join(runs, [*by, "_run"]).withColumn(out, F.col("_far") + F.col("_near")).drop("_run", "_far", "_near")
