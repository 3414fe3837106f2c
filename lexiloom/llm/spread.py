"""Skew-safe joins and prefix sums made of DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A group is heavy from this many rows on, or from a thousandth of all rows if that is more.
HEAVY_ROWS = 5_000
HEAVY_SHARE = 1_000
#: Ids of a block differ in their last BLOCK_BITS bits: 4 KB as a bitmap. So many blocks, 64 MB, are broadcast at most.
BLOCK_BITS = 15
MOST_BLOCKS = 1 << 14


def heavy_threshold(total: int) -> int:
    """Groups of at least this many of ``total`` rows number at most HEAVY_SHARE."""
    return max(HEAVY_ROWS, -(-total // HEAVY_SHARE))


def left_join_grouped(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``groups``, which has one row a key and in ``count`` how many rows have it.

    Heavy keys are joined by a broadcast of at most HEAVY_SHARE groups, as no
    more groups can have that many of ``total`` rows; all others by a shuffle in
    which no key is heavy. ``rows`` should be cheap to read twice. ``count`` is
    not in the result. Null keys match nothing.
    """
    limit = heavy_threshold(total)
    extra = [c for c in groups.columns if c not in keys and c != count]
    heavy = groups.filter(F.col(count) >= limit).drop(count).withColumn("_heavy", F.lit(True))
    light = groups.filter(F.col(count) < limit).drop(count)
    first = rows.join(F.broadcast(heavy), keys, "left")
    done = first.filter(F.col("_heavy")).drop("_heavy")
    rest = first.filter(F.col("_heavy").isNull()).drop("_heavy", *extra).join(light, keys, "left")
    return done.unionByName(rest.select(*done.columns))


def having_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Those of ``rows`` whose integer ``key`` is among ``ids`` (a table with that column).

    The ids are broadcast as bitmaps, one bit an id where ids are dense, so that wide
    rows stay where they are; ids in more than MOST_BLOCKS blocks are joined by a
    shuffle. ``ids`` should be cheap to read twice; the blocks are counted approximately. Null is not among ids.
    """
    ids = ids.select(F.shiftright(key, BLOCK_BITS).alias("_block"), F.col(key).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long")).alias("_at"), key)
    if ids.agg(F.approx_count_distinct("_block")).first()[0] > MOST_BLOCKS:
        return rows.join(ids.select(key), key, "left_semi")
    maps = ids.filter("_block IS NOT NULL").groupBy("_block").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    found = rows.withColumn("_block", F.shiftright(key, BLOCK_BITS)).join(F.broadcast(maps), "_block")
    at = F.col(key).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long")).cast("int")
    byte = F.conv(F.hex(F.substr("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return found.filter(F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1).select(*rows.columns)


def bucket_offsets(sums: DataFrame, group: list[str], bucket: str, value: str, out: str, fan: int = 1024) -> DataFrame:
    """Adds the sum of ``value`` over the earlier buckets of the group, in two levels of windows.

    ``sums`` has one row a (group, bucket). A window task sees ``fan`` buckets
    of a group, or one row for each ``fan`` of them.
    """
    wide = sums.withColumn("_super", F.floor(F.col(bucket) / fan).cast("long"))
    before = lambda part, by: Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    part = group or [F.lit(0)]
    tops = wide.groupBy(*group, "_super").agg(F.sum(value).alias("_sum"))
    tops = tops.withColumn("_top", F.coalesce(F.sum("_sum").over(before(part, "_super")), F.lit(0).cast("long"))).drop("_sum")
    wide = wide.withColumn("_low", F.coalesce(F.sum(value).over(before([*group, "_super"], bucket)), F.lit(0).cast("long")))
    return wide.join(tops, [*group, "_super"]).withColumn(out, F.col("_top") + F.col("_low")).drop("_super", "_top", "_low")


def heavy_groups(rows: DataFrame, keys: list[str], total: int, least: int | None = None) -> DataFrame:
    """The keys that at least ``least`` of ``rows`` have (by default a thousandth of ``total``), with their _count."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_count"))
    return counts.filter(F.col("_count") >= (heavy_threshold(total) if least is None else least))


def numbered(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """``rows`` with their number, from 0 without gaps, among those of one key, however many these are.

    ``rows`` must have been written, with _row = monotonically_increasing_id(): its
    high bits tell the task that wrote a row, so that a window sees the rows of one
    key in one such task, and another one row a task. Keys must not be null.
    """
    rows = rows.withColumn("_task", F.shiftright("_row", 33))
    starts = bucket_offsets(rows.groupBy(*keys, "_task").agg(F.count(F.lit(1)).alias("_n")), keys, "_task", "_n", "_before").drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_task").orderBy("_row")) - 1
    return rows.withColumn(out, inside).join(starts, [*keys, "_task"]).withColumn(out, (F.col("_before") + F.col(out)).cast("long")).drop("_task", "_before")


def words_of(text: Column) -> Column:
    """How many runs of bytes other than space, tab, LF, VT, FF and CR; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
