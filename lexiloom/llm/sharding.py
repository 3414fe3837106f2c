"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

Each shard owns ``virtual`` points of a ring of 2^63 positions; a row's position
is a hash of its doc_id and text checksum, and the next point clockwise is its
first choice. A shard takes as many rows as its load allows; rows that find it
full go on clockwise, point by point, until one has room. Loads add up to the
number of rows and differ by one at most, so the counts of the shards do too.

Only the number of rows at each point (``shards * virtual`` integers) reaches the
driver, which lets these counts flow clockwise and sends back runs of ranks:
"rows lo to hi of point a belong to shard s". There are at most
``shards * virtual + shards`` runs, because each either ends what waits at a
point or fills a shard. Ranks at a point come from counts over ranges of the ring
and a window inside each range, which has a known expected size.

Edge cases. Null text: size 8, checksum 0. Null doc_id: hashed with the checksum
alone. Rows alike in doc_id and text share what they get in any order, and a thousandth of
all rows or more that are alike are numbered and placed by that number too; copies
of a text have positions of their own, so that a hot group spreads.
Fewer rows than shards: some shards stay empty. Empty table: empty result. All
columns are kept by :func:`shard`; their names may be any but those starting
with ``_`` and those of the columns it adds (size, text_crc32, shard, slot), which
raise. A doc_id may be of any type that can be hashed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.scratch import Scratch
from lexiloom.llm.spread import bucket_offsets, heavy_groups, numbered

SHARDS = 24
VIRTUAL = 128
#: Bits of a position, and of a cell, by which points are looked up.
BITS, CELL_BITS = 63, 14
#: Expected rows of a range of the ring inside which a window sorts.
RANGE_ROWS = 4096


def ring(spark: SparkSession, shards: int, virtual: int) -> DataFrame:
    """_arc (rank of the point clockwise), _owner and _point, for all points."""
    point = F.shiftrightunsigned(F.xxhash64(F.lit("point"), F.floor(F.col("id") / virtual), F.col("id") % virtual), 1)
    points = spark.range(shards * virtual).select(F.floor(F.col("id") / virtual).cast("int").alias("_owner"), point.alias("_point"))
    return points.withColumn("_arc", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_point", "_owner")) - 1).cast("int"))


def cells(spark: SparkSession, points: DataFrame) -> DataFrame:
    """For each of the 2^CELL_BITS cells of the ring: _base, how many points lie before it, and _points inside it."""
    inside = points.groupBy(F.shiftright("_point", BITS - CELL_BITS).alias("_cell")).agg(F.sort_array(F.collect_list("_point")).alias("_points"))
    every = spark.range(1 << CELL_BITS).withColumnRenamed("id", "_cell").join(inside, "_cell", "left")
    every = every.withColumn("_points", F.coalesce("_points", F.array().cast("array<bigint>"))).withColumn("_n", F.size("_points").cast("long"))
    return bucket_offsets(every, [], "_cell", "_n", "_base", 128).drop("_n")


def flow(at: dict[int, int], owners: list[int], loads: list[int]) -> list[dict]:
    """Runs of ranks, for counts ``at`` the points of ``owners`` in ring order and ``loads`` that sum up to them."""
    room, runs, filled = list(loads), [], [0] * len(loads)
    waiting = [(a, 0, n, a) for a, n in sorted(at.items()) if n]
    while waiting:
        left = []
        for arc, lo, hi, here in waiting:
            s = owners[here]
            if take := min(hi - lo, room[s]):
                runs.append({"arc": arc, "lo": lo, "hi": lo + take, "shard": s, "first": filled[s]})
                room[s] -= take
                filled[s] += take
            if lo + take < hi:
                left.append((arc, lo + take, hi, (here + 1) % len(owners)))
        waiting = left
    return runs


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL) -> DataFrame:
    """``docs`` with size, text_crc32, shard and slot (0, 1, 2 ... in each shard)."""
    if taken := {"size", "text_crc32", "shard", "slot"} & set(docs.columns):
        raise ValueError(f"columns in the way: {sorted(taken)}")
    scratch = Scratch(spark, "shard")
    points = scratch.write(ring(spark, shards, virtual), "ring")
    lookup = F.broadcast(scratch.write(cells(spark, points), "cells"))  # 2^CELL_BITS rows, whatever the input
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size")
    whole = docs.select("*", size, crc).withColumn("_none", F.col("doc_id").isNull()).withColumn("_id", F.xxhash64("doc_id"))
    total = docs.count()
    alike = ["_none", "_id", "text_crc32"]
    hot = scratch.write(heavy_groups(whole, alike, total).drop("_count"), "alike")
    same = F.xxhash64(F.lit("row"), F.col("doc_id"), F.col("text_crc32"))
    placed = whole.withColumn("_nth", F.lit(0).cast("long"))
    if not hot.isEmpty():
        # HEAVY_SHARE groups at most; only their rows are written, so that their numbers hold.
        some = whole.join(F.broadcast(hot), alike, "left_semi").withColumn("_row", F.monotonically_increasing_id())
        some = numbered(scratch.write(some, "hot"), alike, "_nth").drop("_row")
        placed = placed.join(F.broadcast(hot), alike, "left_anti").unionByName(some)
    place = F.shiftrightunsigned(F.when(F.col("_nth") > 0, F.xxhash64(same, "_nth")).otherwise(same), 1)
    placed = placed.withColumn("_place", place).drop("_nth", "_none", "_id")
    placed = placed.withColumn("_cell", F.shiftright("_place", BITS - CELL_BITS)).join(lookup, "_cell")
    arc = (F.col("_base") + F.size(F.filter("_points", lambda p: p < F.col("_place")))) % F.lit(shards * virtual)
    placed = placed.withColumn("_arc", arc.cast("int")).drop("_cell", "_base", "_points")

    bits = min(max(0, (total // RANGE_ROWS).bit_length()), 32)
    placed = placed.withColumn("_range", F.shiftright("_place", BITS - bits))
    sums = scratch.write(placed.groupBy("_arc", "_range").agg(F.count(F.lit(1)).alias("_n")), "counts")
    at = {r["_arc"]: int(r["n"]) for r in sums.groupBy("_arc").agg(F.sum("_n").alias("n")).collect()}  # a row a point
    owners = [r["_owner"] for r in points.orderBy("_arc").select("_owner").collect()]
    runs = flow(at, owners, [total // shards + (s < total % shards) for s in range(shards)])
    plan = F.from_json(F.lit(json.dumps(runs)), "array<struct<arc:int,lo:bigint,hi:bigint,shard:int,first:bigint>>")
    plan = spark.range(1).select(F.inline(plan)).toDF("_arc", "_lo", "_hi", "_shard", "_first")

    # The arc over the ring's end holds positions of both ends; the high ones come after the low ones, as ranks only need one order.
    offsets = bucket_offsets(sums, ["_arc"], "_range", "_n", "_off").drop("_n")
    inner = Window.partitionBy("_arc", "_range").orderBy("_place", "text_crc32", "size")
    ranked = placed.join(offsets, ["_arc", "_range"]).withColumn("_rank", F.col("_off") + F.row_number().over(inner) - 1)
    out = ranked.join(F.broadcast(plan), "_arc").filter("_rank >= _lo AND _rank < _hi")
    return out.select(*docs.columns, "size", "text_crc32", F.col("_shard").alias("shard"), (F.col("_first") + F.col("_rank") - F.col("_lo")).alias("slot"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of ``documents`` in 24 shards whose counts are at most one apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shard(spark, docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
