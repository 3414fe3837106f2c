"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every document of a source, in a shuffled order, gets the virtual finish time
(words of the source up to its end) / (target of the source); each further copy
continues the count. The queue of all sources in order of finish time, cut where
the total budget is used up, is the mix: at time 1 each source has had its
target.

The queue is never sorted in one task. The order within a source comes from a
hash, so that ranges of the hash are buckets of known expected size; running
sums need the sum of each bucket and a window inside it. Ranges of the finish
time serve for the global order in the same way.

Edge cases. Null or empty text: size 0, never queued, nothing taken. Null source:
a source of its own, last in order. Null doc_id: its hash is that of an empty
string. Repeated rows: each counts; rows alike in doc_id, source and size are
numbered as soon as LIKE_ROWS of them are, and the number goes into the hash, so
that they spread over all buckets; which of them has which number does not matter.
Other ties are broken by doc_id and size, beyond which rows are alike. A doc_id may
be of any type that has a text. Empty table: empty result. Other columns are kept
as they are by :func:`mix`; their names may be any but those starting with ``_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.scratch import Scratch
from lexiloom.llm.spread import bucket_offsets, heavy_groups, heavy_threshold, left_join_grouped, numbered, words_of

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST_COPIES = 2
#: Expected rows of a bucket inside which a window sorts.
BUCKET_ROWS = 4096
#: So many rows alike in doc_id, source and size are spread by a number of their own.
LIKE_ROWS = 256


def source_targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST_COPIES) -> DataFrame:
    """Adds ``target`` to a table of ``_null``, ``_src``, ``source_size``, a row a source.

    Sources in order of code points, null last, have ``weights`` in turn. By
    ascending ratio of cap to weight, a source is full as long as the level
    (what is left of the budget) / (weight that is left) reaches its ratio; the
    first level that does not is that of all further sources.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy("_null", "_src")
    by_ratio = every.orderBy("_ratio", "_null", "_src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sources.withColumn("_w", weight.cast("double")).withColumn("_cap", (F.col("source_size") * most).cast("double"))
    t = t.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    left = F.sum("source_size").over(every) * F.lit(float(budget)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    rest = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    t = t.withColumn("_level", left / rest).withColumn("_full", F.col("_ratio") <= F.col("_level"))
    t = t.withColumn("_at", F.max(F.when(~F.col("_full"), F.col("_level"))).over(every))
    return t.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_at") * F.col("_w"))).drop("_w", "_cap", "_ratio", "_level", "_full", "_at")


def _shuffled(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _told_apart(scratch: Scratch, sized: DataFrame) -> DataFrame:
    """``sized`` with other hashes for rows that LIKE_ROWS and more share all keys of the order with."""
    key = ["_null", "_src", "_h", "size"]
    like = scratch.write(heavy_groups(sized.filter("size > 0"), key, 0, LIKE_ROWS).drop("_count"), "like")
    if like.isEmpty():
        return sized
    some = scratch.write(numbered(sized.join(like, key, "left_semi"), key, "_nth"), "alike")
    other = F.md5(F.concat_ws(":", "_h", F.col("_nth").cast("string")).cast("binary"))
    rest = sized.join(like, key, "left_anti")
    return scratch.write(rest.unionByName(some.withColumn("_h", F.when(F.col("_nth") > 0, other).otherwise(F.col("_h"))).drop("_nth")), "apart")


def schedule(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST_COPIES, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """``(sized, queue)``: every row with its size and its source's target, and the queue with its cut.

    ``queue`` has a row for each copy of each document with words: ``finish``,
    ``ends`` (words of the queue up to its end) and ``chosen`` (it is before the
    cut), beside the columns of ``sized``.
    """
    scratch = Scratch(spark, "mix")
    sized = docs.select(
        "doc_id", "source", words_of(F.col("text")).alias("size"),
        F.col("source").isNull().alias("_null"), F.coalesce(F.col("source"), F.lit("")).alias("_src"), _shuffled(seed).alias("_h"),
        F.monotonically_increasing_id().alias("_row"),
    )
    sized = scratch.write(sized, "sized")
    sources = sized.groupBy("_null", "_src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sources = scratch.write(source_targets(sources, weights, budget, most), "sources")
    bound = sources.agg(F.sum("source_size").alias("words"), F.sum("_rows").alias("rows")).first()
    total, rows = int(bound["words"] or 0), int(bound["rows"] or 0)
    sized = _told_apart(scratch, sized)

    sources = sources.withColumn("_parts", F.ceil(F.col("_rows") / BUCKET_ROWS).cast("long"))
    sized = left_join_grouped(sized, sources, ["_null", "_src"], "_rows", rows)
    head = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long")
    sized = scratch.write(sized.withColumn("_b", F.floor(head * F.col("_parts") / F.lit(2**32)).cast("long")).drop("_parts"), "targets")

    live = sized.filter("size > 0")
    key = ["_null", "_src", "_b"]
    sums = live.groupBy(*key).agg(F.sum("size").alias("_sum"))
    sums = bucket_offsets(sums, key[:2], "_b", "_sum", "_off").drop("_sum")
    upto = Window.partitionBy(*key).orderBy("_h", "doc_id", "size", "_row").rowsBetween(Window.unboundedPreceding, 0)
    live = live.join(sums, key).withColumn("_cum", F.col("_off") + F.sum("size").over(upto)).drop("_off", "_b")
    live = live.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(most))))
    live = live.withColumn("finish", (F.col("_cum") + (F.col("copy") - 1) * F.col("source_size")).cast("double") / F.col("target"))
    parts = -(-rows * most // BUCKET_ROWS) or 1
    live = scratch.write(live.withColumn("_t", F.floor(F.col("finish") / (F.col("finish") + 1) * parts).cast("long")), "live")

    times = bucket_offsets(live.groupBy("_t").agg(F.sum("size").alias("_sum")), [], "_t", "_sum", "_off").drop("_sum")
    order = Window.partitionBy("_t").orderBy("finish", "_null", "_src", "_h", "doc_id", "size", "copy", "_row").rowsBetween(Window.unboundedPreceding, 0)
    queue = live.join(times, "_t").withColumn("ends", F.col("_off") + F.sum("size").over(order)).drop("_off", "_t", "_cum")
    return sized.drop("_b"), queue.withColumn("chosen", F.col("ends") <= F.lit(total * budget))


def taken(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target and copies, the copies that the mix takes, for each row of ``docs``."""
    sized, queue = schedule(spark, docs, **how)
    copies = queue.filter("chosen").groupBy("_row").agg(F.count(F.lit(1)).alias("copies"))
    out = sized.join(copies, "_row", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("copies", F.lit(0)).cast("long").alias("copies"))


def mix(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, with the columns of ``docs``.

    Rows alike in doc_id, source and size share what was taken of them in any order.
    """
    same = ["_none", "_doc", "_null", "_src", "_size"]
    scratch = Scratch(spark, "mixed")

    def keyed(rows: DataFrame, size: Column) -> DataFrame:
        return rows.withColumns({
            "_none": F.col("doc_id").isNull(), "_doc": F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
            "_null": F.col("source").isNull(), "_src": F.coalesce(F.col("source"), F.lit("")), "_size": size,
        })

    # Rows and copies of a key; the join leaves rows where the window wants them, so that texts move once.
    whole = keyed(taken(spark, docs, **how), F.col("size")).groupBy(*same).agg(F.count(F.lit(1)).alias("_rows"), F.sum("copies").alias("_all")).filter("_all > 0")
    whole = scratch.write(whole, "keys")
    limit = heavy_threshold(int(whole.agg(F.sum("_rows")).first()[0] or 0))
    hot, rows = whole.filter(F.col("_rows") >= limit), keyed(docs, words_of(F.col("text")))
    few = rows.join(whole.filter(F.col("_rows") < limit), same)
    few = few.withColumn("_nth", F.row_number().over(Window.partitionBy(*same).orderBy("_size")) - 1)
    if not hot.isEmpty():
        # Keys with a thousandth of all rows, HEAVY_SHARE at most: their rows are written and numbered task by task.
        many = rows.join(F.broadcast(hot), same).withColumn("_row", F.monotonically_increasing_id())
        few = few.unionByName(numbered(scratch.write(many, "hot"), same, "_nth").drop("_row"))
    copies = F.floor(F.col("_all") / F.col("_rows")) + (F.col("_nth") < F.col("_all") % F.col("_rows")).cast("long")
    picked = few.withColumn("_copies", copies).filter("_copies > 0")
    return picked.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of ``documents`` mixed at the production weights: doc_id, size, source_size, target, taken, copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = taken(spark, docs)
    return t.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


#: The same mix by plain windows over all rows.
OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS n, coalesce(source, '') AS s,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('3:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
src AS (SELECT n, s, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY n, s) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
      (source_size * 2)::DOUBLE AS cap FROM src),
lv AS (SELECT *, cap / w AS ratio,
      (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, n, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, n, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
tg AS (SELECT *, CASE WHEN ratio <= level THEN cap ELSE max(CASE WHEN ratio > level THEN level END) OVER () * w END AS target FROM lv),
cum AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY n, s ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS c
        FROM sized d JOIN tg USING (n, s) WHERE size > 0),
q AS (SELECT *, (c + k * source_size)::DOUBLE / target AS f FROM cum, (VALUES (0), (1)) v(k)),
e AS (SELECT *, sum(size) OVER (ORDER BY f, n, s, h, doc_id, size, k ROWS UNBOUNDED PRECEDING) AS ends FROM q),
t AS (SELECT doc_id, count(*) AS copies FROM e WHERE ends <= (SELECT sum(size) * 1.5::DOUBLE FROM sized) GROUP BY doc_id)
SELECT d.doc_id, d.size, tg.source_size, tg.target, (d.size * coalesce(t.copies, 0))::BIGINT AS taken, coalesce(t.copies, 0)::BIGINT AS copies
FROM sized d JOIN tg USING (n, s) LEFT JOIN t USING (doc_id)
"""
