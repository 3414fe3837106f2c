"""Repeated passages of lines, by overlapping windows of three lines.

Every three consecutive lines of a document are a window, known by the MD5 of its
text. A window that occurs more than once in the corpus stays where it comes
first, in order of (doc_id, line); wherever it comes later, the lines it covers
go. Covered lines of windows that overlap are merged, so that a long repeated
passage goes as a whole. Windows without any character but white space are
passed over, and so are documents of fewer lines than a window.

Only hashes and positions are shuffled to find the repeats; how often a window
occurs comes from partial counts, and windows that very many documents share are
joined by a broadcast of bounded size.

Edge cases. Null text has no lines and stays null. Null doc_id: kept whole, and
no other row loses lines to it. Rows alike in doc_id and text are one document:
all keep their lines. Empty table: empty result. Columns other than doc_id and
text are kept as they are by :func:`dedup_lines`; names starting with ``_`` are
taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.scratch import Scratch
from lexiloom.llm.spread import left_join_grouped

LINES = 3


def dedup_lines(spark: SparkSession, docs: DataFrame, lines: int = LINES) -> DataFrame:
    """``docs`` with n_lines, removed (line numbers from 0, in order) and kept_text."""
    scratch = Scratch(spark, "lines")
    keyed = docs.withColumn("_text", F.xxhash64("text")).withColumn("_lines", F.split("text", "\n", -1))
    window = F.transform(F.sequence(F.lit(0), F.size("_lines") - lines), lambda i: F.concat_ws("\n", F.slice("_lines", i + 1, lines)))
    windows = keyed.filter((F.size("_lines") >= lines) & F.col("doc_id").isNotNull()).select("doc_id", "_text", F.posexplode(window).alias("pos", "w"))
    windows = windows.filter(F.col("w").rlike(r"\S")).select("doc_id", "_text", "pos", F.unhex(F.md5("w")).alias("w"))
    windows = scratch.write(windows, "windows")
    at = F.struct("doc_id", "_text", "pos")
    many = windows.groupBy("w").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    many = scratch.write(many, "repeated")
    later = left_join_grouped(windows, many, ["w"], "n", windows.count()).filter(F.col("first").isNotNull() & (at != F.col("first")))
    # A document's own lines bound what is gathered for it.
    gone = later.groupBy("doc_id", "_text").agg(F.collect_set("pos").alias("_pos"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("_pos", lambda p: F.sequence(p, p + lines - 1)))))
    out = keyed.join(gone.withColumn("_gone", covered).drop("_pos"), ["doc_id", "_text"], "left")
    removed = F.coalesce("_gone", F.array().cast("array<int>"))
    n = F.coalesce(F.when(F.col("text").isNotNull(), F.size("_lines")), F.lit(0)).cast("long")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.col("_lines")[i]), "\n"))
    return out.select(*docs.columns, n.alias("n_lines"), removed.alias("removed"), kept.alias("kept_text"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: doc_id, n_lines, n_removed and the SHA-256 of the text that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(spark, docs)
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
win AS (SELECT doc_id, p, array_to_string(l[p : p + 2], chr(10)) AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM d WHERE len(l) >= 3)),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS nth FROM win WHERE regexp_matches(w, '\S')),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 3)) AS q FROM ranked WHERE nth > 1),
flat AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS q FROM d),
kept AS (SELECT f.doc_id, count(*)::BIGINT AS n_lines, count(g.q)::BIGINT AS n_removed, string_agg(CASE WHEN g.q IS NULL THEN line END, chr(10) ORDER BY f.q) AS t
         FROM flat f LEFT JOIN gone g USING (doc_id, q) GROUP BY f.doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""
