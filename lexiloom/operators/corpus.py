"""Access to the relations pages, loci and tokens: corpora, counts and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Relations = dict[str, DataFrame]
_RANGES = ("label", "value", "low", "high")


def working(relations: Relations, held: DataFrame) -> Relations:
    """The relations without the pages of ``held`` (page_id) and what is on them."""
    held = held.select(F.col("page_id").alias("id")).distinct()
    pages = relations["pages"].join(held, "id", "left_anti")
    loci = relations["loci"].join(held.withColumnRenamed("id", "page_id"), "page_id", "left_anti")
    return {"pages": pages, "loci": loci, "tokens": relations["tokens"].join(loci.select(F.col("id").alias("locus_id")), "locus_id", "left_semi")}


def held_out(relations: Relations, held: DataFrame) -> Relations:
    """The relations of the pages of ``held`` alone."""
    ids = held.select(F.col("page_id").alias("id")).distinct()
    pages = relations["pages"].join(ids, "id", "left_semi")
    loci = relations["loci"].join(ids.withColumnRenamed("id", "page_id"), "page_id", "left_semi")
    return {"pages": pages, "loci": loci, "tokens": relations["tokens"].join(loci.select(F.col("id").alias("locus_id")), "locus_id", "left_semi")}


def _readable(relations: Relations, kind: str, language: str | None) -> DataFrame:
    pages = relations["pages"].select(F.col("id").alias("page_id"), "name", "seq", "illustration_type", "currier_language")
    if language is not None:
        pages = pages.filter(F.col("currier_language") == language)
    loci = relations["loci"].filter(F.col("locus_type").startswith(kind)).select(F.col("id").alias("locus_id"), "page_id", "num", "par_start")
    tokens = relations["tokens"].filter(~F.col("has_unreadable")).select("locus_id", "position", "form")
    return tokens.join(loci, "locus_id").join(pages, "page_id")


def paragraph_lines(relations: Relations, language: str | None = None) -> DataFrame:
    """page, seq, section, language, line_no, par_start and words of paragraph lines with a readable token."""
    rows = _readable(relations, "P", language)
    # A line's own tokens bound what is gathered for it.
    lines = rows.groupBy("locus_id", "name", "seq", "num", "par_start", "illustration_type", "currier_language").agg(F.array_sort(F.collect_list(F.struct("position", "form"))).alias("t"))
    return lines.select(F.col("seq").alias("page"), F.col("name").alias("page_name"), F.col("illustration_type").alias("section"), F.col("currier_language").alias("language"), F.col("num").alias("line_no"), "par_start", F.transform("t", lambda x: x["form"]).alias("words"))


def labels(relations: Relations) -> DataFrame:
    """page, section and form of every readable token of a label."""
    return _readable(relations, "L", None).select(F.col("seq").alias("page"), F.col("illustration_type").alias("section"), "form")


def totals(relations: Relations) -> DataFrame:
    """pages, loci, tokens and glyphs, in one row."""
    count = lambda t: relations[t].agg(F.count(F.lit(1)).alias(t))
    tokens = relations["tokens"].agg(F.count(F.lit(1)).alias("tokens"), F.coalesce(F.sum("glyph_count"), F.lit(0)).cast("long").alias("glyphs"))
    return count("pages").crossJoin(count("loci")).crossJoin(tokens)  # one row each


def crosstab(pages: DataFrame, row: str = "illustration_type", column: str = "currier_language", values=("A", "B")) -> DataFrame:
    """Pages by ``row``, one column a value of ``column``, those without one, and all."""
    counts = [F.count_if(F.col(column) == v).alias(v) for v in values]
    return pages.groupBy(row).agg(*counts, F.count_if(F.col(column).isNull()).alias("unset"), F.count(F.lit(1)).alias("total"))


def histogram(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def top_words(words: DataFrame, key: str, n: int = 30, by: list[str] | None = None) -> DataFrame:
    """The ``n`` most frequent values of ``key``, in each group of ``by`` if given; ties by key."""
    counts = words.groupBy(*(by or []), key).agg(F.count(F.lit(1)).alias("n"))
    if not by:
        return counts.orderBy(F.desc("n"), key).limit(n)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), key))
    return counts.withColumn("rank", nth).filter(F.col("rank") <= n)


def presence(tokens: DataFrame, expected: list[str], key: str = "form") -> DataFrame:
    """Which of ``expected`` occur, and how often."""
    found = tokens.filter(F.col(key).isin(*expected)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    wanted = tokens.sparkSession.createDataFrame([(e,) for e in expected], f"{key} string")
    return wanted.join(F.broadcast(found), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("present"))


def distinct_types(tokens: DataFrame, key: str = "form") -> DataFrame:
    return tokens.agg(F.count_distinct(key).alias("types"))


def uncertainty(tokens: DataFrame) -> DataFrame:
    """Tokens with each flag, and all, in one pass."""
    flags = ("has_alternative", "has_ligature", "has_high_ascii", "has_unreadable")
    return tokens.agg(F.count(F.lit(1)).alias("tokens"), *[F.count_if(f).alias(f) for f in flags])


def holdout_summary(held: DataFrame) -> DataFrame:
    """folios, pages, seed and frozen_at of the held-out pages."""
    return held.agg(F.count_distinct("folio").alias("folios"), F.count(F.lit(1)).alias("pages"), F.min("seed").alias("seed"), F.min("frozen_at").alias("frozen_at"))


def verdicts(values: DataFrame) -> DataFrame:
    """``values`` (label, value, low, high) with whether the value lies in the range."""
    return values.select(*_RANGES, F.col("value").between(F.col("low"), F.col("high")).alias("ok"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of two top lists and where they stand: in both, or in one."""
    left, right = a.select(key, F.lit(True).alias("l")), b.select(key, F.lit(True).alias("r"))
    side = F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "first").otherwise("second")
    return left.join(right, key, "full").select(key, side.alias("side"))


def without_folios(pages: DataFrame, folio: Column, frozen: list[str]) -> DataFrame:
    """Pages of another transliteration whose leaf is not among the frozen ones."""
    return pages.filter(~folio.isin(*frozen)) if frozen else pages
