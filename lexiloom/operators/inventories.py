"""What generators learn from a corpus, as plans over its distinct words: places of glyphs, slots, digraphs, line edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import glyphs
from lexiloom.operators.stats import CORPUS


def glyph_places(kinds: DataFrame, by: list[str] = CORPUS) -> DataFrame:
    """How often a glyph begins a word, stands inside and ends it; a single glyph begins and ends."""
    g = kinds.select(*by, "n", F.size(glyphs(F.col("word"))).alias("k"), F.posexplode(glyphs(F.col("word"))).alias("i", "glyph"))
    first, last = F.col("i") == 0, F.col("i") == F.col("k") - 1
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    return g.groupBy(*by, "glyph").agg(count(first).alias("initial"), count(~first & ~last).alias("medial"), count(last).alias("final"))


def word_slots(kinds: DataFrame, by: list[str] = CORPUS) -> DataFrame:
    """slot (prefix, core, suffix), part and n: two glyphs, the middle, two glyphs; words under four glyphs are cores."""
    g = kinds.select(*by, "n", glyphs(F.col("word")).alias("g"))
    joined = lambda a: F.array_join(a, "")
    whole = F.array(F.struct(F.lit("core").alias("slot"), joined(F.col("g")).alias("part")))
    parts = F.array(
        F.struct(F.lit("prefix").alias("slot"), joined(F.slice("g", 1, 2)).alias("part")),
        F.struct(F.lit("core").alias("slot"), joined(F.slice("g", F.lit(3), F.greatest(F.size("g") - 4, F.lit(0)))).alias("part")),
        F.struct(F.lit("suffix").alias("slot"), joined(F.slice("g", -2, 2)).alias("part")),
    )
    rows = g.select(*by, "n", F.explode(F.when(F.size("g") < 4, whole).otherwise(parts)).alias("s")).select(*by, "s.slot", "s.part", "n")
    return rows.filter("part <> ''").groupBy(*by, "slot", "part").agg(F.sum("n").alias("n"))


def top_slots(slots: DataFrame, k: int, by: list[str] = CORPUS) -> DataFrame:
    """The ``k`` most frequent parts of each slot; ties by part."""
    nth = F.row_number().over(Window.partitionBy(*by, "slot").orderBy(F.desc("n"), "part"))
    return slots.withColumn("rank", nth).filter(F.col("rank") <= k)


def digraphs(kinds: DataFrame, k: int, by: list[str] = CORPUS) -> DataFrame:
    """The ``k`` most frequent pairs of glyphs inside words; ties by pair."""
    g = kinds.select(*by, "n", glyphs(F.col("word")).alias("g")).filter(F.size("g") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("g") - 1), lambda i: F.concat(F.element_at("g", i), F.element_at("g", i + 1)))
    counts = g.select(*by, "n", F.explode(pairs).alias("pair")).groupBy(*by, "pair").agg(F.sum("n").alias("n"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "pair"))
    return counts.withColumn("rank", nth).filter(F.col("rank") <= k)


def edge_slots(lines: DataFrame, by: list[str] = CORPUS) -> DataFrame:
    """edge (start, end), part and n: first two glyphs of line-first words, last two of line-last ones; short words count as empty."""
    full = lines.filter(F.size("words") > 0)
    first, last = glyphs(F.element_at("words", 1)), glyphs(F.element_at("words", -1))
    part = lambda g, at: F.when(F.size(g) >= 4, F.array_join(F.slice(g, at, 2), "")).otherwise("")
    both = F.array(F.struct(F.lit("start").alias("edge"), part(first, 1).alias("part")), F.struct(F.lit("end").alias("edge"), part(last, -2).alias("part")))
    return full.select(*by, F.explode(both).alias("e")).select(*by, "e.edge", "e.part").groupBy(*by, "edge", "part").agg(F.count(F.lit(1)).alias("n"))
