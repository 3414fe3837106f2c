"""Reports: each a dict of small result tables for one corpus or several."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom import policy
from lexiloom.functions.prng import Stream, permutation
from lexiloom.operators import controls, corpus, generators, stats, structure, verify

Tables = dict[str, DataFrame]


def inventory(relations: corpus.Relations, expected: list[str], held: DataFrame | None = None) -> Tables:
    """Counts, sections by language, hands, top tokens, expected tokens and uncertainty of the relations."""
    t = relations["tokens"]
    out = {
        "totals": corpus.totals(relations), "sections": corpus.crosstab(relations["pages"]), "hands": corpus.histogram(relations["pages"], "hand"),
        "top tokens": corpus.top_words(t, "form"), "expected tokens": corpus.presence(t, expected), "types": corpus.distinct_types(t), "uncertainty": corpus.uncertainty(t),
    }
    return out | ({"held out": corpus.holdout_summary(held)} if held is not None else {})


def signature(lines: DataFrame) -> Tables:
    """The battery with its tables of lengths, glyphs, edges and top words; ``lines`` may hold several corpora."""
    kinds = stats.types(lines)
    edges = stats.edge_glyphs(lines)
    return {
        "signature": stats.signature(lines), "lengths": stats.lengths(kinds), "glyphs": stats.top_shares(stats.glyph_counts(kinds, separator=None), "glyph"), "positions": stats.positions(kinds),
        "line ends": stats.top_edges(edges), "line starts": stats.top_edges(edges, edge="line_start", other="other_start"), "profile": stats.line_profile(lines), "top words": corpus.top_words(stats.tokens(lines), "word", 10, ["corpus"]),
    }


def control_report(spark: SparkSession, lines: DataFrame, latin: DataFrame) -> Tables:
    """Five controls in the layout of ``lines``, and how far each lies from it."""
    every = lines.withColumn("corpus", F.lit("reference")).select("corpus", "page", "line_no", "par_start", "words").unionByName(controls.build_controls(spark, lines, latin))
    signatures = stats.signature(every)
    z = verify.z_distances(verify.vector(signatures), "reference")
    return {"signatures": signatures, "distances": z, "ranking": verify.aggregate_distances(z)}


def hypotheses(spark: SparkSession, lines: DataFrame, layout: DataFrame, latin: DataFrame, scale: DataFrame, families: list[str] | None = None, budget: int = policy.SEARCH_COMBOS, replicates: int = policy.SEARCH_REPLICATES) -> Tables:
    """A search of every family against ``lines``; the best of each is run again on the held-out ``layout``."""
    names = families or list(generators.FAMILIES)
    reference = verify.vector(stats.signature(lines)).select("metric", "value")
    found = generators.search(spark, generators.plan(spark, names, budget, replicates), generators.context_of(lines, lines, latin), lines, reference, scale).persist()
    ranks = verify.ranked(found)
    best = ranks.filter("rank = 1").join(found.filter("replicate = 0").select("family", "combo", "params"), ["family", "combo"])
    again = best.select("family", "combo", "params", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    again = again.withColumn("seed", (F.lit(policy.FINAL_EVAL_SEED) + F.col("replicate")).cast("long")).withColumn("corpus", F.concat_ws("|", "family", F.col("replicate").cast("string")))
    target = verify.vector(stats.signature(layout)).select("metric", "value")
    held = generators.search(spark, again, generators.context_of(layout, lines, latin), layout, target, scale)
    lead = generators.generated(spark, found.join(ranks.filter("rank = 1").select("family", "combo"), ["family", "combo"]), generators.context_of(lines, lines, latin), lines)
    gaps = verify.vector(stats.signature(lead)).join(reference.withColumnRenamed("value", "real"), "metric").join(scale.filter("scale > 0"), "metric")
    gaps = gaps.groupBy(F.element_at(F.split("corpus", r"\|"), 1).alias("family"), "metric").agg((F.abs(F.avg("value") - F.first("real")) / F.first("scale")).alias("deviation"))
    return {"ranking": ranks.filter(F.col("rank") <= policy.SEARCH_TOP), "held out": verify.ranked(held), "frontier": verify.frontier(gaps), "results": found}


def language_search(spark: SparkSession, lines: DataFrame, latin: DataFrame, scale: DataFrame, languages=("A", "B"), **how) -> Tables:
    """Families fitted to each language and to both together, and what fitting to the language gains."""
    mixed = hypotheses(spark, lines, lines, latin, scale, **how)["ranking"].filter("rank = 1").select("family", "distance")
    own = gains = None
    for language in languages:
        part = lines.filter(F.col("language") == language)
        best = hypotheses(spark, part, part, latin, scale, **how)["ranking"].filter("rank = 1").select("family", "distance", F.lit(language).alias("target"))
        own = best if own is None else own.unionByName(best)
        both = mixed.withColumn("target", F.lit(language))
        gains = both if gains is None else gains.unionByName(both)
    return {"own": own, "gain": verify.cross_gain(own, gains)}


def structure_report(lines: DataFrame, labels: DataFrame | None = None, shuffles: int = policy.LABEL_SHUFFLES) -> Tables:
    """Similarity by distance, contrasts of sections and paragraphs, first lines, and labels with their permutation test."""
    pages = structure.pages_of(lines)
    out = {
        "page similarity": structure.similarity_by_distance(pages), "section contrast": structure.section_contrast(pages), "section contrast by language": structure.section_contrast(pages.withColumn("corpus", F.col("language"))),
        "paragraph contrast": structure.paragraph_contrast(structure.line_sets(lines)), "first lines": stats.paragraph_lines(lines),
    }
    if labels is not None:
        text = lines.select("page", F.explode("words").alias("form"))
        pool = structure.pools(lines.select("page", "section"))
        rare = labels.join(structure.rare_forms(labels, text).select("form"), "form", "left_semi")
        out |= {"labels": structure.permutation_test(labels, pool, text, shuffles), "rare labels": structure.permutation_test(rare, pool, text, shuffles)}
    return out


def _replicates(spark: SparkSession, family: str, params: dict, replicates: int, seed: int) -> DataFrame:
    rows = [(family, json.dumps(params), r, seed + r) for r in range(replicates)]
    return spark.createDataFrame(rows, "family string, params string, replicate int, seed long")


def _contrasts(lines: DataFrame, key: str, runs: DataFrame) -> DataFrame:
    """Section contrast of each replicate of each value of ``key``: key, replicate, lo, hi and the numbers.

    Made words are compared page by page in the task that makes them; what leaves it is a row a bucket,
    by a shuffle: a task that holds a corpus writes no table, as each file may cost a process.
    """
    then, schema = structure.sums_in_order([key, "replicate"], lines.schema[key].dataType.simpleString())
    return structure.contrast_of_sums(generators.generated_by(lines, key, runs, "section", then, schema), [key, "replicate"])


def null_replicates(spark: SparkSession, lines: DataFrame, key: str, params: dict, replicates: int = policy.NULL_REPLICATES, seed: int = policy.CHAMPION_SEED, family: str = "Structured self-citation") -> DataFrame:
    """Section contrast of ``replicates`` generated corpora in the layout of the lines of each value of ``key``."""
    return _contrasts(lines, key, _replicates(spark, family, params, replicates, seed))


def shuffled_replicates(spark: SparkSession, lines: DataFrame, key: str, replicates: int = policy.NULL_REPLICATES, seed: int = policy.SHUFFLED_SEED) -> DataFrame:
    """The same for the words of each value of ``key``, shuffled."""
    return _contrasts(lines, key, _replicates(spark, generators.SHUFFLED, {}, replicates, seed))


def stock_replicates(spark: SparkSession, lines: DataFrame, key: str, params: dict, replicates: int = policy.NULL_REPLICATES, seed: int = policy.CAMPAIGN_SEED, stride: int = 100, family: str = "Structured self-citation", **then) -> DataFrame:
    """Lines generated apart for each value of ``key``, or what ``then`` makes of them; seeds follow the replicate and the order of first appearance."""
    first = Window.partitionBy(F.lit(0)).orderBy("p")  # a row a section or language
    groups = lines.filter(F.size("words") > 0).groupBy(key).agg(F.min("page").alias("p")).select(key, (F.row_number().over(first) - 1).alias("nth"))
    runs = _replicates(spark, family, params, replicates, seed).crossJoin(F.broadcast(groups))
    runs = runs.withColumn("seed", F.lit(seed).cast("long") + F.col("replicate") * stride + F.col("nth"))
    return generators.generated_by(lines, key, runs.drop("nth"), **then)


def campaign_null(spark: SparkSession, lines: DataFrame, key: str, params: dict, **how) -> DataFrame:
    """Similarity by distance of each replicate of lines that were generated apart by ``key`` and stand in their pages again."""
    then, schema = structure.page_texts(generators.BETWEEN)
    return structure.similarity_of_texts(stock_replicates(spark, lines, key, params, then=then, schema=schema, **how), generators.BETWEEN)


def campaign_order(lines: DataFrame, key: str) -> DataFrame:
    """``lines`` with place, their order when the lines of one key stand together."""
    lines = lines.withColumn("idx", F.struct("page", "line_no"))
    placed = structure.stable_groups(lines.select("idx", F.col(key).alias("key"))).select("idx", "place")
    return lines.join(placed, "idx").drop("idx")


def robustness(first: DataFrame, second: DataFrame, scale: DataFrame) -> Tables:
    """Two transliterations: the battery of each, the verdict by metric, and their top words."""
    a, b = stats.signature(first), stats.signature(second)
    top = lambda d: corpus.top_words(stats.tokens(d), "word")
    return {"metrics": verify.robustness(verify.vector(a).select("metric", "value"), verify.vector(b).select("metric", "value"), scale), "top words": corpus.overlap(top(first), top(second), "word")}


def diagnostics(found: DataFrame, spaces: dict[str, list], row: str, column: str) -> Tables:
    """A search over a full grid: best distance by two parameters, and each parameter's marginals."""
    flat = verify.ranked(found).join(found.filter("replicate = 0").select("family", "combo", "params"), ["family", "combo"])
    for name in spaces:
        flat = flat.withColumn(name, F.get_json_object("params", f"$.{name}"))
    values = [str(v).lower() if isinstance(v, bool) else str(v) for v in spaces[column]]
    return {"surface": verify.surface(flat, row, column, values)} | {f"by {n}": verify.marginals(flat, n) for n in spaces}


def permuted(n: int, seed: int) -> list[int]:
    """A seeded order of ``n`` things, for small driver-side lists."""
    return permutation(n, Stream(seed))
