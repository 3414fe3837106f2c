"""Queries of distances, structure, searches and generators, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom import policy
from lexiloom.operators import battery, generators, stats, structure, verify
from lexiloom.plans.relation_queries import _draw_sql
from lexiloom.plans.stat_queries import QUERIES as STATS
from lexiloom.plans.stat_queries import rounded
from lexiloom.scratch import staged
from lexiloom.sources.adapters import LINES_SQL, document_lines


def _vectors(spark, sf):
    return verify.vector(stats.signature(document_lines(spark, sf, "source")))


def signature_vectors(spark, sf):
    return rounded(_vectors(spark, sf))


def metric_scales(spark, sf):
    return rounded(verify.scales(_vectors(spark, sf)), 5)


def scaled_distances(spark, sf):
    v = _vectors(spark, sf)
    return rounded(verify.scaled_distance(v, v.filter("corpus = 'src0'"), verify.scales(v)), 5)


def z_distances(spark, sf):
    return rounded(verify.z_distances(_vectors(spark, sf), "src0"), 5)


def corpus_ranking(spark, sf):
    return rounded(verify.aggregate_distances(verify.z_distances(_vectors(spark, sf), "src0")), 5)


def robust_metrics(spark, sf):
    v = _vectors(spark, sf)
    pick = lambda c: v.filter(F.col("corpus") == c)
    return rounded(verify.robustness(pick("src0"), pick("src1"), verify.scales(v)), 4)


def metric_frontier(spark, sf):
    """Which source comes nearest to src0 in each metric, as families do in a search."""
    z = verify.z_distances(_vectors(spark, sf), "src0").filter("corpus <> 'src0'")
    return rounded(verify.frontier(z.select(F.col("corpus").alias("family"), "metric", F.col("z").alias("deviation")), 0.05), 4)


def calibration(spark, sf):
    bars = {"h1": (3.0, 5.0), "h2": (2.0, 4.0), "mattr": (0.3, 0.9), "hapax_rate": (0.4, None), "zipf_slope": (None, -0.5), "length_mean": (3.0, 8.0), "zipf_r2": (0.9, 1.0)}
    v = verify.vector(stats.signature(document_lines(spark, sf))).filter(F.col("metric").isin(*bars))
    low = F.coalesce(*[F.when(F.col("metric") == m, F.lit(b[0]).cast("double")) for m, b in bars.items()])
    high = F.coalesce(*[F.when(F.col("metric") == m, F.lit(b[1]).cast("double")) for m, b in bars.items()])
    return verify.within_bars(v.withColumn("low", low).withColumn("high", high)).select("corpus", "metric", F.round("value", 6).alias("value"), "ok")


def parameter_grid(spark, sf):
    return verify.grid_frame(spark, {"b": [1, 2, 3], "a": ["x", "y"], "c": [0.5, 0.25]})


def _pages(spark, sf):
    return structure.pages_of(document_lines(spark, sf).withColumn("corpus", F.lit("all")))


def page_similarity(spark, sf):
    return rounded(structure.similarity_by_distance(_pages(spark, sf)))


def section_contrast(spark, sf):
    pages = _pages(spark, sf).withColumn("section", F.col("language"))
    return rounded(structure.section_contrast(pages))


def section_contrast_by_language(spark, sf):
    pages = structure.pages_of(document_lines(spark, sf))
    return rounded(structure.section_contrast(pages))


def paragraph_contrast(spark, sf):
    return rounded(structure.paragraph_contrast(structure.line_sets(document_lines(spark, sf))))


def _labels(spark, sf):
    """The first word of each document is a label on it; the text is the other lines."""
    lines = document_lines(spark, sf)
    first = lines.filter((F.col("line_no") == 0) & (F.size("words") > 0)).select(F.col("page").alias("idx"), "page", "section", F.get("words", F.lit(0)).alias("form"))
    text = lines.filter("line_no > 0").select("page", F.explode("words").alias("form"))
    return first, text


def label_cooccurrence(spark, sf):
    labels, text = _labels(spark, sf)
    return rounded(structure.label_rate(labels, text))


def rare_labels(spark, sf):
    labels, text = _labels(spark, sf)
    return structure.rare_forms(labels, text)


def label_permutation(spark, sf):
    """All shuffles of all labels over the pages of their section."""
    labels, text = _labels(spark, sf)
    pool = structure.pools(labels.select("page", "section"))
    return rounded(structure.permutation_test(labels, pool, text))


def stable_groups(spark, sf):
    docs = document_lines(spark, sf).filter("line_no = 0").select(F.col("page").alias("idx"), F.when(F.col("section") != "src3", F.col("section")).alias("key"))
    return structure.stable_groups(docs).select("idx", "key", F.col("place").cast("long").alias("place"))


def search_source(spark, sf, runs):
    """``runs`` over all documents of source src1, the corpus that generators are fitted to, with its English words as plain text."""
    lines = document_lines(spark, sf, "source")
    layout = staged(lines.filter("corpus = 'src1'").withColumn("plain", F.col("language") == "en"), "layout")
    vectors = staged(verify.vector(battery.signatures_of(lines)), "vectors")
    reference = vectors.filter("corpus = 'src1'").select("metric", "value")
    return generators.search_by(layout.withColumnRenamed("corpus", "source"), "source", runs, reference, verify.scales(vectors), "plain")


def generator_search(spark, sf):
    """Four combinations of each family, drawn by the policy's seed, by all replicates, ranked by scaled distance."""
    return rounded(verify.ranked(search_source(spark, sf, generators.plan(spark, list(generators.FAMILIES), budget=4))))


def generated_words(spark, sf):
    """Lines and words of all replicates of one combination of each family, for each language a corpus of its own."""
    runs = generators.plan(spark, list(generators.FAMILIES), budget=1)
    then, schema = generators.counted("language", "string", "family")
    lines = staged(document_lines(spark, sf).select("page", "language", "line_no", "par_start", "words"), "lines")
    made = generators.generated_by(lines, "language", runs, then=then, schema=schema)
    return made.groupBy("language", "family", "replicate").agg(F.sum("lines").alias("lines"), F.sum("words").alias("words"))


_BY_SOURCE = STATS["signature_by_language"][1].replace("SELECT lang AS corpus", "SELECT source AS corpus").replace("round(", "(").replace(", 6)", ")")
_VEC = "WITH sig AS (" + _BY_SOURCE + "),\nvec AS (SELECT corpus, metric, value FROM (SELECT corpus, " + ", ".join(f"{m}::DOUBLE AS {m}" for m in policy.SIGNATURE_VECTOR) + " FROM sig) UNPIVOT (value FOR metric IN (" + ", ".join(policy.SIGNATURE_VECTOR) + ")))"
_SC = ", sc AS (SELECT metric, stddev_pop(value) AS scale FROM vec GROUP BY metric), ref AS (SELECT metric, value AS r FROM vec WHERE corpus = 'src0')"
_Z = _SC + ", z AS (SELECT corpus, metric, CASE WHEN scale > 0 THEN abs(value - r) / scale ELSE 0 END AS z FROM vec JOIN sc USING (metric) JOIN ref USING (metric))"
_BUCKETS = "bk(lo, hi) AS (VALUES " + ", ".join(f"({a}, {b})" for a, b in policy.PAGE_BUCKETS) + ")"
_LINE_BUCKETS = "bk(lo, hi) AS (VALUES " + ", ".join(f"({a}, {b})" for a, b in policy.LINE_BUCKETS) + ")"
_PG = ",\npg AS (SELECT corpus, page, section, language, list(DISTINCT word) AS s FROM tok GROUP BY ALL)"
_JACC = "len(list_intersect(a.s, b.s))::DOUBLE / nullif(len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)), 0)"


def _section_sql(corpus: str, section: str) -> str:
    return f"""WITH {LINES_SQL.strip()}{_PG},
{_BUCKETS}, grp AS (SELECT DISTINCT {corpus} AS corpus FROM pg),
pr AS (SELECT {corpus.replace('corpus', 'a.corpus') if corpus == 'corpus' else corpus} AS corpus, lo, hi, coalesce({_JACC}, 0) AS j, a.{section} = b.{section} AS same FROM pg a JOIN pg b ON b.page > a.page AND b.page <= a.page + 64 {'AND a.corpus = b.corpus' if corpus == 'corpus' else ''} JOIN bk ON b.page - a.page BETWEEN lo AND hi),
ag AS (SELECT corpus, lo, hi, coalesce(avg(j) FILTER (same), 0) AS same_mean, count(*) FILTER (same) AS same_pairs, coalesce(avg(j) FILTER (NOT same), 0) AS diff_mean, count(*) FILTER (NOT same) AS diff_pairs FROM pr GROUP BY ALL)
SELECT corpus, lo, hi, round(coalesce(same_mean, 0), 6) AS same_mean, coalesce(same_pairs, 0) AS same_pairs, round(coalesce(diff_mean, 0), 6) AS diff_mean, coalesce(diff_pairs, 0) AS diff_pairs,
  round(CASE WHEN same_pairs > 0 AND diff_pairs > 0 THEN same_mean - diff_mean ELSE 0 END, 6) AS contrast FROM grp CROSS JOIN bk LEFT JOIN ag USING (corpus, lo, hi)"""


_LABELS = ",\nlb AS (SELECT page, section, words[1] AS form FROM lines WHERE line_no = 0 AND len(words) > 0), tx AS (SELECT DISTINCT page, word AS form FROM tok WHERE line_no > 0)"

QUERIES = {
    "signature_vectors": (signature_vectors, _VEC + "\nSELECT corpus, metric, round(value, 6) AS value FROM vec"),
    "metric_scales": (metric_scales, _VEC + _SC + "\nSELECT metric, round(scale, 5) AS scale FROM sc"),
    "scaled_distances": (scaled_distances, _VEC + _SC + "\nSELECT corpus, round(coalesce(avg(abs(value - r) / scale) FILTER (scale > 0), 0), 5) AS distance FROM vec JOIN sc USING (metric) JOIN ref USING (metric) GROUP BY corpus"),
    "z_distances": (z_distances, _VEC + _Z + "\nSELECT corpus, metric, round(z, 5) AS z FROM z"),
    "corpus_ranking": (corpus_ranking, _VEC + _Z + "\nSELECT corpus, round(avg(z), 5) AS distance FROM z GROUP BY corpus"),
    "robust_metrics": (robust_metrics, _VEC + _SC + "\nSELECT metric, round(a.value, 4) AS first, round(b.value, 4) AS second, round(CASE WHEN scale > 0 THEN abs(a.value - b.value) / scale ELSE 0 END, 4) AS delta, CASE WHEN scale > 0 THEN abs(a.value - b.value) / scale ELSE 0 END <= 0.5 AS robust FROM (SELECT * FROM vec WHERE corpus = 'src0') a JOIN (SELECT * FROM vec WHERE corpus = 'src1') b USING (metric) JOIN sc USING (metric)"),
    "metric_frontier": (metric_frontier, _VEC + _Z + "\nSELECT metric, arg_min(corpus, (z, corpus)) AS family, round(min(z), 4) AS deviation, min(z) > 0.05 AS unreproduced FROM z WHERE corpus <> 'src0' GROUP BY metric"),
    "calibration": (calibration, "WITH sig AS (" + STATS["signature_by_language"][1].replace("round(", "(").replace(", 6)", ")") + ")\n" + " UNION ALL ".join(f"SELECT corpus, '{m}' AS metric, round({m}::DOUBLE, 6) AS value, {c} AS ok FROM sig" for m, c in (("length_mean", "length_mean BETWEEN 3 AND 8"), ("zipf_r2", "zipf_r2 BETWEEN 0.9 AND 1"), ("h1", "h1 BETWEEN 3 AND 5"), ("h2", "h2 BETWEEN 2 AND 4"), ("mattr", "mattr BETWEEN 0.3 AND 0.9"), ("hapax_rate", "hapax_rate >= 0.4"), ("zipf_slope", "zipf_slope <= -0.5")))),
    "parameter_grid": (parameter_grid, "SELECT row_number() OVER (ORDER BY a, b, k) - 1 AS combo, a, b, c FROM (VALUES ('x'), ('y')) x(a), (VALUES (1), (2), (3)) y(b), (VALUES (0, 0.5::DOUBLE), (1, 0.25::DOUBLE)) z(k, c)"),
    "page_similarity": (page_similarity, f"WITH {LINES_SQL.strip()}{_PG},\n{_BUCKETS}, pr AS (SELECT lo, hi, coalesce({_JACC}, 0) AS j FROM pg a JOIN pg b ON b.page > a.page AND b.page <= a.page + 64 JOIN bk ON b.page - a.page BETWEEN lo AND hi)\nSELECT 'all' AS corpus, lo, hi, round(coalesce(avg(j), 0), 6) AS mean, count(j) AS pairs FROM bk LEFT JOIN pr USING (lo, hi) GROUP BY ALL"),
    "section_contrast": (section_contrast, _section_sql("'all'", "language")),
    "section_contrast_by_language": (section_contrast_by_language, _section_sql("corpus", "section")),
    "paragraph_contrast": (paragraph_contrast, f"""WITH {LINES_SQL.strip()}, {_LINE_BUCKETS}, grp AS (SELECT DISTINCT corpus FROM lines),
ln AS (SELECT corpus, page, line_no AS i, line_no // 4 AS par, list_distinct(words) AS s FROM lines),
pr AS (SELECT a.corpus, lo, hi, coalesce({_JACC}, 0) AS j, a.par = b.par AS same FROM ln a JOIN ln b ON a.page = b.page AND b.i > a.i AND b.i <= a.i + 8 JOIN bk ON b.i - a.i BETWEEN lo AND hi),
ag AS (SELECT corpus, lo, hi, coalesce(avg(j) FILTER (same), 0) AS same_mean, count(*) FILTER (same) AS same_pairs, coalesce(avg(j) FILTER (NOT same), 0) AS diff_mean, count(*) FILTER (NOT same) AS diff_pairs FROM pr GROUP BY ALL)
SELECT corpus, lo, hi, round(coalesce(same_mean, 0), 6) AS same_mean, coalesce(same_pairs, 0) AS same_pairs, round(coalesce(diff_mean, 0), 6) AS diff_mean, coalesce(diff_pairs, 0) AS diff_pairs,
  round(CASE WHEN same_pairs > 0 AND diff_pairs > 0 THEN same_mean - diff_mean ELSE 0 END, 6) AS contrast FROM grp CROSS JOIN bk LEFT JOIN ag USING (corpus, lo, hi)"""),
    "label_cooccurrence": (label_cooccurrence, f"WITH {LINES_SQL.strip()}{_LABELS}\nSELECT count(tx.form) AS hits, count(*) AS total, round(count(tx.form)::DOUBLE / count(*), 6) AS rate FROM lb LEFT JOIN tx USING (page, form) WHERE page IN (SELECT page FROM tx)"),
    "rare_labels": (rare_labels, f"WITH {LINES_SQL.strip()}{_LABELS}\nSELECT form, count(*) AS pages FROM tx WHERE form IN (SELECT form FROM lb) GROUP BY form HAVING count(*) BETWEEN 1 AND 3"),
    "label_permutation": (label_permutation, f"""WITH {LINES_SQL.strip()}{_LABELS},
pool AS (SELECT section, page, row_number() OVER (PARTITION BY section ORDER BY page) - 1 AS rank, count(*) OVER (PARTITION BY section) AS size FROM (SELECT DISTINCT section, page FROM lb)),
sh AS (SELECT shuffle, section, form, floor({_draw_sql('630', 'shuffle * n + page')} * size)::BIGINT AS rank FROM (SELECT lb.*, size, (SELECT count(*) FROM lb) AS n FROM lb JOIN (SELECT DISTINCT section, size FROM pool) USING (section)), (SELECT unnest(range(0, 1000)) AS shuffle)),
mv AS (SELECT shuffle, form, page FROM sh JOIN pool USING (section, rank) WHERE page IN (SELECT page FROM tx)),
rt AS (SELECT shuffle, count(tx.form)::DOUBLE / count(*) AS r FROM mv LEFT JOIN tx USING (page, form) GROUP BY shuffle),
re AS (SELECT count(tx.form) AS hits, count(*) AS total, count(tx.form)::DOUBLE / count(*) AS rate FROM lb LEFT JOIN tx USING (page, form) WHERE page IN (SELECT page FROM tx))
SELECT hits, total, round(rate, 6) AS rate, round(count(*) FILTER (r >= rate) / 1000.0::DOUBLE, 6) AS p, round(avg(r), 6) AS null_mean FROM rt, re GROUP BY ALL"""),
    "stable_groups": (stable_groups, "SELECT idx, key, row_number() OVER (ORDER BY first, idx) - 1 AS place FROM (SELECT *, min(idx) OVER (PARTITION BY key) AS first FROM (SELECT doc_id AS idx, nullif(source, 'src3') AS key FROM documents WHERE text IS NOT NULL))"),
    "generator_search": (generator_search, None),
    "generated_words": (generated_words, "WITH " + LINES_SQL.strip() + "\nSELECT language, family, r::INT AS replicate, count(*) AS lines, sum(len(words))::BIGINT AS words FROM lines, (VALUES " + ", ".join(f"('{f}')" for f in generators.FAMILIES) + ") v(family), range(0, 5) w(r) WHERE len(words) > 0 GROUP BY ALL"),
}
