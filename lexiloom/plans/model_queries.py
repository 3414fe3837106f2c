"""Queries of what generators learn and of the null models; the latter are sequential and have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions.prng import draws
from lexiloom.operators import corpus, generators, inventories, stats, structure, verify
from lexiloom.plans import reports
from lexiloom.plans.relation_queries import _draw_sql
from lexiloom.plans.stat_queries import _sql, rounded
from lexiloom.plans.structure_queries import search_source
from lexiloom.scratch import staged
from lexiloom.sources.adapters import document_lines, relations, table

_PARAMS = {"copyMode": "lines3", "editProb": 0.6, "secondEditProb": 0, "editSlot": "uniform", "inventorySource": "realFragments", "inventoryDepth": "full", "pFresh": 0.1, "pFunction": 0.25, "lexiconSize": 60, "pLineStartContent": 0.8, "pLineEndContent": 0.7}


def glyph_places(spark, sf):
    return inventories.glyph_places(stats.types(document_lines(spark, sf)))


def word_slots(spark, sf):
    return inventories.word_slots(stats.types(document_lines(spark, sf)))


def top_word_slots(spark, sf):
    return inventories.top_slots(inventories.word_slots(stats.types(document_lines(spark, sf))), 12)


def top_digraphs(spark, sf):
    return inventories.digraphs(stats.types(document_lines(spark, sf)), 40)


def line_edge_slots(spark, sf):
    return inventories.edge_slots(document_lines(spark, sf))


def paragraph_numbers(spark, sf):
    """Line index in the page and paragraph number of every line."""
    return structure.line_sets(document_lines(spark, sf)).select("page", F.col("idx").cast("long").alias("idx"), "paragraph", F.size("types").cast("long").alias("types"))


def page_vocabularies(spark, sf):
    return structure.pages_of(document_lines(spark, sf)).select("page", "section", "language", F.size("types").cast("long").alias("types"))


def label_pools(spark, sf):
    return structure.pools(document_lines(spark, sf).select("page", "section")).select("pool", F.col("rank").cast("long").alias("rank"), "page")


def document_signatures(spark, sf):
    """Tokens, types and moving ratio of each document as a corpus of its own."""
    lines = document_lines(spark, sf, "doc_id").withColumn("corpus", F.col("corpus").cast("string"))
    return rounded(stats.vocabulary(stats.types(lines)).select("corpus", "tokens", "types").join(stats.mattr(lines, window=20), "corpus"))


def campaign_order(spark, sf):
    """Where each line goes when the lines of one section stand together."""
    return reports.campaign_order(document_lines(spark, sf).select("page", "line_no", "section"), "section").select("page", "line_no", F.col("place").cast("long").alias("place"))


def _lines(spark, sf):
    return staged(document_lines(spark, sf).select("page", "section", "language", "line_no", "par_start", "words"), "lines")


def null_contrast(spark, sf):
    """Contrast of sources in generated corpora, one in the layout of each language, by all replicates."""
    return rounded(reports.null_replicates(spark, _lines(spark, sf), "language", _PARAMS))


def shuffled_contrast(spark, sf):
    """The same with the words of each language shuffled."""
    return rounded(reports.shuffled_replicates(spark, _lines(spark, sf), "language"))


def stock_lines(spark, sf):
    """Lines and words of all replicates of text generated apart for each language."""
    then, schema = generators.counted("language", "string")
    made = reports.stock_replicates(spark, _lines(spark, sf), "language", _PARAMS, then=then, schema=schema)
    return made.groupBy("replicate", "language").agg(F.sum("lines").alias("lines"), F.sum("words").alias("words"))


def campaign_similarity(spark, sf):
    """Similarity by distance of pages whose lines were generated apart by language."""
    return rounded(reports.campaign_null(spark, _lines(spark, sf), "language", _PARAMS))


def structure_verdicts(spark, sf):
    """Whether the contrast of sources exceeds that of shuffled words, by language and bucket."""
    lines = _lines(spark, sf)
    real = structure.contrast_of_lines(lines, "language", generators.BETWEEN)
    null = staged(reports.shuffled_replicates(spark, lines, "language"), "null")
    return rounded(structure.contrast_verdicts(real, null, by=("language",)))


def search_marginals(spark, sf):
    """The full grid of the abjad family by all replicates: marginals of one parameter."""
    found = staged(search_source(spark, sf, generators.plan(spark, ["Abjad"])), "found")
    return rounded(reports.diagnostics(found, generators.Abjad.space, "keepInitialVowel", "rechunk")["by rechunk"])


def inventory_top(spark, sf):
    """The inventory report's table of expected tokens."""
    return reports.inventory(relations(spark, sf), ["the", "der", "daiin"])["expected tokens"]


def event_zipf(spark, sf):
    """The rank-frequency fit of users by their events."""
    users = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("word")).agg(F.count(F.lit(1)).alias("n")).withColumn("corpus", F.lit("events"))
    return rounded(stats.zipf(users))


def top_types(spark, sf):
    return corpus.top_words(table(spark, sf, "events"), "event_type", 3)


def first_draws(spark, sf):
    """The first draws of a seed from the driver's twin of the column expression."""
    return spark.createDataFrame([(k, round(float(v), 12)) for k, v in enumerate(draws(408, 0, 100))], "k long, r double")


QUERIES = {
    "glyph_places": (glyph_places, _sql("""SELECT corpus, glyph, coalesce(sum(n) FILTER (i = 0), 0)::BIGINT AS initial, coalesce(sum(n) FILTER (i > 0 AND i < k - 1), 0)::BIGINT AS medial, coalesce(sum(n) FILTER (i = k - 1), 0)::BIGINT AS final
FROM (SELECT corpus, n, length(word) AS k, unnest(string_split(word, '')) AS glyph, unnest(range(0, length(word))) AS i FROM typ) GROUP BY ALL""")),
    "word_slots": (word_slots, _sql("""SELECT corpus, slot, part, sum(n)::BIGINT AS n FROM (
  SELECT corpus, 'core' AS slot, CASE WHEN length(word) < 4 THEN word ELSE word[3:length(word) - 2] END AS part, n FROM typ
  UNION ALL SELECT corpus, 'prefix', word[1:2], n FROM typ WHERE length(word) >= 4 UNION ALL SELECT corpus, 'suffix', right(word, 2), n FROM typ WHERE length(word) >= 4) WHERE part <> '' GROUP BY ALL""")),
    "top_word_slots": (top_word_slots, _sql("""SELECT corpus, slot, part, n, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY corpus, slot ORDER BY n DESC, part) AS k FROM (SELECT corpus, slot, part, sum(n)::BIGINT AS n FROM (
  SELECT corpus, 'core' AS slot, CASE WHEN length(word) < 4 THEN word ELSE word[3:length(word) - 2] END AS part, n FROM typ
  UNION ALL SELECT corpus, 'prefix', word[1:2], n FROM typ WHERE length(word) >= 4 UNION ALL SELECT corpus, 'suffix', right(word, 2), n FROM typ WHERE length(word) >= 4) WHERE part <> '' GROUP BY ALL)) WHERE k <= 12""")),
    "top_digraphs": (top_digraphs, _sql("""SELECT corpus, pair, n, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY n DESC, pair) AS k FROM (
  SELECT corpus, pair, sum(n)::BIGINT AS n FROM (SELECT corpus, n, unnest(list_transform(range(1, length(word)), lambda i: word[i:i + 1])) AS pair FROM typ WHERE length(word) > 1) GROUP BY ALL)) WHERE k <= 40""")),
    "line_edge_slots": (line_edge_slots, _sql("""SELECT corpus, edge, part, count(*) AS n FROM (
  SELECT corpus, 'start' AS edge, CASE WHEN length(words[1]) >= 4 THEN words[1][1:2] ELSE '' END AS part FROM lines WHERE len(words) > 0
  UNION ALL SELECT corpus, 'end', CASE WHEN length(words[-1]) >= 4 THEN right(words[-1], 2) ELSE '' END FROM lines WHERE len(words) > 0) GROUP BY ALL""")),
    "paragraph_numbers": (paragraph_numbers, _sql("SELECT page, line_no AS idx, line_no // 4 + 1 AS paragraph, len(list_distinct(words))::BIGINT AS types FROM lines")),
    "page_vocabularies": (page_vocabularies, _sql("SELECT page, section, language, count(DISTINCT word) AS types FROM tok GROUP BY ALL")),
    "label_pools": (label_pools, _sql("SELECT section AS pool, row_number() OVER (PARTITION BY section ORDER BY page) - 1 AS rank, page FROM (SELECT DISTINCT section, page FROM lines)")),
    "document_signatures": (document_signatures, _sql("""SELECT page::VARCHAR AS corpus, any_value(n) AS tokens, count(DISTINCT word) AS types,
  round(CASE WHEN any_value(n) > 20 THEN sum(greatest(0, least(i, n - 20) - greatest(p + 1, i - 19, 0) + 1)) / (20.0::DOUBLE * (any_value(n) - 19)) ELSE (count(*) FILTER (p < 0))::DOUBLE / any_value(n) END, 6) AS mattr
FROM (SELECT *, coalesce(lag(i) OVER (PARTITION BY page, word ORDER BY i), -1) AS p FROM (SELECT page, word, row_number() OVER (PARTITION BY page ORDER BY line_no, pos) - 1 AS i, count(*) OVER (PARTITION BY page) AS n FROM tok)) GROUP BY page""")),
    "campaign_order": (campaign_order, _sql("SELECT page, line_no::INT AS line_no, row_number() OVER (ORDER BY first, page, line_no) - 1 AS place FROM (SELECT page, line_no, min(page * 100000 + line_no) OVER (PARTITION BY section) AS first FROM lines)")),
    "null_contrast": (null_contrast, None),
    "shuffled_contrast": (shuffled_contrast, None),
    "stock_lines": (stock_lines, _sql("SELECT r::INT AS replicate, language, count(*) AS lines, sum(len(words))::BIGINT AS words FROM lines, range(0, 5) w(r) WHERE len(words) > 0 GROUP BY ALL")),
    "campaign_similarity": (campaign_similarity, None),
    "structure_verdicts": (structure_verdicts, None),
    "search_marginals": (search_marginals, None),
    "inventory_top": (inventory_top, "SELECT form, coalesce(n, 0) AS n, n IS NOT NULL AS present FROM (VALUES ('the'), ('der'), ('daiin')) v(form) LEFT JOIN (SELECT w AS form, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY 1) USING (form)"),
    "event_zipf": (event_zipf, """WITH r AS (SELECT log2(n) AS y, log2(row_number() OVER (ORDER BY n DESC, u)) AS x FROM (SELECT user_id::VARCHAR AS u, count(*) AS n FROM events GROUP BY 1) WHERE n >= 2)
SELECT 'events' AS corpus, round(coalesce(regr_slope(y, x), 0), 6) AS zipf_slope, round(coalesce(regr_intercept(y, x), 0), 6) AS zipf_intercept, round(coalesce(regr_r2(y, x), 1), 6) AS zipf_r2, count(*) AS zipf_ranks FROM r"""),
    "top_types": (top_types, "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3"),
    "first_draws": (first_draws, f"SELECT k, round({_draw_sql('408', 'k')}, 12) AS r FROM range(0, 100) t(k)"),
}
