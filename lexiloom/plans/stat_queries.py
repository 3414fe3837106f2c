"""Queries of the statistics battery over ``documents``, by language, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators import stats
from lexiloom.scratch import staged
from lexiloom.sources.adapters import LINES_SQL, conversation_lines, document_lines


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _kinds(spark, sf):
    """The table of types, written once for plans that read it several times."""
    return staged(stats.types(document_lines(spark, sf)), "types")


def token_counts(spark, sf):
    return stats.vocabulary(_kinds(spark, sf)).select("corpus", "tokens", "types", F.round("ttr", 6).alias("ttr"), "hapaxes", F.round("hapax_rate", 6).alias("hapax_rate"))


def glyph_unigrams(spark, sf):
    return stats.glyph_counts(_kinds(spark, sf))


def glyph_bigrams(spark, sf):
    return stats.glyph_pairs(_kinds(spark, sf))


def glyph_entropies(spark, sf):
    return rounded(stats.entropies(_kinds(spark, sf)))


def zipf_fit(spark, sf):
    return rounded(stats.zipf(_kinds(spark, sf)))


def word_lengths(spark, sf):
    return rounded(stats.length_stats(_kinds(spark, sf)))


def length_histogram(spark, sf):
    h = stats.lengths(_kinds(spark, sf))
    return h.groupBy("corpus", F.least("length", F.lit(15)).cast("long").alias("length")).agg(F.sum("n").alias("n"))


def moving_ttr(spark, sf):
    return rounded(stats.mattr(document_lines(spark, sf)))


def glyph_positions(spark, sf):
    return stats.positions(_kinds(spark, sf))


def follow_q_u(spark, sf):
    return rounded(stats.follow(_kinds(spark, sf), "q", "u"))


def top_glyphs(spark, sf):
    return rounded(stats.top_shares(stats.glyph_counts(_kinds(spark, sf), separator=None), "glyph"))


def initial_q(spark, sf):
    return rounded(stats.initial_share(_kinds(spark, sf)))


def gallows_starts(spark, sf):
    return rounded(stats.gallows(document_lines(spark, sf)))


def neighbour_pairs(spark, sf):
    return rounded(stats.neighbours(document_lines(spark, sf)))


def neighbour_stats(spark, sf):
    return rounded(stats.adjacent(document_lines(spark, sf)))


def language_variation(spark, sf):
    """Total variation of word lengths between English and each other language."""
    h = stats.lengths(_kinds(spark, sf))
    en = h.filter("corpus = 'en'").select("length", F.col("n").alias("p"))
    other = h.filter("corpus <> 'en'").select("corpus", "length", F.col("n").alias("q"))
    every = other.select("corpus").distinct().crossJoin(F.broadcast(en))  # a row a corpus and length
    both = every.join(other, ["corpus", "length"], "full").fillna(0, ["p", "q"])
    return rounded(stats.total_variation(both, ["corpus"], "p", "q"))


def line_effects(spark, sf):
    return rounded(stats.line_effects(document_lines(spark, sf)))


def line_profile(spark, sf):
    return rounded(stats.line_profile(document_lines(spark, sf)))


def line_edges(spark, sf):
    return stats.edge_glyphs(document_lines(spark, sf))


def line_edge_divergence(spark, sf):
    return rounded(stats.divergence_of(stats.edges_of(_kinds(spark, sf))))


def line_edge_top(spark, sf):
    return rounded(stats.top_edges(stats.edges_of(_kinds(spark, sf)))).withColumn("rank", F.col("rank").cast("long"))


def line_edge_second_corpus(spark, sf):
    """The ratio of each glyph at line ends, here and in a second corpus."""
    one = stats.top_edges(stats.edge_glyphs(document_lines(spark, sf)).groupBy("glyph").agg(F.sum("line_end").alias("line_end"), F.sum("other_end").alias("other_end")).withColumn("corpus", F.lit("all")), n=50, least=1)
    two = stats.top_edges(stats.edge_glyphs(conversation_lines(spark, sf)), n=50, least=1)
    return rounded(one.select("glyph", F.col("ratio").alias("ratio_here")).join(two.select("glyph", F.col("ratio").alias("ratio_there")), "glyph"))


def paragraph_starts(spark, sf):
    return rounded(stats.paragraphs_of(_kinds(spark, sf)))


def signature_by_language(spark, sf):
    return rounded(stats.signature(document_lines(spark, sf)))


def _sql(body: str, more: str = "") -> str:
    return f"WITH {LINES_SQL.strip()}{more}\n{body}"


_GLYPHS = r""",
g AS (SELECT corpus, word, n, n_first, n_last, regexp_extract_all(word, '(@[0-9]{3};|.)') AS g FROM typ),
uni AS (SELECT corpus, glyph, sum(n)::BIGINT AS n FROM (
  SELECT corpus, unnest(g) AS glyph, n FROM g UNION ALL SELECT corpus, '.', n - n_first FROM typ WHERE n > n_first) GROUP BY ALL),
bi AS (SELECT corpus, first, second, sum(n)::BIGINT AS n FROM (
  SELECT corpus, unnest(g[1 : len(g) - 1]) AS first, unnest(g[2 : len(g)]) AS second, n FROM g WHERE len(g) > 1
  UNION ALL SELECT corpus, g[len(g)], '.', n - n_last FROM g WHERE n > n_last
  UNION ALL SELECT corpus, '.', g[1], n - n_first FROM g WHERE n > n_first) GROUP BY ALL)"""
_LENGTHS = ",\nhist AS (SELECT corpus, length(word)::BIGINT AS length, sum(n)::BIGINT AS n FROM typ GROUP BY ALL)"
_EDGES = r""",
big AS (SELECT * FROM tok WHERE n_words >= 3),
edges AS (SELECT corpus, glyph, sum(a)::BIGINT AS line_end, sum(b)::BIGINT AS other_end, sum(c)::BIGINT AS line_start, sum(d)::BIGINT AS other_start FROM (
  SELECT corpus, word[-1] AS glyph, (pos = n_words - 1)::INT AS a, (pos < n_words - 1)::INT AS b, 0 AS c, 0 AS d FROM big
  UNION ALL SELECT corpus, word[1], 0, 0, (pos = 0)::INT, (pos > 0)::INT FROM big) GROUP BY ALL)"""
_PAIRS = r""",
nb AS (SELECT corpus, a, b, count(*) AS n FROM (SELECT corpus, unnest(words[1 : len(words) - 1]) AS a, unnest(words[2 : len(words)]) AS b FROM lines WHERE len(words) > 1) GROUP BY ALL),
nd AS (SELECT corpus, a, b, n, levenshtein(a, b)::INT AS d, 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b), 1) AS s FROM nb)"""
_MATTR = r""",
ix AS (SELECT corpus, word, row_number() OVER (PARTITION BY corpus ORDER BY page, line_no, pos) - 1 AS i, count(*) OVER (PARTITION BY corpus) AS n FROM tok),
pv AS (SELECT *, coalesce(lag(i) OVER (PARTITION BY corpus, word ORDER BY i), -1) AS p FROM ix),
mt AS (SELECT corpus, CASE WHEN max(n) > 500 THEN sum(greatest(0, least(i, n - 500) - greatest(p + 1, i - 499, 0) + 1)) / (500.0::DOUBLE * (max(n) - 499))
       ELSE (count(*) FILTER (p < 0))::DOUBLE / max(n) END AS mattr FROM pv GROUP BY corpus)"""
_ENT = r""",
e1 AS (SELECT corpus, log2(count(*)) AS h0, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h1 FROM uni GROUP BY corpus),
e2 AS (SELECT corpus, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS hp FROM bi GROUP BY corpus),
e3 AS (SELECT corpus, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS hf FROM (SELECT corpus, first, sum(n) AS n FROM bi GROUP BY ALL) GROUP BY corpus),
en AS (SELECT corpus, h0, greatest(h1, 0) AS h1, coalesce(greatest(hp - hf, 0), 0) AS h2 FROM e1 LEFT JOIN e2 USING (corpus) LEFT JOIN e3 USING (corpus))"""
_ZIPF = r""",
rk AS (SELECT corpus, log2(n) AS y, log2(row_number() OVER (PARTITION BY corpus ORDER BY n DESC, word)) AS x FROM typ WHERE n >= 2),
zf AS (SELECT corpus, CASE WHEN count(*) < 2 THEN 0 ELSE coalesce(regr_slope(y, x), 0) END AS zipf_slope, CASE WHEN count(*) < 2 THEN max(y) ELSE coalesce(regr_intercept(y, x), 0) END AS zipf_intercept,
       CASE WHEN count(*) < 2 THEN 0 ELSE coalesce(regr_r2(y, x), 1) END AS zipf_r2, count(*) AS zipf_ranks FROM rk GROUP BY corpus)"""
_LEN = r""",
ls AS (SELECT corpus, sum(n * length)::DOUBLE / sum(n) AS length_mean, sqrt(greatest(sum(n) * sum(n * length * length) - sum(n * length) * sum(n * length), 0)::DOUBLE) / sum(n) AS length_sd,
       arg_max(length, n * 1000000 - length) AS length_mode, sum(n * length)::BIGINT AS glyphs FROM hist GROUP BY corpus)"""
_GAL = r""",
fl AS (SELECT corpus, par_start, (words[1][1] IN ('k', 't', 'p', 'f'))::INT AS hit FROM lines WHERE len(words) > 0),
ga AS (SELECT corpus, coalesce(sum(hit) FILTER (par_start), 0)::BIGINT AS start_hits, count(*) FILTER (par_start) AS start_lines,
       coalesce(sum(hit) FILTER (NOT par_start), 0)::BIGINT AS other_hits, count(*) FILTER (NOT par_start) AS other_lines FROM fl GROUP BY corpus),
gs AS (SELECT *, CASE WHEN start_lines > 0 THEN start_hits::DOUBLE / start_lines ELSE 0 END AS start_share, CASE WHEN other_lines > 0 THEN other_hits::DOUBLE / other_lines ELSE 0 END AS other_share FROM ga),
gc AS (SELECT *, CASE WHEN other_share > 0 THEN start_share / other_share WHEN start_share > 0 THEN 'Infinity'::DOUBLE ELSE 0 END AS contrast FROM gs)"""
_ADJ = r""",
aj AS (SELECT corpus, sum(n)::BIGINT AS pairs, coalesce(sum(n) FILTER (d = 0), 0)::BIGINT AS identical, coalesce(sum(n) FILTER (d = 1), 0)::BIGINT AS distance1, sum(n * s) / sum(n) AS mean_similarity FROM nd GROUP BY corpus)"""
_EFF = r""",
le AS (SELECT corpus, coalesce(avg(length(word)) FILTER (pos = 0), 0) AS first_mean, coalesce(avg(length(word)) FILTER (pos > 0 AND pos < n_words - 1), 0) AS inner_mean,
       coalesce(avg(length(word)) FILTER (pos = n_words - 1), 0) AS last_mean, count(*) FILTER (pos = 0) AS lines, count(*) FILTER (pos > 0 AND pos < n_words - 1) AS inner_count FROM tok WHERE n_words >= 3 GROUP BY corpus)"""
_DIV = r""",
ed AS (SELECT corpus, sum(abs(line_end / nullif(le, 0) - other_end / nullif(oe, 0))) / 2 AS end_divergence, sum(abs(line_start / nullif(ls_, 0) - other_start / nullif(os, 0))) / 2 AS start_divergence
       FROM (SELECT *, sum(line_end) OVER (PARTITION BY corpus) AS le, sum(other_end) OVER (PARTITION BY corpus) AS oe, sum(line_start) OVER (PARTITION BY corpus) AS ls_, sum(other_start) OVER (PARTITION BY corpus) AS os FROM edges) GROUP BY corpus)"""
_PAR = r""",
pk AS (SELECT corpus, word[1] AS glyph, sum(par_start::INT)::BIGINT AS s, sum((NOT par_start)::INT)::BIGINT AS o FROM tok GROUP BY ALL),
pm AS (SELECT corpus, coalesce(avg(length(word)) FILTER (par_start), 0) AS start_mean, coalesce(avg(length(word)) FILTER (NOT par_start), 0) AS other_mean FROM tok GROUP BY corpus),
pv2 AS (SELECT corpus, sum(abs(s / nullif(ts, 0) - o / nullif(t_o, 0))) / 2 AS initial_tv FROM (SELECT *, sum(s) OVER (PARTITION BY corpus) AS ts, sum(o) OVER (PARTITION BY corpus) AS t_o FROM pk) GROUP BY corpus),
pl AS (SELECT corpus, start_mean, other_mean, start_mean - other_mean AS delta, coalesce(initial_tv, 0) AS initial_tv FROM pm JOIN pv2 USING (corpus))"""
_VOC = ",\nvo AS (SELECT corpus, sum(n)::BIGINT AS tokens, count(*) AS types, count(*)::DOUBLE / sum(n) AS ttr, count(*) FILTER (n = 1) AS hapaxes, (count(*) FILTER (n = 1))::DOUBLE / count(*) AS hapax_rate FROM typ GROUP BY corpus)"
_QS = ",\nqi AS (SELECT corpus, coalesce(sum(CASE WHEN word[1] = 'q' THEN n END)::DOUBLE / nullif(sum(n * (length(word) - length(replace(word, 'q', '')))), 0), 0) AS share FROM typ GROUP BY corpus)"

_R = lambda *cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)

QUERIES = {
    "token_counts": (token_counts, _sql(f"SELECT corpus, tokens, types, hapaxes, {_R('ttr', 'hapax_rate')} FROM vo", _VOC)),
    "glyph_unigrams": (glyph_unigrams, _sql("SELECT * FROM uni", _GLYPHS)),
    "glyph_bigrams": (glyph_bigrams, _sql("SELECT * FROM bi", _GLYPHS)),
    "glyph_entropies": (glyph_entropies, _sql(f"SELECT corpus, {_R('h0', 'h1', 'h2')} FROM en", _GLYPHS + _ENT)),
    "zipf_fit": (zipf_fit, _sql(f"SELECT corpus, zipf_ranks, {_R('zipf_slope', 'zipf_intercept', 'zipf_r2')} FROM zf", _ZIPF)),
    "word_lengths": (word_lengths, _sql(f"SELECT corpus, length_mode, glyphs, {_R('length_mean', 'length_sd')} FROM ls", _LENGTHS + _LEN)),
    "length_histogram": (length_histogram, _sql("SELECT corpus, least(length, 15) AS length, sum(n)::BIGINT AS n FROM hist GROUP BY ALL", _LENGTHS)),
    "moving_ttr": (moving_ttr, _sql(f"SELECT corpus, {_R('mattr')} FROM mt", _MATTR)),
    "glyph_positions": (glyph_positions, _sql("""SELECT corpus, glyph, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (i = 0), 0)::BIGINT AS initial, coalesce(sum(n) FILTER (i = k - 1), 0)::BIGINT AS final,
  coalesce(sum(n) FILTER (b = 0), 0)::BIGINT AS bin0, coalesce(sum(n) FILTER (b = 1), 0)::BIGINT AS bin1, coalesce(sum(n) FILTER (b = 2), 0)::BIGINT AS bin2, coalesce(sum(n) FILTER (b = 3), 0)::BIGINT AS bin3, coalesce(sum(n) FILTER (b = 4), 0)::BIGINT AS bin4
FROM (SELECT *, CASE WHEN k = 1 THEN 0 ELSE least(4, floor(i / (k - 1)::DOUBLE * 5)) END AS b FROM (SELECT corpus, n, len(g) AS k, unnest(g) AS glyph, unnest(range(0, len(g))) AS i FROM g)) GROUP BY ALL""", _GLYPHS)),
    "follow_q_u": (follow_q_u, _sql("""SELECT corpus, sum(n)::BIGINT AS occurrences, coalesce(sum(n) FILTER (g[i + 1] = 'u'), 0)::BIGINT AS followed, round(coalesce(sum(n) FILTER (g[i + 1] = 'u'), 0)::DOUBLE / sum(n), 6) AS ratio
FROM (SELECT corpus, n, g, unnest(g) AS c, unnest(range(1, len(g) + 1)) AS i FROM g) WHERE c = 'q' GROUP BY corpus""", _GLYPHS)),
    "top_glyphs": (top_glyphs, _sql("""SELECT corpus, rank::INT AS rank, glyph, n, round(n::DOUBLE / w, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY n DESC, glyph) AS rank, sum(n) OVER (PARTITION BY corpus) AS w FROM uni WHERE glyph <> '.') WHERE rank <= 15""", _GLYPHS)),
    "initial_q": (initial_q, _sql(f"SELECT corpus, {_R('share')} FROM qi", _QS)),
    "gallows_starts": (gallows_starts, _sql(f"SELECT corpus, start_hits, start_lines, other_hits, other_lines, {_R('start_share', 'other_share', 'contrast')} FROM gc", _GAL)),
    "neighbour_pairs": (neighbour_pairs, _sql("SELECT corpus, a, b, n, d, round(s, 6) AS similarity FROM nd", _PAIRS)),
    "neighbour_stats": (neighbour_stats, _sql("SELECT corpus, pairs, identical, distance1, round(identical::DOUBLE / pairs, 6) AS identical_share, round(distance1::DOUBLE / pairs, 6) AS distance1_share, round(mean_similarity, 6) AS mean_similarity FROM aj", _PAIRS + _ADJ)),
    "language_variation": (language_variation, _sql("""SELECT corpus, round(sum(abs(p / pw - q / qw)) / 2, 6) AS tv FROM (
  SELECT corpus, length, coalesce(p, 0)::DOUBLE AS p, coalesce(q, 0)::DOUBLE AS q, sum(coalesce(p, 0)) OVER (PARTITION BY corpus) AS pw, sum(coalesce(q, 0)) OVER (PARTITION BY corpus) AS qw FROM
  (SELECT c.corpus, e.length, e.n AS p FROM (SELECT DISTINCT corpus FROM hist WHERE corpus <> 'en') c, (SELECT * FROM hist WHERE corpus = 'en') e)
  FULL JOIN (SELECT corpus, length, n AS q FROM hist WHERE corpus <> 'en') USING (corpus, length)) GROUP BY corpus""", _LENGTHS)),
    "line_effects": (line_effects, _sql(f"SELECT corpus, lines, inner_count, {_R('first_mean', 'inner_mean', 'last_mean')} FROM le", _EFF)),
    "line_profile": (line_profile, _sql("""SELECT corpus, round(coalesce(avg(length(word)) FILTER (pos = 0), 0), 6) AS first, round(coalesce(avg(length(word)) FILTER (pos = 1), 0), 6) AS second,
  round(coalesce(avg(length(word)) FILTER (pos > 1 AND n_words - pos > 2), 0), 6) AS middle, round(coalesce(avg(length(word)) FILTER (n_words - pos = 2), 0), 6) AS penultimate,
  round(coalesce(avg(length(word)) FILTER (n_words - pos = 1), 0), 6) AS last, count(*) FILTER (pos = 0) AS lines FROM tok WHERE n_words >= 5 GROUP BY corpus""")),
    "line_edges": (line_edges, _sql("SELECT * FROM edges", _EDGES)),
    "line_edge_divergence": (line_edge_divergence, _sql(f"SELECT corpus, {_R('end_divergence', 'start_divergence')} FROM ed", _EDGES + _DIV)),
    "line_edge_top": (line_edge_top, _sql("""SELECT corpus, k AS rank, glyph, line_end AS edge, other_end AS other, round(es, 6) AS edge_share, round(os, 6) AS other_share, round(ratio, 6) AS ratio FROM (
  SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY ratio DESC, glyph) AS k FROM (SELECT *, CASE WHEN os > 0 THEN es / os ELSE 'Infinity'::DOUBLE END AS ratio FROM (
  SELECT *, line_end::DOUBLE / sum(line_end) OVER (PARTITION BY corpus) AS es, other_end::DOUBLE / sum(other_end) OVER (PARTITION BY corpus) AS os FROM edges)) WHERE line_end >= 20) WHERE k <= 8""", _EDGES)),
    "line_edge_second_corpus": (line_edge_second_corpus, _sql("""SELECT glyph, round(a.ratio, 6) AS ratio_here, round(b.ratio, 6) AS ratio_there FROM
  (SELECT glyph, CASE WHEN o > 0 THEN (e::DOUBLE / ew) / (o::DOUBLE / ow) ELSE 'Infinity'::DOUBLE END AS ratio, e FROM (SELECT *, sum(e) OVER () AS ew, sum(o) OVER () AS ow FROM (SELECT glyph, sum(line_end) AS e, sum(other_end) AS o FROM edges GROUP BY glyph))) a
  JOIN (SELECT glyph, CASE WHEN o > 0 THEN (e::DOUBLE / ew) / (o::DOUBLE / ow) ELSE 'Infinity'::DOUBLE END AS ratio, e FROM (SELECT *, sum(e) OVER () AS ew, sum(o) OVER () AS ow FROM (
    SELECT word[-1] AS glyph, count(*) FILTER (pos = n) AS e, count(*) FILTER (pos < n) AS o FROM (SELECT len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations) WHERE len(w) >= 3) GROUP BY glyph))) b USING (glyph)
  WHERE a.e >= 1 AND b.e >= 1""", _EDGES)),
    "paragraph_starts": (paragraph_starts, _sql(f"SELECT corpus, {_R('start_mean', 'other_mean', 'delta', 'initial_tv')} FROM pl", _PAR)),
    "signature_by_language": (signature_by_language, _sql(f"""SELECT corpus, tokens, types, {_R('ttr')}, hapaxes, {_R('hapax_rate', 'length_mean', 'length_sd')}, length_mode, glyphs, {_R('h0', 'h1', 'h2', 'zipf_slope', 'zipf_intercept', 'zipf_r2')}, zipf_ranks, {_R('mattr')},
  round(start_share, 6) AS gallows_start, round(other_share, 6) AS gallows_other, round(contrast, 6) AS gallows_contrast, round(share, 6) AS q_initial, pairs, round(identical::DOUBLE / pairs, 6) AS identical_share, round(distance1::DOUBLE / pairs, 6) AS distance1_share, {_R('mean_similarity')},
  round(first_mean - inner_mean, 6) AS first_effect, round(last_mean - inner_mean, 6) AS last_effect, {_R('end_divergence', 'start_divergence')}, round(delta, 6) AS paragraph_delta, round(initial_tv, 6) AS paragraph_tv
FROM vo JOIN ls USING (corpus) JOIN en USING (corpus) JOIN zf USING (corpus) JOIN mt USING (corpus) JOIN gc USING (corpus) JOIN qi USING (corpus) JOIN aj USING (corpus) JOIN le USING (corpus) JOIN ed USING (corpus) JOIN pl USING (corpus)""",
        _VOC + _LENGTHS + _LEN + _GLYPHS + _ENT + _ZIPF + _MATTR + _GAL + _QS + _PAIRS + _ADJ + _EFF + _EDGES + _DIV + _PAR)),
}
