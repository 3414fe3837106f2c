"""Queries of the relational access layer, sources, draws and controls, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom import policy
from lexiloom.functions import text as text_functions
from lexiloom.functions.prng import draw
from lexiloom.operators import control_tasks, controls, corpus, holdout, stats
from lexiloom.plans.stat_queries import rounded
from lexiloom.scratch import staged
from lexiloom.sources import markup
from lexiloom.sources.adapters import LINES_SQL, RELATIONS_SQL, document_lines, relations, table


def _held(spark, sf):
    """Every seventh page is held out."""
    pages = relations(spark, sf)["pages"]
    return pages.filter("id % 7 = 0").select(F.col("id").alias("page_id"), text_functions.folio_of(F.col("name")).alias("folio"), F.lit(408).alias("seed"), F.lit("2020-01-01").alias("frozen_at"))


def paragraph_corpus(spark, sf):
    lines = corpus.paragraph_lines(corpus.working(relations(spark, sf), _held(spark, sf)), "A")
    return lines.select("page", "page_name", "section", "language", "line_no", "par_start", F.size("words").cast("long").alias("n_words"), F.array_join("words", " ").alias("words"))


def held_out_corpus(spark, sf):
    lines = corpus.paragraph_lines(corpus.held_out(relations(spark, sf), _held(spark, sf)))
    return lines.select("page", "line_no", F.size("words").cast("long").alias("n_words"), F.array_join("words", " ").alias("words"))


def label_words(spark, sf):
    return corpus.labels(corpus.working(relations(spark, sf), _held(spark, sf)))


def working_counts(spark, sf):
    return corpus.totals(corpus.working(relations(spark, sf), _held(spark, sf)))


def corpus_totals(spark, sf):
    return corpus.totals(relations(spark, sf))


def section_crosstab(spark, sf):
    return corpus.crosstab(relations(spark, sf)["pages"])


def hand_histogram(spark, sf):
    return corpus.histogram(relations(spark, sf)["pages"], "hand")


def top_tokens(spark, sf):
    return corpus.top_words(relations(spark, sf)["tokens"], "form")


def top_tokens_by_language(spark, sf):
    return corpus.top_words(stats.tokens(document_lines(spark, sf)), "word", 10, ["corpus"])


def expected_tokens(spark, sf):
    return corpus.presence(relations(spark, sf)["tokens"], ["the", "and", "der", "daiin"])


def distinct_types(spark, sf):
    return corpus.distinct_types(relations(spark, sf)["tokens"])


def uncertainty(spark, sf):
    return corpus.uncertainty(relations(spark, sf)["tokens"])


def holdout_summary(spark, sf):
    return corpus.holdout_summary(_held(spark, sf))


def range_verdicts(spark, sf):
    t = corpus.totals(relations(spark, sf))
    rows = t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("value"), F.lit(1000).cast("long").alias("low"), F.lit(20000).cast("long").alias("high")) for c in ("pages", "loci", "tokens")])).alias("v")).select("v.*")
    return corpus.verdicts(rows)


def top_overlap(spark, sf):
    words = stats.tokens(document_lines(spark, sf))
    pick = lambda c: corpus.top_words(words.filter(F.col("corpus") == c), "word")
    return corpus.overlap(pick("en"), pick("fr"), "word")


def working_by_folio(spark, sf):
    pages = relations(spark, sf)["pages"]
    return corpus.without_folios(pages, text_functions.folio_of(F.col("name")), ["f1", "f5", "f9"]).select("id", "name", text_functions.folio_of(F.col("name")).alias("folio"))


def leaf_strata(spark, sf):
    return holdout.leaves(relations(spark, sf)["pages"])


def holdout_draw(spark, sf):
    return holdout.draw(relations(spark, sf)["pages"])


def held_pages(spark, sf):
    pages = relations(spark, sf)["pages"]
    return holdout.held_pages(pages, holdout.draw(pages)).select("id", "name", "folio")


def random_draws(spark, sf):
    """A draw of four seeds for each document."""
    docs = table(spark, sf, "documents").select("doc_id")
    return docs.select("doc_id", *[F.round(draw(s, F.col("doc_id")), 12).alias(f"r{s}") for s in (0, 408, 412, 4294967295)])


def weighted_picks(spark, sf):
    """For each document a glyph drawn by the weights of the English glyphs, in order of the alphabet."""
    counts = stats.glyph_counts(stats.types(document_lines(spark, sf).filter("corpus = 'en'")), separator=None).select("glyph", "n").orderBy("glyph").collect()  # an alphabet
    total, sums = 0, []
    for r in counts:
        total += r["n"]
        sums.append((r["glyph"], total))
    docs = table(spark, sf, "documents").select("doc_id")
    return docs.select("doc_id", controls.pick(draw(policy.GIBBERISH_SEED, F.col("doc_id")) * F.lit(float(total)), sums).alias("glyph"))


def replicate_seeds(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return docs.select("doc_id", (F.lit(policy.SEARCH_SEED) + 1 + F.col("doc_id") * 5 + F.col("doc_id") % 5).cast("long").alias("seed"))


def scalar_text(spark, sf):
    """Leaf, skeletons of consonants and glyph length of each page name and first word."""
    r = relations(spark, sf)
    pages = r["pages"].select("id", "name")
    first = r["tokens"].filter("position = 0").select((F.floor(F.col("locus_id") / 100_000)).cast("long").alias("id"), (F.col("locus_id") % 100_000).alias("k"), "form").filter("k = 0")
    rows = pages.join(first, "id", "left")
    return rows.select("id", text_functions.folio_of(F.col("name")).alias("folio"), "form", text_functions.strip_vowels(F.col("form")).alias("bare"), text_functions.strip_vowels(F.col("form"), True).alias("kept"), text_functions.glyph_count(F.col("form")).cast("long").alias("glyphs"))


def stripped_marks(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.sha2(text_functions.strip_marks(F.lower("text")), 256).alias("plain"))


def _markup_files(spark, sf):
    """Each document as a transliteration file of one page; words are joined by dots."""
    docs = table(spark, sf, "documents").select("doc_id", F.split("text", "\n", -1).alias("l"))
    words = lambda x: F.array_join(F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), F.lit(0)), ".")
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("r"))
    line = lambda x, i: F.concat(F.lit("<"), name, F.lit("."), (i + 1).cast("string"), F.lit(",@P0> <%>"), words(x), F.when(i % 3 == 0, F.lit(".x/\n/y")).otherwise(F.lit("<$>")))
    head = F.concat(F.lit("#=IVTFF Eva- 2.0 M 5\n# a comment\n<"), name, F.lit("> <! $Q=A $H="), (F.col("doc_id") % 3).cast("string"), F.lit(">\n"))
    return docs.select(F.col("doc_id").cast("string").alias("file"), F.concat(head, F.array_join(F.transform("l", line), "\n")).alias("text"))


def markup_tokens(spark, sf):
    """Documents written as markup, parsed and tokenised: tokens of every locus."""
    parts = markup.ingest(_markup_files(spark, sf))
    t = parts["tokens"].groupBy("file", "num").agg(F.count(F.lit(1)).alias("tokens"), F.sum("glyph_count").alias("glyphs"), F.max("position").cast("long").alias("last"))
    return t.select(F.col("file").cast("long").alias("doc_id"), F.col("num").cast("long").alias("num"), "tokens", "glyphs", "last")


def markup_pages(spark, sf):
    parts = markup.ingest(_markup_files(spark, sf))
    return parts["pages"].select(F.col("file").cast("long").alias("doc_id"), "name", "seq", "quire", "hand")


def _decorated(spark, sf):
    """Documents as files of one page that use all of the markup, by the place of the word in the line."""
    docs = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.split("text", "\n", -1).alias("l"))
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("r"))

    def word(x, i):
        forms = {1: ("[", ":zz]"), 2: ("{", "}"), 3: ("", "@123;"), 4: ("", "?")}
        between = F.when(i == 0, "").when(i % 3 == 0, ".").when(i % 3 == 1, ",").otherwise("<->")
        out = x
        for k, (before, after) in forms.items():
            out = F.when(i % 6 == k, F.concat(F.lit(before), x, F.lit(after))).otherwise(out)
        return F.concat(between, out, F.when(i == 0, "<!a note>").otherwise(""))

    words = lambda x: F.array_join(F.transform(F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), F.lit(0)), word), "")
    line = lambda x, i: F.concat(F.lit("<"), name, F.lit("."), (i + 1).cast("string"), F.lit(",+P0> "), F.when(i % 4 == 0, "<%>").otherwise(""), F.when(i % 5 == 4, "<@H=7>").otherwise(""), words(x))
    head = F.concat(F.lit("#=IVTFF Eva- 2.0 M 5\n<"), name, F.lit("> <! $I=T $H=3>\n"))
    return docs.select(F.col("doc_id").cast("string").alias("file"), F.concat(head, F.array_join(F.transform("l", line), "\n")).alias("text"))


def markup_flags(spark, sf):
    """Tokens of documents with alternatives, ligatures, codes, unreadable glyphs, comments and three separators."""
    t = markup.ingest(_decorated(spark, sf))["tokens"]
    whole = [F.col(c).cast("long").alias(c) for c in ("num", "position", "glyph_count")]
    return t.select(F.col("file").cast("long").alias("doc_id"), *whole, "form", "sep_before", "has_alternative", "has_ligature", "has_high_ascii", "has_unreadable")


def markup_hands(spark, sf):
    """Hands of loci, from the page or from the last tag above, and paragraph starts."""
    loci = markup.ingest(_decorated(spark, sf))["loci"]
    return loci.select(F.col("file").cast("long").alias("doc_id"), F.col("num").cast("long").alias("num"), "hand", "par_start", "par_end")


def markup_errors(spark, sf):
    """Files whose first locus names another page: one fault each."""
    broken = _markup_files(spark, sf).withColumn("text", F.regexp_replace("text", r"<f([0-9]+)r\.1,", "<f$1v.1,"))
    return markup.parse(broken)["errors"].select(F.col("file").cast("long").alias("doc_id"), F.col("line").cast("long").alias("line"), "message")


def latin_words(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(controls.latin_words(F.col("html")), " ").alias("words"))


def latin_index(spark, sf):
    return controls.latin(table(spark, sf, "pages"))


def enciphered(spark, sf):
    words = controls.latin(table(spark, sf, "pages"))
    letters, cipher = controls.substitution(words)
    return words.select("idx", controls.encipher(F.col("word"), letters, cipher).alias("word"))


def _english(spark, sf):
    return document_lines(spark, sf).filter("corpus = 'en'")


def gibberish(spark, sf):
    return controls.gibberish(stats.indexed(_english(spark, sf)).select("idx", "word"))


def shuffled_words(spark, sf):
    lines = staged(_english(spark, sf).select("corpus", "page", "line_no", "par_start", "words"), "english")
    return controls.shuffled(stats.indexed(lines).select("idx", "word"), count=lines.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n")))


def layout(spark, sf):
    return controls.skeleton(_english(spark, sf)).select("page", "line_no", "par_start", F.col("word_count").cast("long").alias("word_count"), F.coalesce("start", F.lit(-1)).cast("long").alias("start"), F.array_join(F.transform("lengths", lambda x: x.cast("string")), ",").alias("lengths"))


def poured(spark, sf):
    """English words in reverse order, in the layout they came from."""
    lines = _english(spark, sf)
    words = stats.indexed(lines).select("idx", "word")
    n = words.agg(F.max("idx").alias("top"))
    back = words.crossJoin(F.broadcast(n)).select((F.col("top") - F.col("idx")).alias("idx"), "word")  # one row
    return controls.pour(controls.skeleton(lines), back, "back").select("page", "line_no", "par_start", F.array_join("words", " ").alias("words"))


def control_signatures(spark, sf):
    return rounded(control_tasks.signatures(_english(spark, sf), controls.latin_lines(table(spark, sf, "pages"))))


def _r(body: str, held: bool = False) -> str:
    w = "" if not held else ",\nwp AS (SELECT * FROM p WHERE id % 7 <> 0), hp AS (SELECT * FROM p WHERE id % 7 = 0)"
    return f"WITH {RELATIONS_SQL.strip()}{w}\n{body}"


_MASK = "4294967295"


def _draw_sql(seed: str, k: str) -> str:
    """The k-th draw of a seed as one DuckDB expression."""
    s0 = f"(({seed}::HUGEINT + ({k} + 1)::HUGEINT * 1831565813) % 4294967296)::BIGINT"
    t1 = "((xor(s0, s0 >> 15)::HUGEINT * (s0 | 1)::HUGEINT) % 4294967296)::BIGINT"
    t2 = f"xor(t1, (t1 + ((xor(t1, t1 >> 7)::HUGEINT * (t1 | 61)::HUGEINT) % 4294967296)::BIGINT) & {_MASK})"
    return f"(SELECT (xor(t2, t2 >> 14) & {_MASK}) / 4294967296.0::DOUBLE FROM (SELECT {t2} AS t2 FROM (SELECT {t1} AS t1 FROM (SELECT {s0} AS s0))))"


def _permuted_sql(groups: str, seed: str) -> str:
    """CTEs that put the list f of each row of ``groups`` (g, f, n, start) in the seeded order: rows of ``done`` with g and f.

    A list of n takes draws start to start + n - 2; each exchanges the last open place with one at or before it.
    """
    return f"""grp AS ({groups}),
sw AS (SELECT g, last, floor({_draw_sql(seed, 'start + n - 1 - last')} * (last + 1))::BIGINT AS o FROM (SELECT g, n, start, unnest(range(1, n)) AS last FROM grp)),
pm AS (SELECT g, f, n - 1 AS last FROM grp UNION ALL
  SELECT pm.g, list_transform(range(1, len(f) + 1), lambda i: CASE WHEN i = pm.last + 1 THEN f[o + 1] WHEN i = o + 1 THEN f[pm.last + 1] ELSE f[i] END), pm.last - 1 FROM pm JOIN sw ON sw.g = pm.g AND sw.last = pm.last),
done AS (SELECT g, f FROM pm WHERE last = 0)"""


_HOLDOUT = "WITH RECURSIVE " + RELATIONS_SQL.strip() + """,
lf AS (SELECT 'f' || (id // 2) AS folio, arg_min(coalesce(illustration_type, '?') || '/' || coalesce(currier_language, '?'), seq) AS stratum FROM p GROUP BY 1),
st AS (SELECT stratum AS g, list(folio ORDER BY folio) AS f, count(*) AS n FROM lf GROUP BY stratum),
""" + _permuted_sql("SELECT g, f, n, (sum(n - 1) OVER (ORDER BY g) - (n - 1))::BIGINT AS start FROM st", "408") + """,
chosen AS (SELECT g AS stratum, unnest(f[1 : floor(len(f) * 0.15::DOUBLE + 0.5)::BIGINT]) AS folio FROM done)"""

_LATIN = r"""
lat AS (SELECT page_id, regexp_extract_all(strip_accents(replace(replace(lower(x), 'æ', 'ae'), 'œ', 'oe')), '[a-z]+') AS w FROM (
  SELECT page_id, replace(replace(replace(replace(CASE WHEN instr(h, '[1]') > 0 THEN substr(h, instr(h, '[1]')) ELSE h END, 'The Latin Library', ' '), 'The Classics Page', ' '), 'The Christian Latin Pages', ' '), 'Christian Latin', ' ') AS x FROM (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS h FROM pages)))"""
_EN = r""",
ei AS (SELECT page, line_no, par_start, n_words, pos, word, row_number() OVER (ORDER BY page, line_no, pos) - 1 AS idx FROM tok WHERE corpus = 'en')"""

QUERIES = {
    "paragraph_corpus": (paragraph_corpus, _r("""SELECT seq AS page, name AS page_name, illustration_type AS section, currier_language AS language, num AS line_no, par_start, count(*) AS n_words, string_agg(form, ' ' ORDER BY position) AS words
FROM t JOIN l ON l.id = t.locus_id JOIN wp ON wp.id = l.page_id WHERE locus_type LIKE 'P%' AND NOT has_unreadable AND currier_language = 'A' GROUP BY ALL""", True)),
    "held_out_corpus": (held_out_corpus, _r("""SELECT seq AS page, num AS line_no, count(*) AS n_words, string_agg(form, ' ' ORDER BY position) AS words
FROM t JOIN l ON l.id = t.locus_id JOIN hp ON hp.id = l.page_id WHERE locus_type LIKE 'P%' AND NOT has_unreadable GROUP BY ALL""", True)),
    "label_words": (label_words, _r("SELECT seq AS page, illustration_type AS section, form FROM t JOIN l ON l.id = t.locus_id JOIN wp ON wp.id = l.page_id WHERE locus_type LIKE 'L%' AND NOT has_unreadable", True)),
    "working_counts": (working_counts, _r("SELECT (SELECT count(*) FROM wp) AS pages, (SELECT count(*) FROM l WHERE page_id IN (SELECT id FROM wp)) AS loci, count(*) AS tokens, coalesce(sum(glyph_count), 0)::BIGINT AS glyphs FROM t JOIN l ON l.id = t.locus_id WHERE page_id IN (SELECT id FROM wp)", True)),
    "corpus_totals": (corpus_totals, _r("SELECT (SELECT count(*) FROM p) AS pages, (SELECT count(*) FROM l) AS loci, count(*) AS tokens, coalesce(sum(glyph_count), 0)::BIGINT AS glyphs FROM t")),
    "section_crosstab": (section_crosstab, _r("SELECT illustration_type, count(*) FILTER (currier_language = 'A') AS \"A\", count(*) FILTER (currier_language = 'B') AS \"B\", count(*) FILTER (currier_language IS NULL) AS unset, count(*) AS total FROM p GROUP BY 1")),
    "hand_histogram": (hand_histogram, _r("SELECT hand, count(*) AS n FROM p GROUP BY 1")),
    "top_tokens": (top_tokens, _r("SELECT form, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, form LIMIT 30")),
    "top_tokens_by_language": (top_tokens_by_language, f"WITH {LINES_SQL.strip()}\nSELECT corpus, word, n, k::INT AS rank FROM (SELECT corpus, word, n, row_number() OVER (PARTITION BY corpus ORDER BY n DESC, word) AS k FROM typ) WHERE k <= 10"),
    "expected_tokens": (expected_tokens, _r("SELECT form, coalesce(n, 0) AS n, n IS NOT NULL AS present FROM (VALUES ('the'), ('and'), ('der'), ('daiin')) v(form) LEFT JOIN (SELECT form, count(*) AS n FROM t GROUP BY 1) USING (form)")),
    "distinct_types": (distinct_types, _r("SELECT count(DISTINCT form) AS types FROM t")),
    "uncertainty": (uncertainty, _r("SELECT count(*) AS tokens, count(*) FILTER (has_alternative) AS has_alternative, count(*) FILTER (has_ligature) AS has_ligature, count(*) FILTER (has_high_ascii) AS has_high_ascii, count(*) FILTER (has_unreadable) AS has_unreadable FROM t")),
    "holdout_summary": (holdout_summary, _r("SELECT count(DISTINCT doc_id // 2) AS folios, count(*) AS pages, 408 AS seed, '2020-01-01' AS frozen_at FROM documents WHERE doc_id % 7 = 0")),
    "range_verdicts": (range_verdicts, _r("SELECT label, value, 1000::BIGINT AS low, 20000::BIGINT AS high, value BETWEEN 1000 AND 20000 AS ok FROM (SELECT 'pages' AS label, count(*) AS value FROM p UNION ALL SELECT 'loci', count(*) FROM l UNION ALL SELECT 'tokens', count(*) FROM t)")),
    "top_overlap": (top_overlap, f"""WITH {LINES_SQL.strip()}, top AS (SELECT corpus, word FROM (SELECT corpus, word, row_number() OVER (PARTITION BY corpus ORDER BY n DESC, word) AS k FROM typ) WHERE k <= 30)
SELECT coalesce(a.word, b.word) AS word, CASE WHEN a.word IS NULL THEN 'second' WHEN b.word IS NULL THEN 'first' ELSE 'both' END AS side
FROM (SELECT word FROM top WHERE corpus = 'en') a FULL JOIN (SELECT word FROM top WHERE corpus = 'fr') b ON a.word = b.word"""),
    "working_by_folio": (working_by_folio, _r("SELECT id, name, 'f' || (id // 2) AS folio FROM p WHERE 'f' || (id // 2) NOT IN ('f1', 'f5', 'f9')")),
    "leaf_strata": (leaf_strata, _r("SELECT 'f' || (id // 2) AS folio, arg_min(coalesce(illustration_type, '?') || '/' || coalesce(currier_language, '?'), seq) AS stratum FROM p GROUP BY 1")),
    "holdout_draw": (holdout_draw, _HOLDOUT + "\nSELECT stratum, folio FROM chosen"),
    "held_pages": (held_pages, _HOLDOUT + "\nSELECT id, name, 'f' || (id // 2) AS folio FROM p WHERE 'f' || (id // 2) IN (SELECT folio FROM chosen)"),
    "random_draws": (random_draws, "SELECT doc_id, " + ", ".join(f"round({_draw_sql(str(s), 'doc_id')}, 12) AS r{s}" for s in (0, 408, 412, 4294967295)) + " FROM documents"),
    "weighted_picks": (weighted_picks, f"""WITH {LINES_SQL.strip()},
c AS (SELECT glyph, sum(n) OVER (ORDER BY glyph) AS hi, sum(n) OVER () AS total FROM (SELECT glyph, sum(n) AS n FROM (SELECT unnest(string_split(word, '')) AS glyph, n FROM typ WHERE corpus = 'en') GROUP BY glyph)),
d AS (SELECT doc_id, {_draw_sql('411', 'doc_id')} AS r FROM documents)
SELECT doc_id, arg_min(glyph, hi) AS glyph FROM d JOIN c ON hi > r * total::DOUBLE GROUP BY doc_id"""),
    "replicate_seeds": (replicate_seeds, "SELECT doc_id, 501 + doc_id * 5 + doc_id % 5 AS seed FROM documents"),
    "scalar_text": (scalar_text, _r("SELECT p.id, 'f' || (p.id // 2) AS folio, form, regexp_replace(form, '[aeiou]', '', 'g') AS bare, form[1] || regexp_replace(substr(form, 2), '[aeiou]', '', 'g') AS kept, length(form)::BIGINT AS glyphs FROM p LEFT JOIN t ON t.locus_id = p.id * 100000 AND position = 0")),
    "stripped_marks": (stripped_marks, "SELECT doc_id, sha256(strip_accents(lower(text))) AS plain FROM documents"),
    "markup_tokens": (markup_tokens, r"""SELECT doc_id, num, n + x AS tokens, g + 2 * x AS glyphs, n + x - 1 AS last FROM (
  SELECT doc_id, num, (num % 3 = 1)::INT AS x, len(w) AS n, coalesce(list_sum(list_transform(w, lambda q: length(q))), 0)::BIGINT AS g FROM (
  SELECT doc_id, regexp_extract_all(lower(line), '[a-z]+') AS w, num FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS num FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)))) WHERE n + x > 0"""),
    "markup_pages": (markup_pages, "SELECT doc_id, 'f' || doc_id || 'r' AS name, 0::BIGINT AS seq, 'A' AS quire, (doc_id % 3)::VARCHAR AS hand FROM documents"),
    "markup_flags": (markup_flags, """SELECT doc_id, num, i AS position, length(word) + (i % 6 IN (3, 4))::INT AS glyph_count, word || CASE i % 6 WHEN 3 THEN '@123;' WHEN 4 THEN '?' ELSE '' END AS form,
  CASE WHEN i = 0 THEN NULL WHEN i % 3 = 0 THEN '.' WHEN i % 3 = 1 THEN ',' ELSE '-' END AS sep_before, i % 6 = 1 AS has_alternative, i % 6 = 2 AS has_ligature, i % 6 = 3 AS has_high_ascii, i % 6 = 4 AS has_unreadable
FROM (SELECT doc_id, num, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM (SELECT doc_id, num, regexp_extract_all(lower(line), '[a-z]+') AS w
FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS num FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))))"""),
    "markup_hands": (markup_hands, """SELECT doc_id, num, CASE WHEN num < 5 THEN '3' ELSE '7' END AS hand, num % 4 = 1 AS par_start, false AS par_end
FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS num FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"""),
    "markup_errors": (markup_errors, "SELECT doc_id, 4::BIGINT AS line, 'the locus is of another page' AS message FROM documents"),
    "latin_words": (latin_words, f"WITH {_LATIN.strip()}\nSELECT page_id, coalesce(array_to_string(w, ' '), '') AS words FROM lat"),
    "latin_index": (latin_index, f"WITH {_LATIN.strip()}\nSELECT row_number() OVER (ORDER BY page_id, p) - 1 AS idx, word FROM (SELECT page_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM lat)"),
    "enciphered": (enciphered, "WITH RECURSIVE " + _LATIN.strip() + ", letters AS (SELECT list(DISTINCT c ORDER BY c) AS f FROM (SELECT unnest(string_split(word, '')) AS c FROM (SELECT unnest(w) AS word FROM lat))),\n"
        + _permuted_sql("SELECT 0 AS g, f, len(f) AS n, 0 AS start FROM letters", "409")
        + "\nSELECT row_number() OVER (ORDER BY page_id, p) - 1 AS idx, translate(word, (SELECT array_to_string(f, '') FROM letters), (SELECT array_to_string(f, '') FROM done)) AS word FROM (SELECT page_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM lat)"),
    "gibberish": (gibberish, f"""WITH {LINES_SQL.strip()}{_EN},
gl AS (SELECT idx, unnest(string_split(word, '')) AS glyph, unnest(range(0, length(word))) AS i FROM ei),
ix AS (SELECT idx, i, row_number() OVER (ORDER BY idx, i) - 1 AS k FROM gl),
ct AS (SELECT glyph, count(*) AS n, min(idx * 65536 + i) AS seen FROM gl GROUP BY glyph),
iv AS (SELECT glyph, (sum(n) OVER (ORDER BY seen))::BIGINT AS hi, (sum(n) OVER (ORDER BY seen))::BIGINT - n AS lo, (sum(n) OVER ())::DOUBLE AS total FROM ct),
dr AS (SELECT idx, i, {_draw_sql('411', 'k')} * (SELECT any_value(total) FROM iv) AS x FROM ix)
SELECT idx, string_agg(glyph, '' ORDER BY i) AS word FROM dr JOIN iv ON x >= lo AND x < hi GROUP BY idx"""),
    "shuffled_words": (shuffled_words, None),
    "layout": (layout, f"WITH {LINES_SQL.strip()}{_EN}\nSELECT page, line_no, par_start, len(words) AS word_count, coalesce(s, -1) AS start, array_to_string(list_transform(words, lambda w: length(w)::VARCHAR), ',') AS lengths FROM lines LEFT JOIN (SELECT page, line_no, min(idx) AS s FROM ei GROUP BY ALL) USING (page, line_no) WHERE corpus = 'en'"),
    "poured": (poured, f"WITH {LINES_SQL.strip()}{_EN}, bk AS (SELECT (SELECT max(idx) FROM ei) - idx AS idx, word FROM ei)\nSELECT page, line_no, par_start, string_agg(bk.word, ' ' ORDER BY pos) AS words FROM ei JOIN bk USING (idx) GROUP BY ALL"),
    "control_signatures": (control_signatures, None),
}
