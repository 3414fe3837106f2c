"""The driver's tables in the shape of the engine's relations.

A document is a page (seq and id doc_id, section its source, language lang), its
newline-separated lines are loci, and every fourth line starts a paragraph. Words
are runs of a-z in the lowered line. For relations with flags, the character after a
word tells: ``?`` unreadable, ``,`` alternative reading, ``!`` ligature, ``;`` an
extended code; the first line of a document is a label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A table of fewer bytes may be one row group, that is one task; it is dealt to all cores.
SMALL_BYTES = 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_BYTES
    return df.repartition(spark.sparkContext.defaultParallelism) if small else df


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def document_lines(spark: SparkSession, sf_dir: str, corpus: str = "lang") -> DataFrame:
    """corpus (a column of ``documents``), page, section, language, line_no, par_start and words of every line."""
    docs = table(spark, sf_dir, "documents").select(
        F.coalesce(F.col(corpus).cast("string"), F.lit("?")).alias("corpus"), F.col("doc_id").alias("page"), F.coalesce("source", F.lit("?")).alias("section"),
        F.coalesce("lang", F.lit("?")).alias("language"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"),
    )
    return docs.select("corpus", "page", "section", "language", "line_no", (F.col("line_no") % 4 == 0).alias("par_start"), words_of(F.col("line")).alias("words"))


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of ``conversations`` as lines: a second corpus."""
    turns = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    return turns.select(F.lit("talk").alias("corpus"), F.col("conv_id").alias("page"), F.col("turn").cast("int").alias("line_no"), (F.col("turn") == 0).alias("par_start"), words_of(F.col("text")).alias("words"))


def relations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """pages, loci and tokens with the engine's columns."""
    docs = table(spark, sf_dir, "documents")
    pages = docs.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("f"), F.floor(F.col("doc_id") / 2).cast("string"), F.when(F.col("doc_id") % 2 == 0, "r").otherwise("v")).alias("name"),
        F.col("doc_id").alias("seq"), F.col("source").alias("illustration_type"), F.when(F.col("lang") == "en", "A").when(F.col("lang") == "fr", "B").alias("currier_language"),
        (F.col("doc_id") % 5).cast("string").alias("hand"),
    )
    loci = docs.select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw_text"))
    loci = loci.select(
        (F.col("page_id") * 100_000 + F.col("line_no")).alias("id"), "page_id", (F.col("line_no") + 1).alias("num"),
        F.when(F.col("line_no") == 0, "Lf").when(F.col("line_no") % 4 == 0, "P1").otherwise("P0").alias("locus_type"),
        (F.col("line_no") % 4 == 0).alias("par_start"), (F.col("line_no") % 4 == 3).alias("par_end"), "raw_text",
    )
    raw = loci.select(F.col("id").alias("locus_id"), F.posexplode(F.regexp_extract_all(F.lower("raw_text"), F.lit("[a-z]+[?,!;]?"), F.lit(0))).alias("position", "raw"))
    mark = F.substring("raw", -1, 1)
    tokens = raw.select(
        "locus_id", "position", F.regexp_extract("raw", "[a-z]+", 0).alias("form"), F.length(F.regexp_extract("raw", "[a-z]+", 0)).alias("glyph_count"),
        (mark == ",").alias("has_alternative"), (mark == "!").alias("has_ligature"), (mark == ";").alias("has_high_ascii"), (mark == "?").alias("has_unreadable"),
    )
    return {"pages": pages, "loci": loci, "tokens": tokens}


#: The same for DuckDB: CTEs ``lines`` and ``tok``.
LINES_SQL = r"""
lines AS (
  SELECT lang AS corpus, doc_id AS page, source AS section, lang AS language, line_no, line_no % 4 = 0 AS par_start,
         regexp_extract_all(lower(line), '[a-z]+') AS words
  FROM (SELECT doc_id, source, lang, unnest(l) AS line, unnest(range(0, len(l))) AS line_no
        FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
tok AS (SELECT corpus, page, section, language, line_no, par_start, len(words) AS n_words, unnest(words) AS word, unnest(range(0, len(words))) AS pos FROM lines),
typ AS (SELECT corpus, word, count(*) AS n, count(*) FILTER (pos = 0) AS n_first, count(*) FILTER (pos = n_words - 1) AS n_last FROM tok GROUP BY ALL)"""

#: CTEs ``p``, ``l`` and ``t``: the relations.
RELATIONS_SQL = r"""
p AS (SELECT doc_id AS id, 'f' || (doc_id // 2) || CASE WHEN doc_id % 2 = 0 THEN 'r' ELSE 'v' END AS name, doc_id AS seq, source AS illustration_type,
      CASE lang WHEN 'en' THEN 'A' WHEN 'fr' THEN 'B' END AS currier_language, (doc_id % 5)::VARCHAR AS hand FROM documents),
l AS (SELECT doc_id * 100000 + line_no AS id, doc_id AS page_id, line_no + 1 AS num, CASE WHEN line_no = 0 THEN 'Lf' WHEN line_no % 4 = 0 THEN 'P1' ELSE 'P0' END AS locus_type,
      line_no % 4 = 0 AS par_start, line AS raw_text
      FROM (SELECT doc_id, unnest(x) AS line, unnest(range(0, len(x))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL))),
t AS (SELECT locus_id, position, regexp_extract(raw, '[a-z]+') AS form, length(regexp_extract(raw, '[a-z]+')) AS glyph_count,
      raw LIKE '%,' AS has_alternative, raw LIKE '%!' AS has_ligature, raw LIKE '%;' AS has_high_ascii, raw LIKE '%?' AS has_unreadable
      FROM (SELECT id AS locus_id, unnest(x) AS raw, unnest(range(0, len(x))) AS position FROM (SELECT id, regexp_extract_all(lower(raw_text), '[a-z]+[?,!;]?') AS x FROM l)))"""
