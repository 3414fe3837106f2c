"""Statistics of tokenised corpora, each a plan over one frame of lines.

``lines`` has the group columns (``by``, never null; by default ``corpus``), ``page``
and ``line_no`` (integers that give the reading order), ``par_start`` and ``words``
(array of strings). Whatever depends on words alone is computed from distinct words
weighted by their counts, so that glyphs are only ever split once a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom import policy
from lexiloom.functions.prefix import totals_before
from lexiloom.functions.text import glyph_count, glyphs, recoded
from lexiloom.scratch import staged

CORPUS = ["corpus"]
#: Ranks made by one row of a frequency; tokens of one block of the reading order.
RANK_BLOCK, INDEX_BLOCK = 65_536, 1 << 20


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b as a double; ``empty`` where b is 0 or there is none."""
    return F.when(F.coalesce(b, F.lit(0)) != 0, a.cast("double") / b).otherwise(F.lit(empty))


def tokens(lines: DataFrame, by: list[str] = CORPUS) -> DataFrame:
    """A row a word: the group, page, line_no, par_start, n_words, pos and word."""
    return lines.select(*by, "page", "line_no", "par_start", F.size("words").alias("n_words"), F.posexplode("words").alias("pos", "word"))


def types(lines: DataFrame, by: list[str] = CORPUS, least: int = 3) -> DataFrame:
    """Distinct words with n and where they stand, in one pass over the tokens.

    n_first and n_last begin and end a line; long_n, long_first, long_inner and
    long_last stand in lines of at least ``least`` words; start_n stand in lines that
    start a paragraph, start_first begin one.
    """
    first, last, long = F.col("pos") == 0, F.col("pos") == F.col("n_words") - 1, F.col("n_words") >= least
    return tokens(lines, by).groupBy(*by, "word").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(first).alias("n_first"), F.count_if(last).alias("n_last"),
        F.count_if(long).alias("long_n"), F.count_if(long & first).alias("long_first"), F.count_if(long & ~first & ~last).alias("long_inner"), F.count_if(long & last).alias("long_last"),
        F.count_if("par_start").alias("start_n"), F.count_if(F.col("par_start") & first).alias("start_first"),
    )


def entropy(counts: DataFrame, by: list[str], n: str = "n", out: str = "entropy") -> DataFrame:
    """Shannon entropy in bits of each group's counts; zeros do not matter, negative counts raise."""
    c = F.when(F.col(n) >= 0, F.col(n)).otherwise(F.raise_error(F.lit("negative count")).cast("long"))
    terms = F.sum(F.when(c > 0, c * F.log2(F.greatest(c, F.lit(1)))).otherwise(0.0))
    total = F.sum(c)
    value = F.when(total > 0, F.greatest(F.log2(total.cast("double")) - terms / total, F.lit(0.0))).otherwise(0.0)
    return counts.groupBy(*by).agg(value.alias(out))


def glyph_counts(kinds: DataFrame, by: list[str] = CORPUS, separator: str | None = policy.SEPARATOR) -> DataFrame:
    """glyph and n of the streams of glyphs, in which a separator stands between words of a line."""
    inner = kinds.select(*by, F.explode(glyphs(F.col("word"))).alias("glyph"), "n")
    if separator is not None:
        gaps = kinds.select(*by, F.lit(separator).alias("glyph"), (F.col("n") - F.col("n_first")).alias("n"))
        inner = inner.unionByName(gaps.filter("n > 0"))
    return inner.groupBy(*by, "glyph").agg(F.sum("n").alias("n"))


def glyph_pairs(kinds: DataFrame, by: list[str] = CORPUS, separator: str = policy.SEPARATOR) -> DataFrame:
    """first, second and n of neighbours in the streams: inside words, and across the separator."""
    g = kinds.withColumn("g", glyphs(F.col("word"))).filter(F.size("g") > 0)
    at = F.sequence(F.lit(1), F.size("g") - 1)
    inside = g.filter(F.size("g") > 1).select(*by, F.explode(F.transform(at, lambda i: F.struct(F.element_at("g", i).alias("first"), F.element_at("g", i + 1).alias("second")))).alias("p"), "n")
    inside = inside.select(*by, "p.first", "p.second", "n")
    after = g.select(*by, F.element_at("g", -1).alias("first"), F.lit(separator).alias("second"), (F.col("n") - F.col("n_last")).alias("n"))
    before = g.select(*by, F.lit(separator).alias("first"), F.element_at("g", 1).alias("second"), (F.col("n") - F.col("n_first")).alias("n"))
    return inside.unionByName(after.filter("n > 0")).unionByName(before.filter("n > 0")).groupBy(*by, "first", "second").agg(F.sum("n").alias("n"))


def entropies(kinds: DataFrame, by: list[str] = CORPUS, separator: str = policy.SEPARATOR) -> DataFrame:
    """h0, h1 and h2 of the streams; h2 is that of pairs less that of their first members.

    Single glyphs are pairs without a second member here, so that one table of
    counts, summed twice more, gives all three.
    """
    k = kinds.select(*by, "n", "n_first", "n_last", glyphs(F.col("word")).alias("g"))
    entry = lambda first, second, n: F.struct(first.alias("first"), second.alias("second"), n.alias("n"))
    none, gap, n = F.lit(None).cast("string"), F.lit(separator), F.col("n")
    opens, closes = n - F.col("n_first"), n - F.col("n_last")
    size = F.size("g")
    rows = F.concat(
        F.transform("g", lambda x: entry(x, none, n)), F.array(entry(gap, none, opens)),
        F.when(size > 1, F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: entry(F.get("g", i - 1), F.get("g", i), n))).otherwise(F.array()),
        F.when(size > 0, F.array(entry(F.get("g", size - 1), gap, closes), entry(gap, F.get("g", F.lit(0)), opens))).otherwise(F.array()),
    )
    counts = k.select(*by, F.inline(rows)).filter("n > 0").groupBy(*by, "first", "second").agg(F.sum("n").alias("n"))
    bits = lambda c: c * F.log2(c.cast("double"))
    firsts = counts.groupBy(*by, F.col("second").isNull().alias("single"), "first").agg(F.sum("n").alias("n"), F.sum(bits(n)).alias("terms"))
    only = lambda c, v: F.sum(F.when(c, v))
    single, pair = F.col("single"), ~F.col("single")
    of = lambda total, terms: F.log2(total.cast("double")) - terms / total
    h1 = of(only(single, n), only(single, F.col("terms")))
    h2 = of(only(pair, n), only(pair, F.col("terms"))) - of(only(pair, n), only(pair, bits(n)))
    least = lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0))
    return firsts.groupBy(*by).agg(F.log2(F.count_if(single).cast("double")).alias("h0"), least(h1).alias("h1"), least(h2).alias("h2"))


def zipf(kinds: DataFrame, by: list[str] = CORPUS, least: int = policy.ZIPF_MIN_FREQ) -> DataFrame:
    """Least squares of log2 frequency on log2 rank: slope, intercept, r2 and the number of ranks.

    Types of one frequency have consecutive ranks, which are counted from the table
    of frequencies; no task sorts the types. With fewer than two ranks the slope and
    r2 are 0; with equal frequencies r2 is 1.
    """
    freq = kinds.filter(F.col("n") >= least).groupBy(*by, "n").agg(F.count(F.lit(1)).alias("c"))
    above = Window.partitionBy(*by).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    freq = freq.withColumn("off", F.coalesce(F.sum("c").over(above), F.lit(0).cast("long")))
    starts = freq.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1, F.lit(RANK_BLOCK).cast("long"))))
    ranks = starts.withColumn("r", F.explode(F.sequence(F.col("s"), F.least(F.col("c"), F.col("s") + RANK_BLOCK) - 1)))
    x, y = F.log2((F.col("off") + F.col("r") + 1).cast("double")), F.log2(F.col("n").cast("double"))
    fit = ranks.groupBy(*by).agg(F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"), F.regr_r2(y, x).alias("r"), F.count(F.lit(1)).alias("zipf_ranks"), F.max(y).alias("y0"))
    few = F.col("zipf_ranks") < 2
    zero = F.lit(0.0)
    return fit.select(
        *by, F.when(few, zero).otherwise(F.coalesce("s", zero)).alias("zipf_slope"), F.when(few, F.col("y0")).otherwise(F.coalesce("i", zero)).alias("zipf_intercept"),
        F.when(few, zero).otherwise(F.coalesce("r", F.lit(1.0))).alias("zipf_r2"), "zipf_ranks",
    )


def lengths(kinds: DataFrame, by: list[str] = CORPUS) -> DataFrame:
    """length and n: the histogram of word lengths in glyphs."""
    return kinds.groupBy(*by, glyph_count(F.col("word")).cast("long").alias("length")).agg(F.sum("n").alias("n"))


def length_stats(kinds: DataFrame, by: list[str] = CORPUS) -> DataFrame:
    """length_mean, length_sd (population), length_mode (the smallest of those most frequent) and glyphs."""
    h = lengths(kinds, by)
    n, s, q = F.sum("n"), F.sum(F.col("n") * F.col("length")), F.sum(F.col("n") * F.col("length") * F.col("length"))
    mode = F.max(F.struct("n", (-F.col("length")).alias("m")))
    out = h.groupBy(*by).agg(n.alias("tokens"), s.alias("glyphs"), q.alias("q"), mode.alias("mode"))
    spread = F.sqrt(F.greatest((F.col("tokens") * F.col("q") - F.col("glyphs") * F.col("glyphs")).cast("double"), F.lit(0.0))) / F.col("tokens")
    return out.select(*by, (F.col("glyphs") / F.col("tokens")).alias("length_mean"), spread.alias("length_sd"), (-F.col("mode.m")).alias("length_mode"), "glyphs")


def vocabulary(kinds: DataFrame, by: list[str] = CORPUS) -> DataFrame:
    """tokens, types, type-token ratio, types of one occurrence and their share of the types."""
    once = F.count_if(F.col("n") == 1)
    return kinds.groupBy(*by).agg(
        F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types"), (F.count(F.lit(1)) / F.sum("n")).alias("ttr"), once.alias("hapaxes"), (once / F.count(F.lit(1))).alias("hapax_rate"),
    )


def indexed(lines: DataFrame, by: list[str] = CORPUS) -> DataFrame:
    """``tokens`` with idx, the place in reading order, from 0 without gaps."""
    t = tokens(lines, by)
    pages = lines.groupBy(*by, "page").agg(F.sum(F.size("words")).alias("c"))
    pages = totals_before(pages, by, "page", "c", "_page").drop("c")
    inside = Window.partitionBy(*by, "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.size("words")).over(inside), F.lit(0))
    starts = lines.select(*by, "page", "line_no", "par_start", "words", before.alias("_line")).join(pages, [*by, "page"])
    out = starts.select(*by, "page", "line_no", "par_start", F.size("words").alias("n_words"), (F.col("_page") + F.col("_line")).alias("_at"), F.posexplode("words").alias("pos", "word"))
    return out.select(*t.columns, (F.col("_at") + F.col("pos")).cast("long").alias("idx"))


def mattr(lines: DataFrame, by: list[str] = CORPUS, window: int = policy.MATTR_WINDOW) -> DataFrame:
    """Mean share of distinct words over all windows of ``window`` tokens; over the whole if it is no longer.

    A token is the first of its word in as many windows as start after the word's
    last occurrence and still hold it. That occurrence matters only if it is less
    than a window away, so that it is looked for in the token's own block of the
    reading order, to which the last tokens of the block before are added: no word is
    gathered as a whole. In a corpus of one window or less every first occurrence is
    one at all, and such a corpus lies in one block.
    """
    if window <= 0:
        raise ValueError("the window must be positive")
    size = max(INDEX_BLOCK, 2 * window)
    at = indexed(lines, by).select(*by, "word", "idx").withColumn("own", F.floor(F.col("idx") / size).cast("long"))
    late = F.pmod("idx", F.lit(size)) >= size - window
    at = at.withColumn("block", F.explode(F.when(late, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))
    prev = F.coalesce(F.lag("idx").over(Window.partitionBy(*by, "word", "block").orderBy("idx")), F.lit(-1))
    at = at.withColumn("prev", prev).filter("own = block")
    whole = lines.groupBy(*by).agg(F.sum(F.size("words")).cast("long").alias("size"))
    w = F.lit(window).cast("long")
    at = at.join(F.broadcast(whole), by)  # a row a corpus
    first_start = F.greatest(F.col("prev") + 1, F.col("idx") - w + 1, F.lit(0))
    starts = F.greatest(F.lit(0), F.least("idx", F.col("size") - w) - first_start + 1)
    out = at.groupBy(*by).agg(F.sum(starts).alias("hits"), F.max("size").alias("size"), F.count_if(F.col("prev") < 0).alias("firsts"))
    long = F.col("size") > w
    return out.select(*by, F.when(long, F.col("hits") / (w * (F.col("size") - w + 1))).otherwise(F.col("firsts") / F.col("size")).alias("mattr"))


def positions(kinds: DataFrame, by: list[str] = CORPUS, bins: int = policy.POSITION_BINS) -> DataFrame:
    """For each glyph total, initial and final counts, and counts in ``bins`` bins of the word (bin0 ...)."""
    if bins <= 0:
        raise ValueError("bins must be positive")
    g = kinds.select(*by, "n", F.size(glyphs(F.col("word"))).alias("len"), F.posexplode(glyphs(F.col("word"))).alias("i", "glyph"))
    place = F.when(F.col("len") == 1, 0).otherwise(F.least(F.lit(bins - 1), F.floor(F.col("i") / F.greatest(F.col("len") - 1, F.lit(1)) * bins)))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    return g.withColumn("b", place).groupBy(*by, "glyph").agg(
        F.sum("n").alias("total"), count(F.col("i") == 0).alias("initial"), count(F.col("i") == F.col("len") - 1).alias("final"),
        *[count(F.col("b") == k).alias(f"bin{k}") for k in range(bins)],
    )


def follow(kinds: DataFrame, glyph: str, then: str, by: list[str] = CORPUS) -> DataFrame:
    """occurrences of ``glyph``, how many are followed by ``then`` in the word, and the ratio."""
    g = kinds.select(*by, "n", glyphs(F.col("word")).alias("g")).select(*by, "n", "g", F.posexplode("g").alias("i", "c")).filter(F.col("c") == glyph)
    hit = F.get("g", F.col("i") + 1) == then
    return g.groupBy(*by).agg(F.sum("n").alias("occurrences"), F.sum(F.when(hit, F.col("n")).otherwise(0)).cast("long").alias("followed")).withColumn("ratio", ratio(F.col("followed"), F.col("occurrences")))


def top_shares(counts: DataFrame, key: str, by: list[str] = CORPUS, n: int = policy.TOP_GLYPHS) -> DataFrame:
    """The ``n`` most frequent keys of each group with their share of all; ties by key."""
    whole = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), key))
    return counts.withColumn("rank", nth).filter(F.col("rank") <= n).join(F.broadcast(whole), by).select(*by, "rank", key, "n", ratio(F.col("n"), F.col("_all")).alias("share"))


def initial_share(kinds: DataFrame, glyph: str = "q", by: list[str] = CORPUS) -> DataFrame:
    """How much of a glyph stands first in its word; 0 without any."""
    p = positions(kinds, by, 1).filter(F.col("glyph") == glyph).select(*by, ratio(F.col("initial"), F.col("total")).alias("share"))
    return kinds.select(*by).distinct().join(p, by, "left").fillna(0.0, ["share"])


def gallows(lines: DataFrame, by: list[str] = CORPUS, marks=policy.GALLOWS) -> DataFrame:
    """Shares of lines whose first glyph is one of ``marks``, at paragraph starts and elsewhere, and their ratio."""
    return gallows_of(types(lines, by), by, marks)


def gallows_of(kinds: DataFrame, by: list[str] = CORPUS, marks=policy.GALLOWS) -> DataFrame:
    """:func:`gallows` from the table of types."""
    first = kinds.filter("n_first > 0").select(*by, F.col("start_first").alias("s"), (F.col("n_first") - F.col("start_first")).alias("o"), F.coalesce(F.get(glyphs(F.col("word")), F.lit(0)).isin(*marks), F.lit(False)).alias("hit"))
    hits = lambda c: F.sum(F.when(F.col("hit"), F.col(c)).otherwise(0)).cast("long")
    out = first.groupBy(*by).agg(hits("s").alias("start_hits"), F.sum("s").alias("start_lines"), hits("o").alias("other_hits"), F.sum("o").alias("other_lines"))
    out = out.withColumn("start_share", ratio(F.col("start_hits"), F.col("start_lines"))).withColumn("other_share", ratio(F.col("other_hits"), F.col("other_lines")))
    contrast = F.when(F.col("other_share") > 0, ratio(F.col("start_share"), F.col("other_share"))).when(F.col("start_share") > 0, F.lit(float("inf"))).otherwise(0.0)
    return out.withColumn("contrast", contrast)


def distance(a: Column, b: Column) -> Column:
    """Edits from one word to the other, in glyphs."""
    return F.levenshtein(recoded(a), recoded(b))


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / length of the longer word; 1 for two empty words."""
    longest = F.greatest(glyph_count(a), glyph_count(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - distance(a, b) / longest)


def neighbours(lines: DataFrame, by: list[str] = CORPUS) -> DataFrame:
    """Pairs of neighbours in a line, with how often they occur; the distance is taken once a pair."""
    n = F.size("words")
    pairs = F.arrays_zip(F.slice("words", F.lit(1), n - 1).alias("a"), F.slice("words", F.lit(2), n - 1).alias("b"))
    flat = lines.filter(n > 1).select(*by, F.explode(pairs).alias("p")).select(*by, F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    pairs = flat.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("d", distance(F.col("a"), F.col("b"))).withColumn("similarity", 1 - F.col("d") / F.greatest(glyph_count(F.col("a")), glyph_count(F.col("b")), F.lit(1)))


def adjacent(lines: DataFrame, by: list[str] = CORPUS) -> DataFrame:
    """pairs of neighbours, shares of equal ones and of those one edit apart, and their mean similarity."""
    p = neighbours(lines, by)
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    out = p.groupBy(*by).agg(F.sum("n").alias("pairs"), count(F.col("d") == 0).alias("identical"), count(F.col("d") == 1).alias("distance1"), F.sum(F.col("n") * F.col("similarity")).alias("s"))
    return out.select(*by, "pairs", "identical", "distance1", (F.col("identical") / F.col("pairs")).alias("identical_share"), (F.col("distance1") / F.col("pairs")).alias("distance1_share"), (F.col("s") / F.col("pairs")).alias("mean_similarity"))


def total_variation(counts: DataFrame, by: list[str], p: str, q: str, out: str = "tv") -> DataFrame:
    """Half the sum of differences of two distributions, given as counts side by side; 0 if one is empty."""
    whole = counts.groupBy(*by).agg(F.sum(p).alias("_p"), F.sum(q).alias("_q"))
    # Totals come first; the keys of one group are never gathered.
    each = counts.join(F.broadcast(whole), by)
    gap = F.abs(ratio(F.col(p), F.col("_p")) - ratio(F.col(q), F.col("_q")))
    return each.groupBy(*by).agg(F.when((F.max("_p") > 0) & (F.max("_q") > 0), F.sum(gap) / 2).otherwise(0.0).alias(out))


def line_effects(lines: DataFrame, by: list[str] = CORPUS, least: int = 3) -> DataFrame:
    """Mean lengths of first, inner and last words of lines of at least ``least`` words, with counts."""
    return effects_of(types(lines, by, least), by)


def effects_of(kinds: DataFrame, by: list[str] = CORPUS) -> DataFrame:
    """:func:`line_effects` from the table of types."""
    k = kinds.filter("long_n > 0").withColumn("len", glyph_count(F.col("word")))
    mean = lambda c: ratio(F.sum(F.col(c) * F.col("len")), F.sum(c))
    return k.groupBy(*by).agg(
        mean("long_first").alias("first_mean"), mean("long_inner").alias("inner_mean"), mean("long_last").alias("last_mean"), F.sum("long_first").alias("lines"), F.sum("long_inner").alias("inner_count"),
    )


def line_profile(lines: DataFrame, by: list[str] = CORPUS, least: int = 5) -> DataFrame:
    """Mean lengths of first, second, middle, last but one and last words of lines of at least ``least`` words."""
    t = tokens(lines, by).filter(F.col("n_words") >= least).withColumn("len", glyph_count(F.col("word")))
    from_end = F.col("n_words") - F.col("pos")
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("len"))), F.lit(0.0))
    return t.groupBy(*by).agg(
        mean(F.col("pos") == 0).alias("first"), mean(F.col("pos") == 1).alias("second"), mean((F.col("pos") > 1) & (from_end > 2)).alias("middle"),
        mean(from_end == 2).alias("penultimate"), mean(from_end == 1).alias("last"), F.count_if(F.col("pos") == 0).alias("lines"),
    )


def edge_glyphs(lines: DataFrame, by: list[str] = CORPUS, least: int = 3) -> DataFrame:
    """For each glyph how often it ends a line's last word or another word, and begins its first word or another."""
    return edges_of(types(lines, by, least), by)


def edges_of(kinds: DataFrame, by: list[str] = CORPUS) -> DataFrame:
    """:func:`edge_glyphs` from the table of types."""
    g = kinds.filter("long_n > 0 AND word <> ''").withColumn("g", glyphs(F.col("word")))
    zero, rest = F.lit(0).cast("long"), lambda c: F.col("long_n") - F.col(c)
    sides = F.array(
        F.struct(F.element_at("g", -1).alias("glyph"), F.col("long_last").alias("line_end"), rest("long_last").alias("other_end"), zero.alias("line_start"), zero.alias("other_start")),
        F.struct(F.element_at("g", 1).alias("glyph"), zero.alias("line_end"), zero.alias("other_end"), F.col("long_first").alias("line_start"), rest("long_first").alias("other_start")),
    )
    four = ("line_end", "other_end", "line_start", "other_start")
    return g.select(*by, F.explode(sides).alias("e")).select(*by, "e.*").groupBy(*by, "glyph").agg(*[F.sum(c).alias(c) for c in four])


def edge_divergence(lines: DataFrame, by: list[str] = CORPUS) -> DataFrame:
    """Total variation of final glyphs at line ends and elsewhere, and of initial glyphs at line starts and elsewhere."""
    return divergence_of(edge_glyphs(lines, by), by)


def divergence_of(edges: DataFrame, by: list[str] = CORPUS) -> DataFrame:
    """:func:`edge_divergence` from the table of edge glyphs, a row a glyph."""
    four = ("line_end", "other_end", "line_start", "other_start")
    whole = edges.groupBy(*by).agg(*[F.sum(c).alias(f"_{c}") for c in four])
    each = edges.join(F.broadcast(whole), by)  # a row a corpus
    gap = lambda p, q: F.when((F.max(f"_{p}") > 0) & (F.max(f"_{q}") > 0), F.sum(F.abs(ratio(F.col(p), F.col(f"_{p}")) - ratio(F.col(q), F.col(f"_{q}")))) / 2).otherwise(0.0)
    return each.groupBy(*by).agg(gap("line_end", "other_end").alias("end_divergence"), gap("line_start", "other_start").alias("start_divergence"))


def top_edges(edges: DataFrame, by: list[str] = CORPUS, edge: str = "line_end", other: str = "other_end", least: int = 20, n: int = 8) -> DataFrame:
    """Glyphs of at least ``least`` edge occurrences by the ratio of their shares at the edge and elsewhere."""
    whole = edges.groupBy(*by).agg(F.sum(edge).alias("_e"), F.sum(other).alias("_o"))
    rows = edges.join(F.broadcast(whole), by).select(*by, "glyph", F.col(edge).alias("edge"), F.col(other).alias("other"), ratio(F.col(edge), F.col("_e")).alias("edge_share"), ratio(F.col(other), F.col("_o")).alias("other_share"))
    rows = rows.withColumn("ratio", F.when(F.col("other_share") > 0, ratio(F.col("edge_share"), F.col("other_share"))).otherwise(F.lit(float("inf"))))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ratio"), "glyph"))
    return rows.filter(F.col("edge") >= least).withColumn("rank", nth).filter(F.col("rank") <= n)


def paragraph_lines(lines: DataFrame, by: list[str] = CORPUS) -> DataFrame:
    """Mean word length of lines that start a paragraph and of others, and the total variation of initial glyphs."""
    return paragraphs_of(types(lines, by), by)


def paragraphs_of(kinds: DataFrame, by: list[str] = CORPUS) -> DataFrame:
    """:func:`paragraph_lines` from the table of types; sums by initial glyph give both."""
    k = kinds.filter("word <> ''").select(*by, F.col("start_n").alias("s"), (F.col("n") - F.col("start_n")).alias("o"), glyphs(F.col("word")).alias("g"))
    initials = k.groupBy(*by, F.get("g", F.lit(0)).alias("glyph")).agg(F.sum("s").alias("s"), F.sum("o").alias("o"), F.sum(F.col("s") * F.size("g")).alias("sl"), F.sum(F.col("o") * F.size("g")).alias("ol"))
    means = initials.groupBy(*by).agg(ratio(F.sum("sl"), F.sum("s")).alias("start_mean"), ratio(F.sum("ol"), F.sum("o")).alias("other_mean"))
    return means.withColumn("delta", F.col("start_mean") - F.col("other_mean")).join(total_variation(initials, by, "s", "o", "initial_tv"), by)


def signature(lines: DataFrame, by: list[str] = CORPUS, window: int = policy.MATTR_WINDOW, least: int = policy.ZIPF_MIN_FREQ) -> DataFrame:
    """The whole battery: one row a group.

    The lines are written once, and so is the table of their types, from which all
    but the moving ratio and the neighbours derive: a plan of ten branches over the
    raw input would cost more to make than to run.
    """
    lines = staged(lines.select(*by, "page", "line_no", "par_start", "words"), "signature-lines")
    kinds = staged(types(lines, by), "signature-types")
    edges = staged(edges_of(kinds, by), "signature-edges")
    base = vocabulary(kinds, by)
    start = gallows_of(kinds, by).select(*by, F.col("start_share").alias("gallows_start"), F.col("other_share").alias("gallows_other"), F.col("contrast").alias("gallows_contrast"))
    effects = effects_of(kinds, by).select(*by, (F.col("first_mean") - F.col("inner_mean")).alias("first_effect"), (F.col("last_mean") - F.col("inner_mean")).alias("last_effect"))
    parts = [
        length_stats(kinds, by), entropies(kinds, by), zipf(kinds, by, least), mattr(lines, by, window), start,
        initial_share(kinds, "q", by).withColumnRenamed("share", "q_initial"), adjacent(lines, by).drop("identical", "distance1"), effects, divergence_of(edges, by),
        paragraphs_of(kinds, by).select(*by, F.col("delta").alias("paragraph_delta"), F.col("initial_tv").alias("paragraph_tv")),
    ]
    for part in parts:
        base = base.join(part, by, "left")
    numbers = [c for c, t in base.dtypes if t in ("double", "bigint") and c not in by]
    return base.fillna(0, numbers)
