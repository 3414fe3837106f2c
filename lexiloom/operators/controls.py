"""Control corpora: other words in the layout of a reference corpus."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom import policy
from lexiloom.functions.prefix import totals_before
from lexiloom.functions.prng import Picker, Stream, draws_at, permutation, permuted, quick
from lexiloom.functions.text import glyph_count, glyphs, strip_marks
from lexiloom.operators import stats
from lexiloom.scratch import staged

#: Words of one Arrow batch.
BATCH = 1 << 16
#: Stands between the words of a line on their way to a worker.
BETWEEN = "\0"
#: The site navigation that stands in the pages of the Latin source.
NAVIGATION = ("The Latin Library", "The Classics Page", "The Christian Latin Pages", "Christian Latin")


def glyph_list(word: str) -> list[str]:
    """The glyphs of a word; ``@nnn;`` is one."""
    if "@" not in word:
        return list(word)
    out, at = [], 0
    while at < len(word):
        n = 5 if word[at] == "@" and word[at + 1 : at + 4].isdigit() and word[at + 4 : at + 5] == ";" else 1
        out.append(word[at : at + n])
        at += n
    return out


def latin_words(html: Column) -> Column:
    """The words a-z of a page: from the first "[1]" on if there is one, without scripts, styles, tags, navigation and marks."""
    text = html
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"<[^>]*>"):
        text = F.regexp_replace(text, pattern, " ")
    text = F.when(text.contains("[1]"), text.substr(F.instr(text, "[1]"), F.length(text))).otherwise(text)
    for phrase in NAVIGATION:
        text = F.replace(text, F.lit(phrase), F.lit(" "))
    text = F.replace(F.replace(F.lower(text), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))
    return F.regexp_extract_all(strip_marks(text), F.lit("[a-z]+"), F.lit(0))


def latin(pages: DataFrame, html: str = "html", order: str = "page_id") -> DataFrame:
    """idx and word of all words of ``pages`` in order; idx has no gaps."""
    return stats.indexed(latin_lines(pages, html, order)).select("idx", "word")


def latin_lines(pages: DataFrame, html: str = "html", order: str = "page_id") -> DataFrame:
    """The words of each page as a line."""
    return pages.select(F.lit("latin").alias("corpus"), F.col(order).alias("page"), F.lit(0).alias("line_no"), F.lit(False).alias("par_start"), latin_words(F.col(html)).alias("words")).filter("words IS NOT NULL")


def substitution(words: DataFrame, seed: int = policy.CIPHER_SEED) -> tuple[str, str]:
    """The letters that occur, sorted, and a seeded permutation of them."""
    letters = [r["c"] for r in words.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().orderBy("c").collect()]  # an alphabet
    order = permutation(len(letters), Stream(seed))
    return "".join(letters), "".join(letters[k] for k in order)


def encipher(word: Column, plain: str, cipher: str) -> Column:
    """Each letter by its substitute; a letter without one raises."""
    known = F.translate(word, plain, "") == ""
    return F.when(known, F.translate(word, plain, cipher)).otherwise(F.raise_error(F.concat(F.lit("no substitute in "), word)).cast("string"))


def shuffled(words: DataFrame, seed: int = policy.SHUFFLE_SEED, count: DataFrame | None = None) -> DataFrame:
    """``words`` (idx, word) in a seeded order; ``count`` has their number n, where it comes without making them.

    The chain of exchanges is made over indices alone, by one task, and joined
    back by position; see the README for the size it suits.
    """

    def run(batches):
        order = permuted(sum(sum(b.column("n").to_pylist()) for b in batches), seed)
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(part))), pa.array(part)], ["idx", "src"])

    # One row counts the words, by which Spark would take the order for small and send it all through the driver.
    count = words.agg(F.count(F.lit(1)).alias("n")) if count is None else count
    order = count.coalesce(1).mapInArrow(run, "idx long, src long").hint("merge")
    return order.join(words.withColumnRenamed("idx", "src"), "src").select("idx", "word")


def glyph_intervals(words: DataFrame) -> DataFrame:
    """glyph, n, lo and hi: glyphs in order of first appearance with their shares of [0, n) by weight; ``words`` has idx and word."""
    kinds = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("idx"))
    counts = kinds.select("idx", "n", F.posexplode(glyphs(F.col("word"))).alias("i", "glyph")).groupBy("glyph").agg(F.sum("n").alias("n"), F.min(F.struct("idx", "i")).alias("at"))
    upto = Window.partitionBy(F.lit(0)).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # a row a glyph
    return counts.withColumn("hi", F.sum("n").over(upto)).withColumn("lo", F.col("hi") - F.col("n"))


def pick(at: Column, table: list[tuple[str, int]]) -> Column:
    """The item whose interval holds ``at``, from (item, upper bound) in ascending order."""
    bounds = F.array(*[F.lit(float(hi)) for _, hi in table])
    items = F.array(*[F.lit(g) for g, _ in table])
    return F.element_at(items, F.size(F.filter(bounds, lambda b: b <= at)) + 1)


def _drawn(seed: int, items: list[str], upper: list[int]):
    """Words of so many drawn glyphs, from idx, len and k, the number of a word's first draw."""
    glyph, bounds = pa.array(items, pa.string()), np.array(upper, np.float64)

    def run(batches):
        for batch in batches:
            size = np.asarray(batch.column("len")).astype(np.int64)
            ends = np.cumsum(size)
            number = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(np.asarray(batch.column("k")) - (ends - size), size)
            which = np.searchsorted(bounds, draws_at(seed, number) * bounds[-1], side="right")
            glyphs_of = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), glyph.take(pa.array(np.minimum(which, len(items) - 1))))
            yield pa.RecordBatch.from_arrays([batch.column("idx"), pc.binary_join(glyphs_of, "")], ["idx", "word"])

    return run


def gibberish(words: DataFrame, seed: int = policy.GIBBERISH_SEED) -> DataFrame:
    """idx and word: as many glyphs as the word at idx has, each drawn by frequency.

    Draw numbers come from prefix sums; draws and glyphs are made for whole Arrow
    batches of words, so that nothing is ever a row a glyph.
    """
    words = staged(words.select("idx", "word", glyph_count(F.col("word")).alias("len")), "gibberish")
    table = [(r["glyph"], int(r["hi"])) for r in glyph_intervals(words).orderBy("hi").collect()]  # an alphabet
    if not table:
        return words.select("idx", "word")
    sized = words.select("idx", "len", F.floor(F.col("idx") / 4096).cast("long").alias("block"))
    blocks = totals_before(sized.groupBy("block").agg(F.sum("len").alias("v")).withColumn("g", F.lit(0)), ["g"], "block", "v", "off").select("block", "off")
    inside = F.sum("len").over(Window.partitionBy("block").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    sized = sized.withColumn("before", F.coalesce(inside, F.lit(0))).join(blocks, "block").select("idx", "len", (F.col("off") + F.col("before")).cast("long").alias("k"))
    return sized.mapInArrow(_drawn(seed, [g for g, _ in table], [hi for _, hi in table]), "idx long, word string")


def edit(word: list[str], op: float, any_glyph, at_random, weights=(1 / 3, 1 / 3, 1 / 3)) -> None:
    """Replace, insert or delete one glyph in place; the only glyph is replaced instead of deleted."""
    place = int(at_random() * len(word))
    if op < weights[0]:
        word[place] = any_glyph(place, len(word))
    elif op < weights[0] + weights[1]:
        word.insert(place, any_glyph(place, len(word) + 1))
    elif len(word) > 1:
        del word[place]
    else:
        word[place] = any_glyph(place, len(word))


class Strung:
    """All words made so far, each a list of glyphs, as one string of glyphs' numbers with the places where words end."""

    def __init__(self, glyphs: Iterable[str]):
        self.glyphs = list(glyphs)
        self.code = {g: k for k, g in enumerate(self.glyphs)}
        self.data, self.ends = array("B" if len(self.glyphs) <= 1 << 8 else "H" if len(self.glyphs) <= 1 << 16 else "i"), array("q", [0])

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, k: int) -> list[str]:
        return [self.glyphs[c] for c in self.data[self.ends[k] : self.ends[k + 1]]]

    def append(self, word: list[str]) -> None:
        self.data.extend([self.code[g] for g in word])
        self.ends.append(len(self.data))


def self_citations(count: int, seed_lengths: list[int], frequencies: dict[str, int], random, seed_words: int = policy.SEED_WORDS, edit_p: float = policy.EDIT_PROBABILITY, second_p: float = policy.SECOND_EDIT_PROBABILITY) -> Iterator[str]:
    """Words of drawn glyphs first, then copies of any earlier word, most of them edited."""
    if seed_words > len(seed_lengths):
        raise ValueError("fewer seed lengths than seed words")
    picker = Picker(frequencies)
    glyph = lambda *_: picker(random)
    words = Strung(picker.items)
    for k in range(count):
        if k < seed_words:
            word = [glyph() for _ in range(seed_lengths[k])]
        else:
            word = words[int(random() * k)]
            if random() < edit_p:
                # The choice of the operation is one of three equal parts of a draw.
                edit(word, int(random() * 3) / 3 + 1e-9, glyph, random)
                if random() < second_p:
                    edit(word, int(random() * 3) / 3 + 1e-9, glyph, random)
        words.append(word)
        yield "".join(word)


def self_citation(*how, **more) -> list[str]:
    """The words of :func:`self_citations`."""
    return list(self_citations(*how, **more))


def skeleton(lines: DataFrame, by: list[str] = stats.CORPUS) -> DataFrame:
    """The layout: page, line_no, par_start, word_count and the idx at which each line begins."""
    at = stats.indexed(lines, by).filter("pos = 0").select(*by, "page", "line_no", F.col("idx").alias("start"))
    rows = lines.select(*by, "page", "line_no", "par_start", F.size("words").alias("word_count"), F.transform("words", glyph_count).alias("lengths"))
    return rows.join(at, [*by, "page", "line_no"], "left")


def pour(layout: DataFrame, words: DataFrame, corpus: str) -> DataFrame:
    """``words`` (idx, word) in the lines of ``layout``; too few words raise, more are left over."""
    places = layout.filter("word_count > 0").select("page", "line_no", "par_start", "word_count", F.posexplode(F.sequence(F.col("start"), F.col("start") + F.col("word_count") - 1)).alias("pos", "idx"))
    short = F.when(F.col("word").isNull(), F.raise_error(F.lit("not enough words for the layout")).cast("string")).otherwise(F.col("word"))
    filled = places.join(words, "idx", "left").withColumn("word", short)
    # A line's own places bound what is gathered for it.
    lines = filled.groupBy("page", "line_no", "par_start").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("words"))
    return lines.select(F.lit(corpus).alias("corpus"), "page", "line_no", "par_start", "words")


def _sequential(make):
    """A corpus whose words each depend on earlier ones: one task, which gives them as they are made."""

    def run(batches):
        count, lengths = 0, []
        for b in batches:
            count += sum(b.column("n").to_pylist())
            lengths += [r for part in b.column("lengths").to_pylist() for r in part]
        words, low = make(count, lengths), 0
        while part := list(islice(words, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(range(low, low + len(part)), pa.int64()), pa.array(part, pa.string())], ["idx", "word"])
            low += len(part)

    return run


def repeated(words: DataFrame, times: int, size: int) -> DataFrame:
    """``words`` (idx, word) over and over, ``times`` in all; ``size`` is how many there are."""
    return words.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).select((F.col("idx") + F.col("t") * size).alias("idx"), "word")


def build_controls(spark: SparkSession, lines: DataFrame, latin_source: DataFrame) -> DataFrame:
    """Five controls in the layout of ``lines`` (one corpus), as one frame of lines by ``corpus``."""
    lines = staged(lines.select(*stats.CORPUS, "page", "line_no", "par_start", "words"), "control-lines")
    words = staged(stats.indexed(lines).select("idx", "word"), "control-words")
    latin_source = staged(latin_source, "control-latin")
    layout = staged(skeleton(lines), "control-layout")
    need = words.count()
    have = latin_source.count()
    plain = repeated(latin_source, -(-need // max(have, 1)), have) if 0 < have < need else latin_source
    letters, cipher = substitution(latin_source)
    enciphered = plain.select("idx", encipher(F.col("word"), letters, cipher).alias("word"))
    frequencies = {r["glyph"]: int(r["n"]) for r in glyph_intervals(words).orderBy("hi").collect()}  # a row a glyph
    first = F.sort_array(F.collect_list(F.when(F.col("idx") < policy.SEED_WORDS, F.struct("idx", glyph_count(F.col("word")).alias("len")))))["len"]
    seeds = words.agg(F.count(F.lit(1)).alias("n"), first.alias("lengths")).coalesce(1)
    copied = seeds.mapInArrow(_sequential(lambda n, lengths: self_citations(n, lengths, frequencies, quick(policy.SELF_CITATION_SEED), min(policy.SEED_WORDS, n))), "idx long, word string").hint("merge")
    made = {"Latin": plain, "Enciphered Latin": enciphered, "Shuffled": shuffled(words), "Gibberish": gibberish(words), "Self-citation": copied}
    # Each is written on its own, so that plans of what is done with them stay small.
    out = None
    for name, source in made.items():
        part = staged(pour(layout, source, name), "control")
        out = part if out is None else out.unionByName(part)
    return out
