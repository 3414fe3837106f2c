"""Vocabulary structure above the line: similarity by distance, sections, paragraphs, labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom import policy
from lexiloom.functions.prng import draw
from lexiloom.operators.stats import CORPUS, ratio

NO_SECTION = " null"


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets, given as arrays without repeats; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return ratio(both, F.size(a) + F.size(b) - both)


def pages_of(lines: DataFrame, by: list[str] = CORPUS, more: tuple[str, ...] = ("section", "language")) -> DataFrame:
    """page and types, the set of its words as hashes of 64 bits, for each page with a word."""
    words = lines.select(*by, "page", *more, F.explode("words").alias("w")).distinct()
    return words.groupBy(*by, "page", *more).agg(F.array_sort(F.collect_list(F.xxhash64("w"))).alias("types"))


def _bucket(distance: Column, buckets) -> tuple[Column, Column]:
    lo = hi = F.lit(None).cast("int")
    for a, b in buckets:
        inside = distance.between(a, b)
        lo, hi = F.when(inside, a).otherwise(lo), F.when(inside, b).otherwise(hi)
    return lo, hi


def page_pairs(pages: DataFrame, by: list[str] = CORPUS, buckets=policy.PAGE_BUCKETS) -> DataFrame:
    """Pairs of pages no further apart than the last bucket, with lo, hi, similarity and both sections.

    Pages meet through blocks as wide as the reach: each is sent to its own block
    and the one before, so that the join is on equal keys and a page moves twice.
    """
    reach = max(b for _, b in buckets)
    cols = [c for c in ("section",) if c in pages.columns]
    left = pages.select(*by, F.floor(F.col("page") / reach).alias("block"), F.col("page").alias("p"), F.col("types").alias("a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    right = pages.withColumn("own", F.floor(F.col("page") / reach)).withColumn("block", F.explode(F.array("own", F.col("own") - 1)))
    right = right.select(*by, "block", F.col("page").alias("q"), F.col("types").alias("b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    pairs = left.join(right, [*by, "block"]).filter((F.col("q") > F.col("p")) & (F.col("q") - F.col("p") <= reach))
    lo, hi = _bucket(F.col("q") - F.col("p"), buckets)
    out = pairs.select(*by, lo.alias("lo"), hi.alias("hi"), jaccard(F.col("a"), F.col("b")).alias("similarity"), *[f"{c}_{s}" for c in cols for s in "ab"])
    return out.filter("lo IS NOT NULL")


def _every_bucket(found: DataFrame, groups: DataFrame, by: list[str], buckets) -> DataFrame:
    spans = F.explode(F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in buckets])).alias("s")
    grid = groups.select(*by).distinct().select(*by, spans).select(*by, "s.lo", "s.hi")
    return grid.join(found, [*by, "lo", "hi"], "left")


def similarity_by_distance(pages: DataFrame, by: list[str] = CORPUS, buckets=policy.PAGE_BUCKETS) -> DataFrame:
    """Mean similarity of pairs of pages in each bucket of distances, and how many there are."""
    found = page_pairs(pages, by, buckets).groupBy(*by, "lo", "hi").agg(F.avg("similarity").alias("mean"), F.count(F.lit(1)).alias("pairs"))
    return _every_bucket(found, pages, by, buckets).fillna(0)


def _contrast(pairs: DataFrame, same: Column, by: list[str]) -> DataFrame:
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("similarity"))), F.lit(0.0))
    return pairs.groupBy(*by, "lo", "hi").agg(mean(same).alias("same_mean"), F.count_if(same).alias("same_pairs"), mean(~same).alias("diff_mean"), F.count_if(~same).alias("diff_pairs"))


def _with_contrast(rows: DataFrame) -> DataFrame:
    rows = rows.fillna(0)
    return rows.withColumn("contrast", F.when((F.col("same_pairs") > 0) & (F.col("diff_pairs") > 0), F.col("same_mean") - F.col("diff_mean")).otherwise(0.0))


def section_contrast(pages: DataFrame, by: list[str] = CORPUS, buckets=policy.PAGE_BUCKETS) -> DataFrame:
    """The same for pairs of one section and of two; pages without a section are left out."""
    known = pages.filter(F.col("section").isNotNull())
    pairs = page_pairs(known, by, buckets)
    return _with_contrast(_every_bucket(_contrast(pairs, F.col("section_a") == F.col("section_b"), by), pages, by, buckets))


#: Pages of one block where pages of several tasks meet.
PAGE_BLOCK = 1024


def _numbers(words: pa.Array) -> np.ndarray:
    """A hash of 64 bits for each word, the same within a task."""
    part = words.dictionary_encode()
    return np.array([hash(w) for w in part.dictionary.to_pylist()], np.int64)[np.asarray(part.indices)] if len(words) else np.zeros(0, np.int64)


def sets_in_order(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, list]]:
    """For each group ``by`` its pages in order, from lines or pages that stand in order: (page, section, own, set of words as hashes)."""
    group, pages, page, parts = None, [], None, {}

    def closed() -> None:
        for (section, own), words in sorted(parts.items()):
            if page is not None and (kinds := np.unique(np.concatenate(words))).size:
                pages.append((page, section, own, kinds))

    for batch in batches:
        has = batch.schema.names
        rows, hashes = batch.num_rows, _numbers(batch.column("words").flatten())
        ends = np.cumsum(np.asarray(batch.column("words").value_lengths())).tolist()
        keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
        of = lambda c, other: batch.column(c).to_pylist() if c in has else [other] * rows  # noqa: E731, B023
        low = 0
        for key, at, section, own, high in zip(keys, of("page", None), of("section", ""), of("own", True), ends, strict=True):
            if key != group or at != page:
                closed()
                page, parts = at, {}
                if key != group or len(pages) >= PAGE_BLOCK and group is not None:
                    if group is not None:
                        yield group, pages
                    pages, group = [], key
            parts.setdefault((section, own), []).append(hashes[low:high])
            low = high
    closed()
    if group is not None:
        yield group, pages


def sums_in_order(by: list[str], kind: str, buckets=policy.PAGE_BUCKETS):
    """Sums of the similarity of pairs of pages by distance, for :func:`generated_by`, and their schema.

    The pages of a group stand together and in order, so that a page meets those
    it has pairs with in a window as long as the reach: no page is moved. A pair
    counts where its first page is ``own``. Each group gets every bucket.
    """
    reach = max(b for _, b in buckets)
    names = [*by, "lo", "hi", "same_sum", "same_pairs", "diff_sum", "diff_pairs"]

    def sums(window: list, fresh: list, out: np.ndarray) -> list:
        """Adds the pairs whose later page is one of ``fresh``; gives back the window for the next ones."""
        pages = window + fresh
        if len(pages) < 2 or not fresh:
            return pages
        number = np.array([p[0] for p in pages], np.int64)
        size = np.array([len(p[3]) for p in pages], np.int64)
        bounds = np.append(0, np.cumsum(size))
        _, codes = np.unique(np.concatenate([p[3] for p in pages]), return_inverse=True)
        section = np.unique([p[1] for p in pages], return_inverse=True)[1]
        own = np.array([p[2] for p in pages])
        present = np.zeros(int(codes.max()) + 1, np.uint8)
        first = np.searchsorted(number, number - reach)
        upto = np.searchsorted(number, number)  # earlier pages only: those of the same number make no pair
        found: list[tuple[np.ndarray, ...]] = []
        for k in range(len(window), len(pages)):
            a, b = int(first[k]), int(upto[k])
            if a == b:
                continue
            mine = codes[bounds[k] : bounds[k + 1]]
            present[mine] = 1
            shared = np.add.reduceat(present[codes[bounds[a] : bounds[b]]], bounds[a:b] - bounds[a], dtype=np.int64)
            present[mine] = 0
            found.append((number[k] - number[a:b], shared / (size[a:b] + size[k] - shared), section[a:b] == section[k], own[a:b]))
        if found:
            far, similar, same, counts = (np.concatenate(x) for x in zip(*found, strict=True))
            for i, (lo, hi) in enumerate(buckets):
                inside = counts & (far >= lo) & (far <= hi)
                for j, part in ((0, inside & same), (2, inside & ~same)):
                    out[i, j] += similar[part].sum()
                    out[i, j + 1] += part.sum()
        return pages[int(np.searchsorted(number, number[-1] - reach)) :]

    def run(batches):
        group, window, out, any_page = None, [], None, False

        def rows():
            columns = [pa.array([group[i]] * len(buckets)) for i in range(len(by))] + [pa.array([b[i] for b in buckets], pa.int32()) for i in (0, 1)]
            columns = [c.cast(pa.int32()) if n == "replicate" else c for n, c in zip(names, columns, strict=False)]
            return pa.RecordBatch.from_arrays(columns + [pa.array(out[:, i]) if i % 2 == 0 else pa.array(out[:, i].astype(np.int64)) for i in range(4)], names)

        for key, pages in sets_in_order(batches, by):
            if key != group:
                if any_page:
                    yield rows()
                group, window, out, any_page = key, [], np.zeros((len(buckets), 4)), False
            any_page = any_page or bool(pages)
            window = sums(window, [p for p in pages if p[1] is not None], out)
        if any_page:
            yield rows()

    return run, ", ".join(f"{c} {'int' if c == 'replicate' else kind}" for c in by) + ", lo int, hi int, same_sum double, same_pairs long, diff_sum double, diff_pairs long"


def page_texts(between: str):
    """The distinct words of each page as one text, for :func:`generated_by`, by replicate; and their schema."""

    def run(batches):
        now, words, done = None, set(), []

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], ["replicate", "page", "text"])

        for batch in batches:
            flat, low = batch.column("words").flatten().to_pylist(), 0
            for replicate, page, n in zip(*(batch.column(c).to_pylist() for c in ("replicate", "page")), batch.column("words").value_lengths().to_pylist(), strict=True):
                if (replicate, page) != now:
                    if words:
                        done.append((*now, between.join(sorted(words))))
                    now, words = (replicate, page), set()
                words.update(flat[low : low + n])
                low += n
            if done:
                yield packed()
                done = []
        if words:
            done.append((*now, between.join(sorted(words))))
            yield packed()

    return run, "replicate int, page long, text string"


def _sums_of_texts(pages: DataFrame, by: str, between: str, buckets) -> DataFrame:
    """Sums of pairs of ``pages`` (by, page, text and perhaps section), which may come in parts.

    Pages meet in blocks; only those within reach of a block's end are sent to two.
    """
    reach, size = max(b for _, b in buckets), F.lit(PAGE_BLOCK)
    some = [c for c in ("section",) if c in pages.columns]
    blocks = pages.filter("page IS NOT NULL").withColumn("home", F.floor(F.col("page") / size).cast("long"))
    near = F.pmod("page", size) < reach
    blocks = blocks.withColumn("block", F.explode(F.when(near, F.array("home", F.col("home") - 1)).otherwise(F.array("home"))))
    blocks = blocks.repartition(by, "block").sortWithinPartitions(by, "block", "page")
    rows = blocks.select(by, "block", "page", *some, (F.col("home") == F.col("block")).alias("own"), F.split("text", between).alias("words"))
    run, schema = sums_in_order([by, "block"], pages.schema[by].dataType.simpleString(), buckets)
    return rows.mapInArrow(run, schema.replace(f"block {pages.schema[by].dataType.simpleString()}", "block long")).drop("block")


def similarity_of_texts(pages: DataFrame, between: str, buckets=policy.PAGE_BUCKETS) -> DataFrame:
    """:func:`similarity_by_distance` of each replicate of ``pages`` (replicate, page, text), which may come in parts."""
    return similarity_of_sums(_sums_of_texts(pages, "replicate", between, buckets), ["replicate"])


def contrast_of_lines(lines: DataFrame, by: str, between: str, buckets=policy.PAGE_BUCKETS) -> DataFrame:
    """:func:`section_contrast` of the pages of ``lines``, each word of which is moved once, as text."""
    texts = lines.filter(F.size("words") > 0).select(by, "page", "section", F.array_join(F.array_distinct("words"), between).alias("text"))
    return contrast_of_sums(_sums_of_texts(texts, by, between, buckets), [by])


def contrast_of_sums(sums: DataFrame, by: list[str]) -> DataFrame:
    """:func:`section_contrast` from the sums of its pairs."""
    mean = lambda c: ratio(F.sum(f"{c}_sum"), F.sum(f"{c}_pairs")).alias(f"{c}_mean")
    pairs = lambda c: F.sum(f"{c}_pairs").alias(f"{c}_pairs")
    return _with_contrast(sums.groupBy(*by, "lo", "hi").agg(mean("same"), pairs("same"), mean("diff"), pairs("diff")))


def similarity_of_sums(sums: DataFrame, by: list[str]) -> DataFrame:
    """:func:`similarity_by_distance` from the sums of its pairs, whatever their sections."""
    both = lambda c: F.sum(F.col(f"same_{c}") + F.col(f"diff_{c}"))
    return sums.groupBy(*by, "lo", "hi").agg(ratio(both("sum"), both("pairs")).alias("mean"), both("pairs").alias("pairs"))


def line_sets(lines: DataFrame, by: list[str] = CORPUS) -> DataFrame:
    """page, idx (of the line in the page), paragraph and types of every line.

    Paragraph numbers count starts within the page: they only ever meet there.
    """
    order = Window.partitionBy(*by, "page").orderBy("line_no")
    return lines.select(*by, "page", (F.row_number().over(order) - 1).alias("idx"), F.sum(F.col("par_start").cast("int")).over(order).alias("paragraph"), F.array_sort(F.array_distinct(F.transform("words", lambda w: F.xxhash64(w)))).alias("types"))


def paragraph_contrast(sets: DataFrame, by: list[str] = CORPUS, buckets=policy.LINE_BUCKETS) -> DataFrame:
    """Similarity of lines of one page by their distance, of one paragraph and of two."""
    reach = max(b for _, b in buckets)
    left = sets.select(*by, "page", F.col("paragraph").alias("pa"), F.col("types").alias("a"), F.col("idx").alias("i"), F.explode(F.sequence(F.col("idx") + 1, F.col("idx") + reach)).alias("idx"))
    pairs = left.join(sets, [*by, "page", "idx"])
    lo, hi = _bucket(F.col("idx") - F.col("i"), buckets)
    pairs = pairs.select(*by, lo.alias("lo"), hi.alias("hi"), jaccard(F.col("a"), F.col("types")).alias("similarity"), (F.col("pa") == F.col("paragraph")).alias("same")).filter("lo IS NOT NULL")
    return _with_contrast(_every_bucket(_contrast(pairs, F.col("same"), by), sets, by, buckets))


def label_rate(labels: DataFrame, text: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """hits, total and rate of ``labels`` (page, form) that occur in the ``text`` (page, form) of their page."""
    known = text.select("page", "form").distinct().withColumn("hit", F.lit(True))
    rows = labels.join(known.select("page").distinct(), "page", "left_semi")
    if forms is not None:
        rows = rows.join(forms.select("form").distinct(), "form", "left_semi")
    out = rows.join(known, ["page", "form"], "left").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("rate", ratio(F.col("hits"), F.col("total")))


def rare_forms(labels: DataFrame, text: DataFrame, most: int = policy.LABEL_RARE_PAGES) -> DataFrame:
    """Label forms that occur in the text of 1 to ``most`` pages."""
    pages = text.join(labels.select("form").distinct(), "form", "left_semi").groupBy("form").agg(F.count_distinct("page").alias("pages"))
    return pages.filter(F.col("pages").between(1, most))


def pools(pages: DataFrame) -> DataFrame:
    """pool, rank and page: the pages of each section in order, those without one under a name of their own."""
    pool = F.coalesce(F.col("section"), F.lit(NO_SECTION))
    rows = pages.select(pool.alias("pool"), "page").distinct()
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("pool").orderBy("page")) - 1)


def shuffled_labels(labels: DataFrame, pool: DataFrame, shuffles: int = policy.LABEL_SHUFFLES, seed: int = policy.LABEL_SEED) -> DataFrame:
    """shuffle, idx, form and page: each label (idx, section, form) on a page drawn from its section's pool.

    Draw number shuffle * labels + idx makes every reassignment a row of its own.
    Whether pages should be drawn with replacement is not settled; they are.
    """
    n = labels.count()
    sizes = pool.groupBy("pool").agg(F.count(F.lit(1)).alias("size"))
    rows = labels.withColumn("pool", F.coalesce(F.col("section"), F.lit(NO_SECTION))).join(sizes, "pool")
    rows = rows.select("idx", "form", "pool", "size", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))).alias("shuffle"))
    at = F.floor(draw(seed, F.col("shuffle").cast("long") * n + F.col("idx")) * F.col("size")).cast("int")
    return rows.withColumn("rank", at).join(pool, ["pool", "rank"]).select("shuffle", "idx", "form", "page")


def permutation_test(labels: DataFrame, pool: DataFrame, text: DataFrame, shuffles: int = policy.LABEL_SHUFFLES, seed: int = policy.LABEL_SEED) -> DataFrame:
    """The real rate and the share of shuffles whose rate is at least as high."""
    known = text.select("page", "form").distinct().withColumn("hit", F.lit(True))
    with_text = known.select("page").distinct()
    real = label_rate(labels, text)
    moved = shuffled_labels(labels, pool, shuffles, seed).join(with_text, "page", "left_semi")
    rates = moved.join(known, ["page", "form"], "left").groupBy("shuffle").agg(ratio(F.count("hit"), F.count(F.lit(1))).alias("r"))
    both = rates.crossJoin(F.broadcast(real))  # one row
    return both.groupBy("hits", "total", "rate").agg((F.count_if(F.col("r") >= F.col("rate")) / F.lit(shuffles)).alias("p"), F.avg("r").alias("null_mean"))


def stable_groups(keys: DataFrame) -> DataFrame:
    """``keys`` (idx, key) with place: groups in order of first appearance, in order within; null is a group."""
    first = keys.groupBy("key").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a row a key
    first = first.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("key").alias("k"), "off")
    rows = keys.join(F.broadcast(first), keys["key"].eqNullSafe(first["k"])).drop("k")
    return rows.withColumn("place", F.col("off") + F.row_number().over(Window.partitionBy("key").orderBy("idx")) - 1).drop("off")


def replicate_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and worst case of ``value`` over replicates."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.max(value).alias("worst"), F.count(F.lit(1)).alias("replicates"))


def contrast_verdicts(real: DataFrame, null: DataFrame, least: int = policy.USABLE_PAGE_PAIRS, by: tuple[str, ...] = ()) -> DataFrame:
    """Whether each bucket of ``real`` is usable and exceeds the mean and the worst of the ``null`` replicates (by, lo, hi, replicate, contrast)."""
    spread = null.groupBy(*by, "lo", "hi").agg(F.avg("contrast").alias("null_mean"), F.min("contrast").alias("null_min"), F.max("contrast").alias("null_max"))
    rows = real.join(spread, [*by, "lo", "hi"], "left")
    usable = (F.col("same_pairs") >= least) & (F.col("diff_pairs") >= least)
    return rows.withColumns({"usable": usable, "exceeds_mean": usable & (F.col("contrast") > F.col("null_mean")), "exceeds_max": usable & (F.col("contrast") > F.col("null_max")), "bracketed": usable & F.col("contrast").between(F.col("null_min"), F.col("null_max"))})


def share_rule(verdicts: DataFrame, flag: str, share: float = 0.6) -> DataFrame:
    """Whether ``flag`` holds in at least ``share`` of the usable buckets."""
    out = verdicts.agg(F.count_if("usable").alias("usable"), F.count_if(F.col("usable") & F.col(flag)).alias("held"))
    return out.withColumn("verdict", (F.col("usable") > 0) & (F.col("held") >= F.col("usable") * share))
