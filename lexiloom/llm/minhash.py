"""Near-duplicate documents by one-permutation hashing with optimal densification.

A text's set is that of its distinct shingles of five words. One hash of each
shingle serves all of a text's BINS minima: its high bits name the bin, and each
bin keeps its least. An empty bin borrows from the first full one in a random
order of its own (optimal densification), the same for all texts. Bins in groups
of ROWS are the keys of BANDS buckets.

Texts of equal sets are one class, which has one representative. Among the
representatives in a bucket, each is paired only with the bucket's centre, its
smallest doc_id, so that a bucket of n gives n - 1 pairs. Pairs are confirmed on
the full sets, and confirmed links make components. Buckets that still hold
several components get a second centre, in a hashed order that differs by bucket,
for the members of other components; pairs tried before are left out. What the
two centres leave is settled exactly: the members of buckets that still hold
several components are joined by the prefixes of their full sets, rarest shingles
first, which no pair of similar sets can miss, and each candidate of two
components is confirmed. A link within a component changes nothing, so none such
is looked for. At a similarity of 0.85 two sets share no bucket with a
probability below 1e-6, at 0.80 below 1e-4, and less above.

Shingles are 64-bit hashes; the whole set of a text has a fingerprint of 128 bits.

Edge cases. Null, empty or blank text: the empty set, linked with nothing. Fewer
words than five: the whole sequence is the one shingle. Rows of one doc_id are
one node, which each of their texts can link. A doc_id that is no integer column raises. Null doc_id: n_shingles as for any text, component_id that of its
equals or null, kept false. Ties cannot arise, doc_ids being ordered. Empty
table: empty result. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lexiloom.llm import textkernel as tk
from lexiloom.llm.components import components
from lexiloom.llm.scratch import Scratch
from lexiloom.llm.spread import having_ids, left_join_grouped

WORDS = 5
BANDS, ROWS = 32, 6
BINS = BANDS * ROWS
SIMILAR = 85
_SEED = 20_177

_edges = np.array([-(-(i << 64) // BINS) for i in range(BINS)], dtype=np.uint64)
_orders = np.argsort(np.random.default_rng(_SEED).random((BINS, BINS)), axis=1)
_factors = np.random.default_rng(_SEED + 1).integers(1, 2**63, size=(BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_salts = np.random.default_rng(_SEED + 2).integers(1, 2**63, size=BANDS, dtype=np.uint64)


def shingle_sets(column: pa.Array, words: int = WORDS):
    """The sorted distinct shingle hashes of each text, one after the other."""
    data, bounds = tk.text_bytes(column)
    for a, b in tk.text_slices(bounds):
        h, _, _, first = tk.hash_words(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], tk.SPACES)
        n = len(h)
        long = tk.chain(h, np.arange(max(0, n - words + 1)), words) if n >= words else h[:0]
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= words:
                yield np.unique(long[lo : hi - words + 1])
            elif hi > lo:
                yield tk.chain(h, np.array([lo]), hi - lo)
            else:
                yield h[:0]


def band_keys(sets: np.ndarray) -> np.ndarray:
    """The bucket keys of a sorted non-empty set."""
    at = np.searchsorted(sets, _edges)
    full = at < np.append(at[1:], len(sets))
    low = sets[np.minimum(at, len(sets) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        order = _orders[empty]
        low[empty] = low[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return tk.mix((tk.mix(low).reshape(BANDS, ROWS) * _factors).sum(axis=1, dtype=np.uint64) + _salts)


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _sketch(batches):
    for batch in batches:
        sizes, one, two, bands = [], [], [], []
        for s in shingle_sets(batch.column("text")):
            sizes.append(len(s))
            one.append(tk.mix(s ^ np.uint64(_SEED)).sum(dtype=np.uint64))
            two.append(np.bitwise_xor.reduce(tk.mix(s + np.uint64(_SEED))) if len(s) else np.uint64(0))
            bands.append(band_keys(s) if len(s) else s)
        as_long = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), as_long(one), as_long(two), _lists(bands)], ["doc_id", "n_shingles", "s1", "s2", "bands"])


def _full_sets(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(list(shingle_sets(batch.column("text"))))], ["doc_id", "shingles"])


def confirmed(scratch: Scratch, sets: DataFrame, pairs: DataFrame, name: str, similar: int = SIMILAR) -> DataFrame:
    """Those of ``pairs`` (a, b) of which some two full ``sets`` (doc_id, shingles) are similar."""
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    out = both.select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("n"))
    return scratch.write(out.filter(F.col("i") * 100 >= (F.col("n") - F.col("i")) * similar).select("a", "b").distinct(), name)


def near_duplicates(spark: SparkSession, docs: DataFrame, similar: int = SIMILAR, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text).

    What the result reads stays in ``scratch``, if one is given, until its owner drops it.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer column")
    scratch = scratch or Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = scratch.write(docs.mapInArrow(tk.lean(_sketch), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"), "sketch")
    same = ["n_shingles", "s1", "s2"]
    rows = sketch.count()
    live = sketch.filter("n_shingles > 0")
    classes = scratch.write(live.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")

    # Buckets hold the representatives of the classes. Classes of one row need no join to name theirs.
    shared = classes.filter("n > 1")
    named = left_join_grouped(live.select("doc_id", *same, "bands"), shared, same, "n", rows).filter("doc_id IS NOT NULL")
    named = scratch.write(named.withColumn("bands", F.when(F.coalesce(F.col("rep") == F.col("doc_id"), F.lit(True)), F.col("bands"))), "named")
    keyed = named.filter("bands IS NOT NULL").select(F.col("doc_id").alias("node"), F.posexplode("bands").alias("band", "key"))
    centres = keyed.groupBy("band", "key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    centres = scratch.write(centres, "centres")
    # Only members of buckets of two and more are read again.
    members = left_join_grouped(keyed, centres, ["band", "key"], "n", BANDS * rows).filter("centre IS NOT NULL")
    members = scratch.write(members, "members")
    pairs = scratch.write(members.filter("node > centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "pairs1")

    # Full sets are built once, for the documents that share a bucket with another text.
    # A doc_id that several texts bear has a set for each of them.
    texts = having_ids(docs, members.select(F.col("node").alias("doc_id")), "doc_id").withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"])
    sets = scratch.write(texts.select("doc_id", "text").mapInArrow(tk.lean(_full_sets), "doc_id long, shingles array<long>"), "sets")

    # Rows of one doc_id but different texts are one node: their classes are linked through it.
    twice = named.select("doc_id", *same).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    alias = named.filter("rep <> doc_id").join(twice.drop("n"), "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = scratch.write(confirmed(scratch, sets, pairs, "links1", similar).unionByName(alias), "all1")
    labels = scratch.write(components(scratch, links, "cc1-"), "labels1")
    more = scratch.write(_second_centres(scratch, members, labels, rows).join(pairs, ["a", "b"], "left_anti"), "pairs2")
    found = confirmed(scratch, sets, more, "links2", similar)
    if not found.isEmpty():
        links = scratch.write(links.unionByName(found), "all2")
        labels = scratch.write(components(scratch, links, "cc2-"), "labels2")
    pairs = pairs.unionByName(more)
    # Centres are quick, not whole: the rest of the pairs of two components by an exact join.
    rest = scratch.write(_rest_pairs(scratch, members, labels, sets, rows, similar).join(pairs, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty() and not (found := confirmed(scratch, sets, rest, "links-rest", similar)).isEmpty():
        labels = components(scratch, links.unionByName(found), "cc-rest-")
    labels = scratch.write(labels, "labels")
    scratch.keep_only("sketch", "classes", "labels")

    of_class = shared.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(*same, "n", F.coalesce("component", "rep").alias("of_class"))
    out = left_join_grouped(sketch.select("doc_id", *same), of_class, same, "n", rows)
    out = out.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce(F.least("of_class", "component"), "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _several(scratch: Scratch, members: DataFrame, labels: DataFrame, rows: int, name: str) -> DataFrame:
    """The members of buckets that hold several components, with their component and the bucket's least (lo)."""
    bucket = ["band", "key"]
    labelled = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")).select(*bucket, "node", "component")
    labelled = scratch.write(labelled, f"{name}-labelled")
    several = labelled.groupBy(*bucket).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi")
    several = scratch.write(several.drop("hi"), f"{name}-buckets")
    found = scratch.write(left_join_grouped(labelled, several, bucket, "n", BANDS * rows).filter("lo IS NOT NULL"), name)
    scratch.drop(f"{name}-labelled", f"{name}-buckets")
    return found


def _rest_pairs(scratch: Scratch, members: DataFrame, labels: DataFrame, sets: DataFrame, rows: int, similar: int) -> DataFrame:
    """All pairs of two components that can be similar, among the members of buckets that hold several.

    Shingles stand in the order of how many sets hold them. Similar sets of n <= m
    shingles have at least similar / (100 + similar) * (n + m) in common, so that
    the first of these is among the first few of both: of the smaller set fewer
    than of the larger. Shingles of one set alone only take places.
    """
    nodes = scratch.write(_several(scratch, members, labels, rows, "left").select("node", "component").distinct(), "several")
    own = sets.withColumnRenamed("doc_id", "node").join(nodes, "node").select("node", "component", F.size("shingles").cast("long").alias("size"), "shingles")
    own = scratch.write(own.withColumn("h", F.xxhash64("shingles")), "own")
    words = own.select("node", "component", "size", "h", F.explode("shingles").alias("w"))
    held = scratch.write(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("df", F.col("n")), "held")
    total = own.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shared = left_join_grouped(words, held, ["w"], "n", total).filter("df IS NOT NULL")
    order = shared.groupBy("node", "component", "size", "h").agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("order"))
    order = order.withColumn("alone", F.col("size") - F.size("order"))
    most = F.expr(f"size - (size * {similar} + 99) div 100 + 1 - alone").cast("int")
    few = F.expr(f"size - (2 * size * {similar} + {99 + similar}) div {100 + similar} + 1 - alone").cast("int")
    order = order.withColumn("most", most).withColumn("few", few).filter("most > 0")
    order = scratch.write(order.withColumn("order", F.slice(F.col("order.w"), 1, F.col("most"))), "order")

    def side(c: str, length: str) -> DataFrame:
        first = order.filter(F.col(length) > 0).select(F.col("node").alias(c), F.col("component").alias(f"c{c}"), F.col("size").alias(f"n{c}"), "alone", F.posexplode(F.slice("order", 1, F.col(length))).alias("at", "w"))
        return first.select(c, f"c{c}", f"n{c}", (F.col(f"n{c}") - F.col("alone") - F.col("at")).alias(f"left{c}"), "w")

    met = side("a", "few").join(side("b", "most"), "w").filter("ca <> cb AND (na < nb OR na = nb AND a < b)")
    met = met.filter(f"100 * na >= {similar} * nb AND {100 + similar} * least(lefta, leftb) >= {similar} * (na + nb)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _second_centres(scratch: Scratch, members: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Pairs of a second centre with the members of other components, in buckets that hold several components."""
    bucket = ["band", "key"]
    labelled = _several(scratch, members, labels, rows, "mixed")
    # The centre is outside the bucket's least component, which the first centre is likely to have gathered.
    by_hash = F.struct(F.xxhash64("band", "key", "node").alias("h"), F.col("node").alias("c"), F.col("component").alias("of"))
    picks = labelled.groupBy(*bucket).agg(F.min(F.when(F.col("component") > F.col("lo"), by_hash)).alias("p"), F.count(F.lit(1)).alias("n"))
    met = left_join_grouped(labelled.drop("lo"), scratch.write(picks, "picks"), bucket, "n", BANDS * rows).filter("p.of <> component")
    return met.select(F.least("node", "p.c").alias("a"), F.greatest("node", "p.c").alias("b")).distinct()


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of ``documents`` at 100 * intersection >= 85 * union."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
