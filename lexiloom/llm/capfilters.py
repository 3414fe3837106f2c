"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

A filter is a direction; a vector passes it if their inner product exceeds a
threshold. Directions come from a product code: the coordinates, after a random
rotation, are cut into blocks, each with a codebook of its own, and every choice
of one codeword a block is a filter. List decoding finds all filters a vector
passes from the block products alone, prefix by prefix, dropping prefixes that
the best of the blocks left could not save. Two vectors of a high cosine pass
common filters; a vector that passes too few takes its best ones.

The threshold grows with the number of vectors, so that a filter is passed by
about CROWD vectors at every size, and the number of filters with it. A higher
threshold catches less with each filter, so that a vector passes more of them
(LISTS on average, LEAST at least, times the GROWTH power of the number) and
recall stays where it is. Vectors of a filter meet in blocks of at most
CHUNK by CHUNK (fuller filters are cut into chunks that meet in pairs). A linked
pair counts only in the first filter the two have in common, which the lists that
travel with the vectors tell; what leaves a block is a sum for each vector and a
link with the smallest vector it hangs together with there, so that output is
linear in the members however many pairs are linked. Equal vectors are one class
with a count.

Cosines are in double precision. Measured recall: see the README.

Edge cases. Null, empty, zero vectors or ones with null or non-finite components
link with nothing, nor do rows without a vec_id (component_id null, kept false).
Vectors of different dimension do not link. Rows of one vec_id are one node.
Empty table: empty result. Columns other than vec_id and embedding, labels too,
are not looked at.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import textkernel as tk
from lexiloom.llm.components import components
from lexiloom.llm.scratch import Scratch
from lexiloom.llm.spread import left_join_grouped

COSINE = 0.95
CROWD, LISTS, LEAST = 8, 16, 10
#: Beyond this many vectors lists grow: twice as long for each hundredfold.
GROWS_FROM, GROWTH = 10_000, 0.15
CHUNK = 2048
#: Filters fuller than that are broadcast up to this many, and joined by a shuffle beyond.
FULL = 100_000
WORDS = 64
_SEED = 60_493


class Code:
    """A product code for vectors of one dimension among about ``n`` of them."""

    def __init__(self, dim: int, n: int):
        p = min(0.25, CROWD / max(n, 1))
        longer = max(1.0, n / GROWS_FROM) ** GROWTH
        self.least = ceil(LEAST * longer)
        filters = ceil(LISTS * longer / p)
        self.blocks = max(1, min(dim, max(3, ceil(np.log(filters) / np.log(WORDS)))))
        self.size = max(2, ceil(filters ** (1 / self.blocks)))
        rng = np.random.default_rng([_SEED, dim])
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = [(int(c[0]), int(c[-1]) + 1) for c in np.array_split(np.arange(dim), self.blocks)]
        self.words = [rng.standard_normal((hi - lo, self.size)) for lo, hi in self.cuts]
        self.threshold = NormalDist().inv_cdf(1 - p)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and filter of every pass of the unit vectors ``x``, by row, each row's filters in order."""
        y = x @ self.rotation
        parts = [y[:, lo:hi] @ w for (lo, hi), w in zip(self.cuts, self.words, strict=True)]
        rows, filters, _ = self._above(parts, np.full(len(x), self.threshold))
        count = np.bincount(rows, minlength=len(x))
        if len(few := np.flatnonzero(count < self.least)):
            # Lower the threshold for these until enough pass, and keep the best.
            bar, some, least = np.full(len(few), self.threshold), [p[few] for p in parts], min(self.least, self.size**self.blocks)
            while True:
                bar = np.where(np.bincount((got := self._above(some, bar))[0], minlength=len(few)) < least, bar - 0.25, bar)
                if (np.bincount(got[0], minlength=len(few)) >= least).all():
                    break
            by = np.lexsort((-got[2], got[0]))
            r, f = got[0][by], got[1][by]
            best = np.arange(len(r)) - np.searchsorted(r, r) < least
            keep = ~np.isin(rows, few)
            rows, filters = np.concatenate([rows[keep], few[r[best]]]), np.concatenate([filters[keep], f[best]])
        by = np.lexsort((filters, rows))
        return rows[by], filters[by]

    def _above(self, parts: list[np.ndarray], bar: np.ndarray):
        rest = np.cumsum([p.max(axis=1) for p in parts[::-1]], axis=0)[::-1]
        rows, code, total = np.arange(len(bar)), np.zeros(len(bar), np.int64), np.zeros(len(bar))
        for k, p in enumerate(parts):
            after = rest[k + 1][rows] if k + 1 < len(parts) else 0.0
            grid = total[:, None] + p[rows]
            i, j = np.nonzero(grid >= (bar[rows] - after)[:, None])
            rows, code, total = rows[i], code[i] * self.size + j, grid[i, j]
        return rows, code, total


@lru_cache(maxsize=8)
def _code(dim: int, n: int) -> Code:
    return Code(dim, n)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat float64 components, offsets, and which rows are usable."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    valid = np.asarray(column.is_valid())
    column = column.fill_null(pa.scalar([], column.type)) if column.null_count else column
    offsets = np.asarray(column.offsets).astype(np.int64)
    flat = np.asarray(column.values.cast(pa.float64()).fill_null(np.nan)) if len(column.values) else np.zeros(0)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    lo, hi = offsets[:-1], offsets[1:]
    nonzero = np.array([bool(flat[a:b].any()) for a, b in zip(lo, hi, strict=True)], dtype=bool)
    return flat, offsets, valid & (bad[hi] == bad[lo]) & nonzero


def _fingerprints(batches):
    """Two hashes of each usable vector, equal for equal components."""
    for batch in batches:
        flat, offsets, ok = _matrix(batch.column("embedding"))
        bits = tk.mix((flat + 0.0).view(np.uint64))
        place = (np.arange(len(bits)) - np.repeat(offsets[:-1], np.diff(offsets)) + 1).astype(np.uint64) if len(bits) else np.zeros(0, np.uint64)
        sums = []
        for salt in (0x51ED27, 0x9A77F1):
            terms = tk.mix(bits ^ tk.mix(place + np.uint64(salt)))
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
            sums.append(pa.array((run[offsets[1:]] - run[offsets[:-1]]).view(np.int64)))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names], *sums, pa.array(ok)], [*batch.schema.names, "h1", "h2", "ok"])


def _units(x: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision; scaled first, so that no square leaves the range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _passes(n: int):
    def run(batches):
        for batch in batches:
            flat, offsets, _ = _matrix(batch.column("embedding"))
            sent = np.float32 if pa.types.is_float32(batch.column("embedding").type.value_type) else np.float64
            reps, mult = np.asarray(batch.column("rep")), np.asarray(batch.column("n"))
            dims = np.diff(offsets)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for lo in range(0, len(at), 1024):
                    part = at[lo : lo + 1024]
                    x = flat[offsets[part][:, None] + np.arange(dim)]
                    rows, filters = _code(int(dim), n).decode(_units(x))
                    ends = np.cumsum(np.bincount(rows, minlength=len(part)))
                    lists = np.split(filters, ends[:-1])
                    own = pa.array([v.tobytes() for v in x.astype(sent)], pa.binary())
                    known = pa.array([f.astype(np.int64).tobytes() for f in lists], pa.binary())
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), dim, np.int32)), pa.array(filters.astype(np.int64)), pa.array(reps[part][rows]), pa.array(mult[part][rows]), own.take(take), known.take(take)],
                        ["dim", "filter", "rep", "mult", "vector", "lists"],
                    )

    return run


def _local(link: np.ndarray) -> np.ndarray:
    """For each member the first member it hangs together with, in a symmetric boolean matrix with a true diagonal."""
    least = np.arange(len(link))
    while True:
        new = np.where(link, least[None, :], len(link)).min(axis=1)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _block(rows, dim: int, cosine: float):
    """Weighted links of each member of one block that count here, and its link with a smaller member."""
    rep, order = np.unique(np.array([r[0] for r in rows]), return_index=True)
    rows = [rows[k] for k in order]
    x = _units(np.stack([np.frombuffer(r[2], dtype=np.float32 if len(r[2]) == 4 * dim else np.float64) for r in rows]).astype(np.float64))
    link = x @ x.T >= cosine
    here, split, part = rows[0][4], rows[0][5], np.array([r[6] for r in rows])
    if split:
        link &= part[:, None] != part[None, :]
    np.fill_diagonal(link, False)
    if not link.any():
        return [], [], [], []
    some = np.flatnonzero(link.any(axis=1))
    link, rep, rows = link[np.ix_(some, some)], rep[some], [rows[k] for k in some]
    lists = [np.frombuffer(r[3], dtype=np.int64) for r in rows]
    earlier = [f[f < here] for f in lists]
    size = np.array([len(f) for f in earlier])
    if size.any():
        names, at = np.unique(np.concatenate(earlier), return_inverse=True)
        holds = np.zeros((len(rows), len(names)), np.float32)
        holds[np.repeat(np.arange(len(rows)), size), at] = 1
        counted = link & (holds @ holds.T < 0.5)
    else:
        counted = link
    mult = np.array([r[1] for r in rows])
    weights = (counted * mult[None, :]).sum(axis=1)
    np.fill_diagonal(link, True)
    return rep, weights, rep, rep[_local(link)]


def _meet(cosine: float):
    """Blocks come one after the other, in order of their key, across batches."""

    def run(batches):
        held, key, reps, sums, nodes, least = [], None, [], [], [], []

        def flush():
            if len(held) > 1:
                a, b, c, d = _block(held, key[0], cosine)
                for to, x in ((reps, a), (sums, b), (nodes, c), (least, d)):
                    to.extend(x)

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (reps, sums, least)], ["rep", "links", "least"])
            for x in (reps, sums, nodes, least):
                x.clear()
            return batch

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("dim", "filter", "i", "j", "rep", "mult", "vector", "lists", "part")]
            for dim, f, i, j, rep, mult, vector, lists, part in zip(*cols, strict=True):
                if (dim, f, i, j) != key:
                    flush()
                    held, key = [], (dim, f, i, j)
                held.append((rep, mult, vector, lists, f, i != j, part))
            if reps:
                yield out()
        flush()
        if reps:
            yield out()

    return run


def cap_links(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, embedding)."""
    scratch = Scratch(spark, "caps")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    marked = rows.mapInArrow(tk.lean(_fingerprints), f"vec_id long, embedding {rows.schema['embedding'].dataType.simpleString()}, h1 long, h2 long, ok boolean")
    marked = scratch.write(marked.withColumn("ok", F.col("ok") & F.col("vec_id").isNotNull()), "marked")
    live = marked.filter("ok")
    classes = live.groupBy("h1", "h2").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = scratch.write(classes, "classes")
    n = classes.count()
    passes = classes.select("embedding", "rep", "n").mapInArrow(tk.lean(_passes(n)), "dim int, filter long, rep long, mult long, vector binary, lists binary")
    passes = scratch.write(passes, "passes")
    # Only filters that are too full for one block need to be known beforehand; vectors move once.
    full = passes.groupBy("dim", "filter").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CHUNK)
    full = scratch.write(full.select("dim", "filter", F.ceil(F.col("n") / CHUNK).cast("int").alias("g")), "full")
    met = passes.join(F.broadcast(full) if full.count() <= FULL else full, ["dim", "filter"], "left").withColumn("g", F.coalesce("g", F.lit(1)))
    met = met.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    met = met.withColumn("i", F.least("part", "k")).withColumn("j", F.greatest("part", "k")).drop("k", "g")
    block = ["dim", "filter", "i", "j"]
    found = met.repartition(*block).sortWithinPartitions(*block).mapInArrow(tk.lean(_meet(cosine)), "rep long, links long, least long")
    found = scratch.write(found, "found")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = scratch.write(components(scratch, found.filter("least <> rep").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct()), "labels")
    of_class = classes.select("h1", "h2", "rep", "n").join(counts, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("h1", "h2", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    usable = left_join_grouped(live.select("vec_id", "h1", "h2"), of_class, ["h1", "h2"], "n", marked.count()).select("vec_id", "n_links", "component")
    rest = marked.filter(~F.coalesce("ok", F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    out = usable.unionByName(rest)
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))


def op6_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` at a cosine of 0.95 or more."""
    return cap_links(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
