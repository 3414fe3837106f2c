"""Document quality by histogram gradient-boosted trees over statistics of the text.

Statistics come from the whole text only: shares of kinds of bytes, lengths of
words and lines, and how much words, runs of three words and lines repeat.
Trees are grown on the driver from histograms of at most BINS bins a feature, over
at most SAMPLE labelled documents, those of the least hash, so that what is fitted
does not depend on the number of partitions and what the driver holds is bounded.
A fitted model is four arrays: feature and threshold for each inner node of
complete trees, the leaves' values, and the first score. All rows and trees go
down one level at a time, by numpy indexing.

Documents whose crc32(doc_id as text) mod HELD_OUT is 0 are never learned from;
labels, lang, source and doc_id are no inputs.

Edge cases. Null or empty text: all statistics 0, and scored as such. Null
doc_id: held out. Several labels of a doc_id: their mean decides, 0.5 and more
being 1; null labels do not count. Rows that share a labelled doc_id: one of them,
that of the least statistics, is learned from. No labels, or none of one kind: every score is the share of 1
(0.5 without labels). Empty table: empty result. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import textkernel as tk

SAMPLE = 40_000
HELD_OUT = 5
BINS, DEPTH, TREES, RATE, L2, LEAST_HESSIAN = 64, 4, 80, 0.15, 1.0, 2.0
ACCEPT = 0.3

_KINDS = ("lower", "upper", "digit", "space", "newline", "control", "dot", "comma", "pipe", "bang", "ask", "marks", "brackets", "quotes", "other", "lead", "tail")


def _kinds() -> np.ndarray:
    table = np.full(256, _KINDS.index("other"), np.uint8)
    for name, members in {
        "control": bytes(range(32)) + b"\x7f", "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
        "space": b" \t", "newline": b"\n\r", "dot": b".", "comma": b",;:", "pipe": b"|", "bang": b"!", "ask": b"?", "marks": b"%&$#*@~^=+<>_", "brackets": b"()[]{}", "quotes": b"'\"`-/\\",
        "lead": bytes(range(0xC0, 256)), "tail": bytes(range(0x80, 0xC0)),
    }.items():
        table[list(members)] = _KINDS.index(name)
    return table


_TABLE = _kinds()
FEATURES = (*_KINDS, "log_bytes", "log_words", "word_mean", "word_sd", "word_max", "word_one", "words_distinct", "word_top", "runs_distinct", "log_lines", "line_mean", "line_sd", "lines_distinct", "marked_ends", "upper_starts")


def statistics_of(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, bounds = tk.text_bytes(column)
    out = np.zeros((len(bounds) - 1, len(FEATURES)), np.float32)
    lines_of = tk.separators((0x0A, 0x0A))
    for a, b in tk.text_slices(bounds, 2 * tk.PIECE):
        part, cut = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        h, s, e, first = tk.hash_words(part, cut, tk.SPACES)
        runs = tk.chain(h, np.arange(max(0, len(h) - 2)), 3) if len(h) > 2 else h[:0]
        lh, ls, le, lfirst = tk.hash_words(part, cut, lines_of)
        kinds = _TABLE[part]
        lengths = (e - s).astype(np.float64)
        last, begin = (kinds[e - 1], kinds[s]) if len(s) else (kinds[:0], kinds[:0])
        odd = (last == _KINDS.index("marks")) | (last == _KINDS.index("bang")) | (last == _KINDS.index("pipe"))
        upper = begin == _KINDS.index("upper")
        for k in range(b - a):
            lo, hi = cut[k], cut[k + 1]
            if hi == lo:
                continue
            row = out[a + k]
            row[: len(_KINDS)] = np.bincount(kinds[lo:hi], minlength=len(_KINDS)) / (hi - lo)
            w, v = first[k], first[k + 1]
            n = v - w
            stats = [np.log1p(hi - lo), np.log1p(n)]
            if n:
                x = lengths[w:v]
                _, counts = np.unique(h[w:v], return_counts=True)
                m = x.mean()
                stats += [m, np.sqrt(max(0.0, (x * x).mean() - m * m)), x.max(), (x == 1).mean(), len(counts) / n, counts.max() / n]
                stats.append(len(np.unique(runs[w : v - 2])) / (n - 2) if n > 2 else 1.0)
            else:
                stats += [0.0] * 7
            y = (le - ls)[lfirst[k] : lfirst[k + 1]].astype(np.float64)
            if len(y):
                stats += [np.log1p(len(y)), y.mean(), y.std(), len(np.unique(lh[lfirst[k] : lfirst[k + 1]])) / len(y)]
            else:
                stats += [0.0] * 4
            stats += [odd[w:v].mean() if n else 0.0, upper[w:v].mean() if n else 0.0]
            row[len(_KINDS) :] = stats
    return out


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth; node k has the children 2k + 1 (at most the threshold) and 2k + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.leaf):
            trees = np.arange(len(self.leaf))
            inner = self.feature.shape[1]
            for lo in range(0, len(x), 4096):
                rows = x[lo : lo + 4096]
                at = np.zeros((len(rows), len(trees)), np.int64)
                for _ in range((inner + 1).bit_length() - 1):
                    right = rows[np.arange(len(rows))[:, None], self.feature[trees, at]] > self.threshold[trees, at]
                    at = 2 * at + 1 + right
                total[lo : lo + 4096] += self.leaf[trees, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees for the log-odds of ``y`` (0 or 1), grown level by level."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Trees(np.zeros((0, 0), np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 1)), float(np.log(share / (1 - share))))
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(m)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(m)], axis=1).astype(np.int64)
    flat = binned + np.arange(m) * BINS
    inner = 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1))
    score = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, off = 2**level, 2**level - 1
            cell = (node[:, None] * (m * BINS) + flat).ravel()
            gs = np.bincount(cell, np.repeat(g, m), width * m * BINS).reshape(width, m, BINS).cumsum(axis=2)
            hs = np.bincount(cell, np.repeat(h, m), width * m * BINS).reshape(width, m, BINS).cumsum(axis=2)
            gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
            gain[(hs < LEAST_HESSIAN) | (ht - hs < LEAST_HESSIAN)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            use = gain.reshape(width, -1).max(axis=1) > 1e-6
            f, k = best // BINS, best % BINS
            stop = np.where(use, k, BINS)
            feature[t, off : off + width] = np.where(use, f, 0)
            threshold[t, off : off + width] = [edges[f[j]][k[j]] if use[j] and k[j] < len(edges[f[j]]) else np.inf for j in range(width)]
            node = 2 * node + (binned[np.arange(n), f[node]] > stop[node])
        gl, hl = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        leaf[t] = RATE * gl / (hl + L2)
        score += leaf[t][node]
    return Trees(feature, threshold, leaf, base)


def _features(batches):
    for batch in batches:
        x = statistics_of(batch.column("text"))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), lists], ["doc_id", "label", "x"])


def _scorer(model, whole: bool):
    def run(batches):
        trees = model.value
        for batch in batches:
            kept = [c for c in batch.schema.names if whole or c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(trees.score(statistics_of(batch.column("text"))))], [*kept, "score"])

    return run


def held_out(doc_id: Column, parts: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fit on documents with a label that are not held out; at most ``sample``, those of the least hash."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    some = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # ``sample`` ids at most
    kind = docs.schema["doc_id"].dataType.simpleString()
    fitted = rows.mapInArrow(tk.lean(_features), f"doc_id {kind}, label int, x array<float>").groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("f")).select("doc_id", "f.*").orderBy("doc_id").toArrow()
    x = np.asarray(fitted.column("x").combine_chunks().flatten(), np.float32).reshape(-1, len(FEATURES))
    return fit(x, np.asarray(fitted.column("label"), np.float64))


def score(spark: SparkSession, docs: DataFrame, model: Trees, whole: bool = False) -> DataFrame:
    """doc_id and score for each row of ``docs``, or all its columns and score; the model has a fixed size."""
    rows = docs if whole else docs.select("doc_id", "text")
    if "score" in rows.columns:
        raise ValueError("a column in the way: score")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if whole or f.name != "text")
    return rows.mapInArrow(tk.lean(_scorer(spark.sparkContext.broadcast(model), whole)), f"{kept}, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, scored by a model of ``labels.quality``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(spark, docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
