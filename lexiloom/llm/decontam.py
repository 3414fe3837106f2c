"""Benchmark decontamination by a prefix-filtered join on word windows.

The windows of an item are its runs of ``size`` consecutive words; a shorter item
is one window. Tokens are ordered by rarity: by how many documents hold them,
counted over the whole corpus. A text that contains a window contains the
window's rarest token, so at full containment a prefix of one token is what two
sides must share: document words are joined with the windows filed under that
token. Where it stands in the window fixes where the window would begin
(positional bound), which leaves only starts with enough words on both sides
inside the document (length bound); the window's words are then compared one by
one. Words are compared as 64-bit hashes: a window that is not there would have to
agree with one in all of its words' hashes.

The benchmark side is taken in blocks of at most BLOCK_WORDS words, each
broadcast on its own, so that a worker's memory does not grow with the
benchmark; the corpus is read once a block to count and once to join. Of further
blocks only documents with hits leave a task.

Edge cases. Null or empty text has no words, and such an item no window. Null
doc_id is kept as it is; a null item_id stands as ``null``. Items of one id are
one item; repeated documents each get their result. Empty tables: no hits, or an
empty result. Columns other than doc_id, item_id and text are not looked at.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import textkernel as tk
from lexiloom.llm.scratch import Scratch
from lexiloom.llm.spread import left_join_grouped

WINDOW = 10
#: A block ends with the item that brings it to this many words.
BLOCK_WORDS = 1_000_000
#: Candidates compared at once.
CANDIDATES = 1 << 20


class Block:
    """Windows of some items, to be filed under their rarest tokens."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        data, bounds = tk.text_bytes(pa.array([t for _, t in items], pa.large_string()))
        words, _, _, first = tk.hash_words(data, bounds, tk.NON_ALNUM)
        known: dict[bytes, int] = {}
        rows, lengths, owners = [], [], []
        for (item, _), lo, hi in zip(items, first[:-1].tolist(), first[1:].tolist(), strict=True):
            n = min(size, hi - lo)
            for s in range(lo, hi - n + 1) if n else ():
                w = words[s : s + n]
                k = known.setdefault(w.tobytes(), len(rows))
                if k == len(rows):
                    rows.append(w)
                    lengths.append(n)
                    owners.append(set())
                owners[k].add(item)
        self.lengths = np.array(lengths, np.int64)
        self.words = np.zeros((len(rows), size), np.uint64)
        for k, w in enumerate(rows):
            self.words[k, : len(w)] = w
        self.owners = [sorted(x) for x in owners]
        self.vocabulary = np.unique(words)

    def order(self, held: np.ndarray) -> None:
        """File each window under its rarest token; ``held`` is by vocabulary, the documents that hold the token."""
        rank = np.empty(len(held), np.int64)
        rank[np.lexsort((self.vocabulary, held))] = np.arange(len(held))
        place = np.searchsorted(self.vocabulary, self.words).clip(0, max(0, len(held) - 1))
        ranks = np.where(np.arange(self.words.shape[1]) < self.lengths[:, None], rank[place], len(held)) if len(held) else np.zeros(self.words.shape, np.int64)
        self.at = ranks.argmin(axis=1) if len(ranks) else np.zeros(0, np.int64)
        prefix = self.words[np.arange(len(self.words)), self.at]
        by = np.argsort(prefix, kind="stable")
        self.tokens, start = np.unique(prefix[by], return_index=True)
        self.filed, self.start = by, np.append(start, len(by))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.tokens >> np.uint64(44)] = True

    def find(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and window of each occurrence."""
        near = np.flatnonzero(self.maybe[words >> np.uint64(44)])
        k = np.searchsorted(self.tokens, words[near])
        ok = k < len(self.tokens)
        ok[ok] = self.tokens[k[ok]] == words[near[ok]]
        near, k = near[ok], k[ok]
        counts = self.start[k + 1] - self.start[k]
        found = []
        ends = np.cumsum(counts)
        lo = 0
        while lo < len(near):  # as many positions as give about CANDIDATES candidates
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CANDIDATES, "right")))
            c = counts[lo:hi]
            inner = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            window = self.filed[np.repeat(self.start[k[lo:hi]], c) + inner]
            begin = np.repeat(near[lo:hi], c) - self.at[window]
            text = np.searchsorted(first, np.repeat(near[lo:hi], c), "right") - 1
            ok = (begin >= first[text]) & (begin + self.lengths[window] <= first[text + 1])
            window, begin, text = window[ok], begin[ok], text[ok]
            for j in range(self.words.shape[1]):
                ok = (j >= self.lengths[window]) | (words[np.minimum(begin + j, len(words) - 1)] == self.words[window, j])
                window, begin, text = window[ok], begin[ok], text[ok]
            found.append((text, begin, window))
            lo = hi
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _texts(batch):
    data, bounds = tk.text_bytes(batch.column("text"))
    for a, b in tk.text_slices(bounds):
        words, _, _, first = tk.hash_words(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], tk.NON_ALNUM)
        yield words, first


def _held(shared):
    def run(batches):
        vocabulary = shared.value
        maybe = np.zeros(1 << 20, bool)
        maybe[vocabulary >> np.uint64(44)] = True
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for words, first in _texts(batch):
                near = np.flatnonzero(maybe[words >> np.uint64(44)])
                k = np.searchsorted(vocabulary, words[near])
                ok = k < len(vocabulary)
                ok[ok] = vocabulary[k[ok]] == words[near[ok]]
                text = np.searchsorted(first, near[ok], "right") - 1
                pairs = np.unique(text * len(vocabulary) + k[ok])
                total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["token", "held"])

    return run


def _merge(begin: np.ndarray, end: np.ndarray) -> list[dict]:
    by = np.argsort(begin, kind="stable")
    begin, reach = begin[by], np.maximum.accumulate(end[by])
    new = np.append(True, begin[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return [{"s": int(s), "e": int(e)} for s, e in zip(begin[at], reach[np.append(at[1:], len(begin)) - 1], strict=True)]


_SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def _join(shared, whole: bool = False):
    def run(batches):
        block = shared.value
        for batch in batches:
            sizes, spans, items = [], [], []
            for words, first in _texts(batch):
                text, begin, window = block.find(words, first)
                by = np.argsort(text, kind="stable")
                text, begin, window = text[by], begin[by], window[by]
                end = begin + block.lengths[window]
                hit, cut = np.unique(text, return_index=True)
                cut = [*cut.tolist(), len(text)]
                place = {t: k for k, t in enumerate(hit.tolist())}
                for t, n in enumerate(np.diff(first).tolist()):
                    sizes.append(n)
                    if t in place:
                        lo, hi = cut[place[t]], cut[place[t] + 1]
                        spans.append(_merge(begin[lo:hi] - first[t], end[lo:hi] - first[t]))
                        items.append(sorted({x for w in np.unique(window[lo:hi]) for x in block.owners[w]}))
                    else:
                        spans.append([])
                        items.append([])
            names = [c for c in batch.schema.names if whole or c != "text"]
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], [*names, "n_words", "spans", "items"])

    return run


def _blocks(benchmark: DataFrame, size: int, most: int):
    """Blocks of whole items, in order of item_id; the driver holds one at a time."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.col("text").alias("t")).filter("t IS NOT NULL")
    items, words = [], 0
    for r in rows.orderBy("i").toLocalIterator():
        items.append((r["i"], r["t"]))
        words += len(r["t"]) // 4 + 1
        if words >= most:
            yield Block(items, size)
            items, words = [], 0
    if items:
        yield Block(items, size)


def _covered(spans: Column) -> Column:
    """How many positions spans in order of their start cover."""
    zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, zero, lambda a, x: F.struct(F.greatest(a["upto"], x["e"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["upto"], x["s"]))).alias("n")))["n"]


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS, whole: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, spans (word positions, merged and in order) and items, sorted, for each row of ``docs``; if ``whole``, after all its columns."""
    if taken := {"n_words", "n_hit", "spans", "items"} & set(docs.columns if whole else ()):
        raise ValueError(f"columns in the way: {sorted(taken)}")
    texts = docs if whole else docs.select("doc_id", "text")
    kept = [f for f in texts.schema if whole or f.name != "text"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    schema = "n_words long, spans array<struct<s:long,e:long>>, items array<string>"
    blocks = _blocks(benchmark, size, block_words)
    first, second = next(blocks, None), next(blocks, None)

    def ready(block: Block):
        if len(block.vocabulary):
            shared = spark.sparkContext.broadcast(block.vocabulary)
            held = np.zeros(len(block.vocabulary), np.int64)
            counts = texts.select("text").mapInArrow(tk.lean(_held(shared)), "token long, held long").groupBy("token").agg(F.sum("held").alias("held"))
            for r in counts.collect():  # a row at most for each word of the block
                held[r["token"]] = r["held"]
            shared.unpersist()
            block.order(held)
        else:
            block.order(np.zeros(0, np.int64))
        return spark.sparkContext.broadcast(block)

    joined = ready(first or Block([], size))
    if second is None:
        out = texts.mapInArrow(tk.lean(_join(joined, whole)), f"{kind}, {schema}")
        return out.withColumn("n_hit", _covered(F.col("spans")))
    # A text's hits are the same wherever it stands: the texts' hashes join the blocks.
    scratch = Scratch(spark, "decontam")
    keyed = texts.withColumn("_key", F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = scratch.write(keyed.mapInArrow(tk.lean(_join(joined, whole)), f"{kind}, _key string, {schema}"), "block0")
    several, k = None, 1
    for block in chain([second], blocks):
        joined = ready(block)
        hits = scratch.write(keyed.select("_key", "text").mapInArrow(tk.lean(_join(joined)), f"_key string, {schema}").filter("size(items) > 0").select("_key", "spans", "items").distinct(), f"block{k}")
        several, k = hits if several is None else several.unionByName(hits), k + 1
        joined.unpersist()
    # One row a text and block with a hit; how often a text occurs is counted for those alone.
    more = several.groupBy("_key").agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items"))
    times = rows.join(more.select("_key"), "_key", "left_semi").groupBy("_key").agg(F.count(F.lit(1)).alias("_times"))
    out = left_join_grouped(rows, more.join(times, "_key"), ["_key"], "_times", rows.count())
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    spans = F.sort_array(F.concat("spans", F.coalesce("_spans", none)))
    items = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("_items", F.array().cast("array<string>")))))
    return out.select(*[f.name for f in kept], "n_words", spans.alias("spans"), items.alias("items")).withColumn("n_hit", _covered(F.col("spans")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all ``benchmark`` items, in windows of ten words."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    out = contamination(spark, read("documents"), read("benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Every run of words of a window's length, joined with the windows.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, list_aggregate(w[p : p + least(10, len(w)) - 1], 'string_agg', ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
runs AS (SELECT doc_id, n, p, list_aggregate(w[p : p + n - 1], 'string_agg', ' ') AS k
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, p, n, item_id FROM runs JOIN win USING (n, k)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
