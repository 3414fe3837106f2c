"""Language-model scoring by subword lattices.

A word, with a leading space as its mark, is a lattice of all its segmentations
into pieces of an existing vocabulary. Each piece has a probability; a
segmentation's is their product and a word's the sum over its segmentations, by a
forward recursion in log space. Every byte is a piece, so that every text has a
probability. A text is a sequence of words and one end, which the model emits with
a probability of its own:
log10 P(text) = sum over words of log10 P(word) + log10 P(end).

The pieces are those of a public tokenizer that are of use in lower-cased text.
No unigram vocabulary is at hand, only a pair-merging one whose scores are ranks:
they give the first probabilities, 1 / (rank + RANK), and rounds of expectation
maximisation over all distinct words of the training documents, weighted by
their counts, fit them (forward-backward over the lattices). The vocabulary itself
stays as it is.

Counts of words cover all training documents. The HEAD most frequent words at
most are broadcast with their counts and probabilities; other words' lattices are
walked where they occur, and their counts come by a join, so that neither the
driver nor a worker holds a table that grows without end. Words are known by
64-bit hashes beside their bytes.

Edge cases. Null or empty text: the end alone. Null doc_id: held out. Very long
words go through the same recursion one by one. No training document: the first
probabilities, and the end counts as once seen; base_score is then 0-count
smoothing of an empty table (log10 1). Repeated rows each count and each get
their score. Empty table: empty result. Other columns are not looked at.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import exp, inf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import textkernel as tk
from lexiloom.llm.quality import held_out
from lexiloom.llm.scratch import Scratch

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
RANK = 10.0
ROUNDS = 2
FLOOR = 0.1
HEAD = 1_000_000
HELD_OUT = 10
SMOOTH = 0.1
#: Words of more bytes are walked one by one.
LONG = 128
_CHUNK = 8192
_LN10 = float(np.log(10))


def load_pieces(path: str = VOCABULARY) -> list[bytes]:
    """Pieces by rank, with a space for the word mark; all 256 bytes are among them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    by_rank = sorted((i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))), key=lambda i: (-model.get_score(i), i))
    found = dict.fromkeys(model.id_to_piece(i).replace("▁", " ").encode() for i in by_rank)
    usable = [p for p in found if b" " not in p[1:] and not any(65 <= c <= 90 for c in p)]
    return list(dict.fromkeys(usable + [bytes([c]) for c in range(256)]))


def _piece_hash(text: np.ndarray, n: int) -> np.ndarray:
    return text + np.uint64(n * 0xA24BAED4963EE407 % 2**64)


class Pieces:
    """The vocabulary, found by hash: one probe of a table, and a search where two pieces fall on one slot."""

    SLOT_BITS = 20

    def __init__(self, pieces: list[bytes]):
        self.longest = max(map(len, pieces))
        up, _ = tk.powers(self.longest + 1)
        sums = [((np.frombuffer(p, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(p)]).sum(dtype=np.uint64, keepdims=True) for p in pieces]
        keys = np.concatenate([_piece_hash(s, len(p)) for s, p in zip(sums, pieces, strict=True)])
        self.keys = keys
        self.by_key = np.argsort(keys)
        slots = self._slot(keys)
        self.table = np.full(1 << self.SLOT_BITS, -1, np.int32)
        order, count = np.unique(slots, return_counts=True)
        self.table[slots] = np.arange(len(keys), dtype=np.int32)
        self.table[order[count > 1]] = -2

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (tk.mix(keys) >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``keys`` that are pieces, and which."""
        got = self.table[self._slot(keys)]
        at = np.flatnonzero(got != -1)
        got = got[at]
        if len(two := np.flatnonzero(got == -2)):
            k = np.searchsorted(self.keys, keys[at[two]], sorter=self.by_key).clip(0, len(self.keys) - 1)
            got[two] = self.by_key[k]
        ok = self.keys[got] == keys[at]
        return at[ok], got[ok]


def _arcs(pieces: Pieces, chars: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, rows, pieces) of all arcs of the words in the rows of ``chars``, by end."""
    up, down = tk.powers(chars.shape[1] + 1)
    sums = np.zeros((len(chars), chars.shape[1] + 1), np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up[: chars.shape[1]], axis=1, out=sums[:, 1:])
    for end in range(1, chars.shape[1] + 1):
        live = np.flatnonzero(lengths >= end)
        for start in range(max(0, end - pieces.longest), end):
            keys = _piece_hash((sums[live, end] - sums[live, start]) * down[start], end - start)
            at, which = pieces.find(keys)
            if len(at):
                yield start, end, live[at], which


def _add_logs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def _padded(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Words with a leading space, in the rows of a matrix."""
    width = int(lengths.max()) + 1
    place = np.arange(width - 1)
    at = np.minimum(starts[:, None] + place, len(data) - 1)
    return np.concatenate([np.full((len(starts), 1), 32, np.uint8), np.where(place < lengths[:, None], data[at], 0).astype(np.uint8)], axis=1)


def word_logs(pieces: Pieces, logs: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log of each word's probability; with ``weights`` also the expected counts of the pieces.

    ``data`` holds the bytes of the words with A-Z lowered.
    """
    out = np.empty(len(starts))
    expected = None if weights is None else np.zeros(len(logs))
    by = np.argsort(lengths, kind="stable")
    short = by[lengths[by] <= LONG]
    for lo in range(0, len(short), _CHUNK):
        rows = short[lo : lo + _CHUNK]
        n = lengths[rows] + 1
        arcs = list(_arcs(pieces, _padded(data, starts[rows], lengths[rows]), n))
        ahead = np.full((len(rows), int(n.max()) + 1), -np.inf)
        ahead[:, 0] = 0
        for start, end, at, which in arcs:
            ahead[at, end] = _add_logs(ahead[at, end], ahead[at, start] + logs[which])
        out[rows] = ahead[np.arange(len(rows)), n]
        if expected is not None:
            back = np.full_like(ahead, -np.inf)
            back[np.arange(len(rows)), n] = 0
            whole = out[rows]
            for start, end, at, which in reversed(arcs):
                step = logs[which] + back[at, end]
                back[at, start] = _add_logs(back[at, start], step)
                expected += np.bincount(which, np.exp(ahead[at, start] + step - whole[at]) * weights[rows[at]], len(expected))
    for k in by[len(short) :].tolist():
        out[k] = _one_word(pieces, logs, data[starts[k] : starts[k] + lengths[k]], expected, 0.0 if weights is None else float(weights[k]))
    return out, expected


def _blocks_of_arcs(chars: np.ndarray, size: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """First and last end position of the blocks of a long word."""
    for lo in range(0, len(chars), size):
        yield lo, min(len(chars), lo + size)


def _block_arcs(pieces: Pieces, chars: np.ndarray, lo: int, hi: int) -> tuple[list[int], list[int], list[int]]:
    """Lengths and pieces of all arcs that end at lo + 1 to hi, by end, and where each end's begin."""
    base = max(0, lo - pieces.longest)
    up, down = tk.powers(hi - base + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((chars[base:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - base], dtype=np.uint64)])
    ends, sizes, which = [], [], []
    for size in range(1, min(pieces.longest, hi) + 1):
        end = np.arange(max(lo + 1, size), hi + 1)
        s = end - size - base
        at, got = pieces.find(_piece_hash((sums[end - base] - sums[s]) * down[s], size))
        ends.append(end[at])
        sizes.append(np.full(len(at), size))
        which.append(got)
    ends, sizes, which = np.concatenate(ends), np.concatenate(sizes), np.concatenate(which)
    by = np.argsort(ends, kind="stable")
    return sizes[by].tolist(), which[by].tolist(), np.searchsorted(ends[by], np.arange(lo + 1, hi + 2)).tolist()


def _one_word(pieces: Pieces, logs: np.ndarray, word: np.ndarray, expected: np.ndarray | None, weight: float) -> float:
    """The same for one long word, block by block of positions; arcs are found again for the way back, not kept."""
    chars = np.concatenate([[np.uint8(32)], word])
    total, table = len(chars), logs.tolist()
    ahead = array("d", [0.0])
    for lo, hi in _blocks_of_arcs(chars):
        sizes, which, cut = _block_arcs(pieces, chars, lo, hi)
        for end in range(lo + 1, hi + 1):
            x = [ahead[end - sizes[j]] + table[which[j]] for j in range(cut[end - lo - 1], cut[end - lo])]
            m = max(x)
            ahead.append(m + log(sum(exp(y - m) for y in x)))
    if expected is not None:
        back = array("d", [-inf]) * (total + 1)
        back[total] = 0.0
        for lo, hi in reversed(list(_blocks_of_arcs(chars))):
            sizes, which, cut = _block_arcs(pieces, chars, lo, hi)
            for end in range(hi, lo, -1):
                for j in range(cut[end - lo - 1], cut[end - lo]):
                    start, step = end - sizes[j], table[which[j]] + back[end]
                    expected[which[j]] += weight * exp(ahead[start] + step - ahead[total])
                    old = back[start]
                    m = max(old, step)
                    back[start] = m + log(exp(old - m) + exp(step - m))
    return ahead[total]


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(load_pieces(path))


_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of bytes, lowered, as a binary array."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_LOWERED[data[at]])])


def _texts(batch):
    data, bounds = tk.text_bytes(batch.column("text"))
    for a, b in tk.text_slices(bounds, 4 * tk.PIECE):
        part = data[bounds[a] : bounds[b]]
        yield a, b, part, *tk.hash_words(part, bounds[a : b + 1] - bounds[a], tk.SPACES)


def _count(batches):
    """Distinct words of runs of documents with their counts."""
    for batch in batches:
        for _, _, data, h, s, e, _ in _texts(batch):
            if not len(h):
                continue
            u, at, n = np.unique(h, return_index=True, return_counts=True)
            words = _gather(data, s[at], e[at])
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), words.cast(pa.binary()), pa.array(n.astype(np.int64))], ["h", "word", "n"])


def _words(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, bounds = tk.text_bytes(batch.column("word"))
    return np.ascontiguousarray(data), bounds[:-1], np.diff(bounds)


def _expect(path: str, shared):
    def run(batches):
        total = None
        for batch in batches:
            _, got = word_logs(_pieces(path), shared.value, *_words(batch), np.asarray(batch.column("n"), np.float64))
            total = got if total is None else total + got
        if total is not None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["piece", "expected"])

    return run


def _log_words(path: str, shared):
    def run(batches):
        for batch in batches:
            lp, _ = word_logs(_pieces(path), shared.value, *_words(batch))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("n"), pa.array(lp)], ["h", "n", "lp"])

    return run


@dataclass(frozen=True)
class Model:
    """Pieces' natural logs, the end's, the head of the word counts (sorted by hash), and the totals of the base."""

    path: str
    logs: np.ndarray
    end: float
    head: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    whole: bool
    tokens: int
    kinds: int
    ends: int

    def base(self, count):
        return np.log10((count + SMOOTH) / (self.tokens + SMOOTH * (self.kinds + 1)))


def _scores(shared):
    def run(batches):
        m = shared.value
        end_base = float(m.base(m.ends))
        for batch in batches:
            tokens, known, base, score = (np.zeros(batch.num_rows, t) for t in (np.int64, np.int64, float, float))
            tails, tail_at = [], np.zeros(batch.num_rows + 1, np.int64)
            for a, b, data, h, s, e, first in _texts(batch):
                u, at, inverse = np.unique(h, return_index=True, return_inverse=True)
                k = np.searchsorted(m.head, u)
                ok = k < len(m.head)
                ok[ok] = m.head[k[ok]] == u[ok]
                n, lp = np.zeros(len(u), np.int64), np.zeros(len(u))
                n[ok], lp[ok] = m.counts[k[ok]], m.words[k[ok]]
                rest = np.flatnonzero(~ok)
                if len(rest):
                    lp[rest] = word_logs(_pieces(m.path), m.logs, _LOWERED[data], s[at[rest]], (e - s)[at[rest]])[0]
                has = n > 0
                text = np.repeat(np.arange(b - a), np.diff(first))
                size = b - a
                tokens[a:b] = np.diff(first) + 1
                known[a:b] = np.bincount(text, has[inverse], size).astype(np.int64) + (m.ends > 0)
                settled = has | m.whole
                base[a:b] = np.bincount(text, np.where(settled, m.base(n), 0.0)[inverse], size) + end_base
                score[a:b] = (np.bincount(text, lp[inverse], size) + m.end) / _LN10
                if not m.whole:
                    open_ = np.flatnonzero(~settled[inverse])
                    by = np.lexsort((h[open_], text[open_]))
                    th, tt = h[open_][by], text[open_][by]
                    new = np.flatnonzero(np.append(True, (th[1:] != th[:-1]) | (tt[1:] != tt[:-1]))) if len(th) else np.zeros(0, np.int64)
                    tails.append((th[new], np.diff(np.append(new, len(th)))))
                    tail_at[a + 1 : b + 1] = np.bincount(tt[new], minlength=size)
            th = np.concatenate([x for x, _ in tails]) if tails else np.zeros(0, np.uint64)
            tn = np.concatenate([x for _, x in tails]) if tails else np.zeros(0, np.int64)
            tail = pa.ListArray.from_arrays(pa.array(np.cumsum(tail_at).astype(np.int32)), pa.StructArray.from_arrays([pa.array(th.view(np.int64)), pa.array(tn.astype(np.int64))], ["h", "k"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (tokens, known, base, score)), tail], ["doc_id", "n_tokens", "n_known", "base_score", "score", "tail"])

    return run


def count_words(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """h, word and n of all distinct words of ``docs``."""
    counted = docs.select("text").mapInArrow(tk.lean(_count), "h long, word binary, n long")
    return scratch.write(counted.groupBy("h", "word").agg(F.sum("n").alias("n")), "words")


def fit_pieces(spark: SparkSession, words: DataFrame, ends: int, path: str = VOCABULARY, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Natural logs of the pieces and of the end, by ``rounds`` of expectation maximisation over all words."""
    size = len(load_pieces(path))
    weight = 1 / (np.arange(size) + RANK)
    ends = max(ends, 1)
    end = np.log(0.01)
    logs = np.log(weight / weight.sum()) + np.log1p(-0.01)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(logs)
        got = words.select("word", "n").mapInArrow(tk.lean(_expect(path, shared)), "piece long, expected double").groupBy("piece").agg(F.sum("expected").alias("expected"))
        count = np.full(size, FLOOR)
        for r in got.collect():  # a row a piece at most
            count[r["piece"]] += r["expected"]
        shared.unpersist()
        total = count.sum() + ends
        logs, end = np.log(count / total), float(np.log(ends / total))
    return logs, float(end)


def fit(spark: SparkSession, scratch: Scratch, train: DataFrame, path: str = VOCABULARY, rounds: int = ROUNDS, head: int = HEAD) -> tuple[Model, DataFrame]:
    """The model, and the counts of all words of the training documents."""
    words = count_words(scratch, train)
    ends = train.count()
    total = words.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    logs, end = fit_pieces(spark, words, ends, path, rounds)
    # Words of ``least`` occurrences and more are ``head`` at most.
    top, least = 4096, None
    kinds = {r["c"]: r["k"] for r in words.groupBy(F.least("n", F.lit(top)).alias("c")).agg(F.count(F.lit(1)).alias("k")).collect()}
    held = 0
    for c in sorted(kinds, reverse=True):
        held += kinds[c]
        if held > head:
            break
        least = c
    least = int(total["n"]) // head + 1 if least is None else least
    shared = spark.sparkContext.broadcast(logs)
    rows = words.filter(F.col("n") >= least).mapInArrow(tk.lean(_log_words(path, shared)), "h long, n long, lp double").toArrow()
    h = np.asarray(rows.column("h")).astype(np.int64).view(np.uint64)
    by = np.argsort(h)
    column = lambda c: np.asarray(rows.column(c))[by]
    n = int(total["n"])
    model = Model(path, logs, end, h[by], column("n"), column("lp"), len(h) == total["v"], n + ends, total["v"] + (ends > 0), ends)
    return model, words


def score(spark: SparkSession, docs: DataFrame, parts: int = HELD_OUT, **how) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs``."""
    scratch = Scratch(spark, "lattice")
    docs = docs.select("doc_id", "text")
    model, words = fit(spark, scratch, docs.filter(~held_out(F.col("doc_id"), parts)), **how)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(tk.lean(_scores(spark.sparkContext.broadcast(model))), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, tail array<struct<h:long,k:long>>")
    if not model.whole:
        out = scratch.write(out.withColumn("row", F.monotonically_increasing_id()), "scored")
        tail = out.select("row", F.inline("tail")).join(words.groupBy("h").agg(F.sum("n").alias("n")), "h", "left")
        n = F.coalesce("n", F.lit(0))
        per_word = F.log10((n + F.lit(SMOOTH)) / F.lit(model.tokens + SMOOTH * (model.kinds + 1)))
        more = tail.groupBy("row").agg(F.sum(per_word * F.col("k")).alias("more"), F.sum(F.when(n > 0, F.col("k")).otherwise(0)).alias("also"))
        out = out.join(more, "row", "left")
        out = out.withColumn("base_score", F.col("base_score") + F.coalesce("more", F.lit(0.0))).withColumn("n_known", F.col("n_known") + F.coalesce("also", F.lit(0)))
    return out.select("doc_id", held_out(F.col("doc_id"), parts).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, scored by a model of those that are not held out."""
    return score(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
