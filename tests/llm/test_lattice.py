import math
import random
import zlib
from collections import Counter

import numpy as np

from lexiloom.llm import lattice

SCHEMA = "doc_id long, text string, h string, row long"


def corpus():
    rng = random.Random(1)
    vocab = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    rows = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40))), "x", 1) for k in range(120)]
    return rows + [(500, None, "x", 1), (501, "  ", "x", 1), (None, "The new", "x", 1), (502, "É\u00a0x " + "long" * 300 + " " + "b" * 70_000, "x", 1), (3, "a a a", "x", 1)]


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def test_base_and_counts_with_and_without_a_tail(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    c = Counter(t for i, text, *_ in rows if not held(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    scores = []
    for head in (lattice.HEAD, 20):
        out = lattice.score(spark, docs, head=head, rounds=1).collect()
        got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)
        want = Counter((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for i, t, *_ in rows)
        assert got == want
        scores.append(sorted(r["score"] for r in out))
    assert np.allclose(scores[0], scores[1]) and max(scores[0]) < 0


def test_empty(spark):
    assert lattice.score(spark, spark.createDataFrame([], SCHEMA), rounds=1).count() == 0


def brute(word, prob):
    chars, ahead = b" " + word, [1.0] + [0.0] * (len(word) + 1)
    for j in range(1, len(chars) + 1):
        ahead[j] = sum(ahead[i] * prob.get(chars[i:j], 0.0) for i in range(j))
    return math.log(ahead[-1])


def test_forward_sums_all_segmentations_and_expectations_add_up(monkeypatch):
    pieces = lattice.load_pieces()
    weight = 1 / (np.arange(len(pieces)) + 10.0)
    logs = np.log(weight / weight.sum())
    prob = dict(zip(pieces, np.exp(logs).tolist(), strict=True))
    words = [b"the", b"x", "ciónes".encode(), b"thationing", b"a" * 60, bytes(range(128, 160))]
    data = np.frombuffer(b"".join(words), np.uint8)
    n = np.array([len(w) for w in words])
    results = []
    for long in (lattice.LONG, 0):
        monkeypatch.setattr(lattice, "LONG", long)
        out, expected = lattice.word_logs(lattice._pieces(lattice.VOCABULARY), logs, data, np.cumsum(n) - n, n, np.ones(len(words)))
        assert np.allclose(out, [brute(w, prob) for w in words])
        # Expected counts times lengths are the bytes of the words with their marks.
        assert abs((expected * [len(p) for p in pieces]).sum() - (n + 1).sum()) < 1e-6
        results.append(expected)
    assert np.allclose(results[0], results[1])


def test_training_raises_the_likelihood(spark):
    rows = [r for r in corpus() if r[0] is None or r[0] < 500]
    docs = spark.createDataFrame(rows, SCHEMA)
    total = [sum(r["score"] for r in lattice.score(spark, docs, rounds=k).collect()) for k in (0, 1, 3)]
    assert total[0] < total[1] < total[2]
