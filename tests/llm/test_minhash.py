import random

import numpy as np
import pytest

from lexiloom.llm import minhash

SCHEMA = "doc_id long, text string, rep long, n long"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, k = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 6, 40, 120, 200]))]
        for _ in range(rng.choice([1, 1, 2, 4, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            base = copy if rng.random() < 0.4 else base  # chains
            rows.append((k, " ".join(copy), 1, 1))
            k += 1
    rng.shuffle(rows)
    return rows + [(k, None, 1, 1), (k + 1, "", 1, 1), (k + 2, " \n", 1, 1), (k + 3, "Same Words", 1, 1), (k + 4, "same  words", 1, 1), (k + 5, "word " * 60_000, 1, 1)]


def test_components_match_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    out = minhash.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out) and len(out) == len(rows)


def test_pairs_in_a_crowd_of_one_template(spark):
    """All share 210 of 230 shingles (0.84); each odd one of the last 24 has two more in common with the one before it (0.8548)."""
    template, rows = [f"t{i}" for i in range(214)], []
    for k in range(1024):
        tail = [f"{k}x{i}" for i in range(20)]
        if k >= 1000 and k % 2:
            tail[:2] = [f"{k - 1}x0", f"{k - 1}x1"]
        rows.append((k, " ".join(template + tail), 1, 1))
    out = minhash.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == {k: (230, k - k % 2 if k >= 1000 else k) for k in range(1024)}


def test_odd_rows(spark):
    text = "a b c d e f g"
    rows = [(5, text, 0, 0), (5, text, 0, 0), (None, text, 0, 0), (None, None, 0, 0), (7, "x y z", 0, 0), (7, "p q r", 0, 0), (9, "x y z", 0, 0), (4, "p q r", 0, 0)]
    out = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect() if r["n_shingles"])
    assert out == [(-1, 3, 5, False), (4, 1, 4, True), (5, 3, 5, True), (5, 3, 5, True), (7, 1, 4, False), (7, 1, 4, False), (9, 1, 4, False)]
    assert minhash.near_duplicates(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_text_of_an_id_can_link(spark):
    """Two long texts under one id, each with a near copy of its own."""
    rng, rows = random.Random(9), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    for k in range(20):
        one, two = [word() for _ in range(150)], [word() for _ in range(150)]
        near = lambda t: " ".join([*t[:70], "odd", *t[71:]])
        rows += [(10 * k + 5, " ".join(one), 0, 0), (10 * k + 5, " ".join(two), 0, 0), (10 * k + 6, near(one), 0, 0), (10 * k + 3, near(two), 0, 0)]
    out = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert out == {(10 * k + d, 10 * k + 3) for k in range(20) for d in (3, 5, 6)}
    with pytest.raises(TypeError):
        minhash.near_duplicates(spark, spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_bins_keep_their_least_and_borrow():
    rng = np.random.default_rng(0)
    sets = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2))
    low = np.array([sets[(sets.astype(object) * minhash.BINS) // 2**64 == b].min() for b in range(minhash.BINS)], dtype=np.uint64)
    at = np.searchsorted(sets, minhash._edges)
    assert (sets[at] == low).all()
    assert len(minhash.band_keys(sets[:1])) == minhash.BANDS
