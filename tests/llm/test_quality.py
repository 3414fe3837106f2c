import zlib

import numpy as np

from lexiloom.llm import quality


def corpus(n=400):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice(list("abcdefg"), 5)) for _ in range(60)]
        bad = k % 4 == 0
        rows.append((k, " ".join(w + "%%%" for w in words) if bad else " ".join(words) + ".", "x", 0.5))
        labels.append((k, 0 if bad else 1, 0))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    rows += [(9001, None, "x", 0.0), (9002, "", "x", 0.0), (None, "a b c", "x", 0.0), (3, "other text", "x", 0.0), (9003, "w" * 2_000_000, "x", 0.0)]
    labels += [(1, None, 0), (None, 0, 0), (5, 1, 0), (77777, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(docs, marks)
    out = quality.score(spark, docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean([(r["score"] >= 0.3) == (r["doc_id"] % 4 != 0) for r in held]) > 0.95
    assert quality.score(spark, docs.limit(0), model).count() == 0


def test_without_labels_every_score_is_a_half(spark):
    docs = spark.createDataFrame(corpus(5)[0], "doc_id long, text string, label string, score double")
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score"] for r in quality.score(spark, docs, model).collect()} == {0.5}


def test_flat_traversal_is_that_of_the_nodes():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 5)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    model = quality.fit(x, y, trees=12)
    for row, got in zip(x[:40], model.score(x[:40]), strict=True):
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            total += leaf[k - len(f)]
        assert abs(1 / (1 + np.exp(-total)) - got) < 1e-12
    assert ((model.score(x) > 0.5) == y).mean() > 0.85
