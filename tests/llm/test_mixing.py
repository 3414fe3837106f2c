from collections import defaultdict

from pyspark.sql import functions as F

from lexiloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, n_chars long"


def water_fill(sizes):
    """Targets by repeated resharing of the excess."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left = {}, 1.5 * sum(sizes.values())
    open_ = set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_and_taken(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), f"s{i % 5}" if i % 3 else "s0", 1) for i in range(900)]
    rows += [(5000, None, "s1", 1), (5001, "", None, 1), (5002, "a b c", None, 1), (None, "x y", "s2", 1), (7, " ".join(["w"] * (1 + 49 % 40)), "s2", 1)]
    out = mixing.taken(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in out:
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        taken[r["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 2
    want = water_fill(size)
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= 40
    assert sum(taken.values()) <= 1.5 * sum(size.values())


def test_mix_repeats_rows_and_keeps_columns(spark):
    rows = [(i, "a b c d", "s" + str(i % 2), i) for i in range(40)] + [(0, "a b c d", "s0", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix(spark, docs)
    assert mixed.columns == docs.columns
    words = sum(4 for _ in mixed.collect())
    assert 0.95 * 1.5 * 164 <= words <= 1.5 * 164


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.taken(spark, docs).count() == 0
    assert mixing.mix(spark, docs).count() == 0
    only_empty = spark.createDataFrame([(1, None, None, 0), (2, " ", "x", 0)], SCHEMA)
    assert {(r["doc_id"], r["size"], r["copies"]) for r in mixing.taken(spark, only_empty).collect()} == {(1, 0, 0), (2, 0, 0)}


def test_half_of_the_rows_without_an_id(spark):
    """Rows alike in all keys share what is taken, spread over all buckets; copies come out whole."""
    rows = [(None, "a b c", "s0", 1)] * 12_000 + [(i, "w " * (1 + i % 9), f"s{i % 3}", 1) for i in range(12_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    took = mixing.taken(spark, docs)
    by = {(r["source"], r["target"]): r["w"] for r in took.groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("w")).collect()}
    assert all(abs(w - t) <= 0.01 * t + 20 for (_, t), w in by.items())
    sized, queue = mixing.schedule(spark, docs)
    assert queue.groupBy("_h").count().agg(F.max("count")).first()[0] <= 2 * mixing.LIKE_ROWS
    out = mixing.mix(spark, docs)
    assert out.columns == docs.columns
    count = lambda d, c: sorted((r["doc_id"] or -1, r["n"]) for r in d.groupBy("doc_id").agg(c.alias("n")).filter("n > 0").collect())
    assert count(out, F.count("*")) == count(took, F.sum("copies"))
    names = spark.createDataFrame([("a", "x y", "s"), ("b", "x y", "s")], "doc_id string, text string, source string")
    assert mixing.mix(spark, names).count() == 3
