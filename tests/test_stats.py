import math
import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import stats


def corpus(spark, *lines, par=()):
    rows = [("c", 0, k, k in par, line.split()) for k, line in enumerate(lines)]
    return spark.createDataFrame(rows, "corpus string, page long, line_no int, par_start boolean, words array<string>")


def one(df):
    return df.first().asDict()


@pytest.mark.parametrize("counts,bits", [([5, 5, 5, 5], 2), ([42], 0), ([7, 7], 1), ([2, 1, 1], 1.5), ([3, 0, 3], 1)])
def test_entropy_of_counts(spark, counts, bits):
    df = spark.createDataFrame([("c", c) for c in counts], "corpus string, n long")
    assert one(stats.entropy(df, ["corpus"]))["entropy"] == pytest.approx(bits)


def test_entropy_rejects_negative_counts(spark):
    with pytest.raises(Exception, match="negative"):
        stats.entropy(spark.createDataFrame([("c", -1)], "corpus string, n long"), ["corpus"]).collect()


def test_stream_entropies(spark):
    got = one(stats.entropies(stats.types(corpus(spark, "abcd"))))
    assert got["h0"] == got["h1"] == 2
    assert one(stats.entropies(stats.types(corpus(spark, "abababababab"))))["h2"] == pytest.approx(0)
    assert one(stats.entropies(stats.types(corpus(spark, "aabba"))))["h2"] == pytest.approx(1)
    assert one(stats.entropies(stats.types(corpus(spark, "ab", "ab"))))["h2"] == pytest.approx(0)
    # The separator is a symbol between words of a line and nowhere else.
    assert {r["glyph"]: r["n"] for r in stats.glyph_counts(stats.types(corpus(spark, "a b", "a"))).collect()} == {"a": 2, "b": 1, ".": 1}


def test_zipf(spark):
    frame = lambda f: spark.createDataFrame([("c", str(k), n) for k, n in enumerate(f)], "corpus string, word string, n long")
    got = one(stats.zipf(frame([round(5_040_000 / r) for r in range(1, 10)]), least=1))
    assert got["zipf_slope"] == pytest.approx(-1) and got["zipf_r2"] == pytest.approx(1) and got["zipf_ranks"] == 9
    flat = one(stats.zipf(frame([7] * 10), least=1))
    assert flat["zipf_slope"] == 0 and flat["zipf_r2"] == 1
    single = one(stats.zipf(frame([8, 1])))
    assert (single["zipf_slope"], single["zipf_intercept"], single["zipf_r2"], single["zipf_ranks"]) == (0, 3, 0, 1)


def test_lengths_and_vocabulary(spark):
    got = one(stats.length_stats(stats.types(corpus(spark, "aaaaa bbbbb ccccc ddd eeeeeee"))))
    assert got["length_mean"] == 5 and got["length_mode"] == 5 and got["length_sd"] == pytest.approx(math.sqrt(1.6))
    assert one(stats.length_stats(stats.types(corpus(spark, "d@194;n a"))))["glyphs"] == 4
    assert one(stats.vocabulary(stats.types(corpus(spark, "a a a a a b c c d"))))["hapax_rate"] == 0.5


def test_mattr_against_all_windows(spark, monkeypatch):
    rng = random.Random(0)
    for n, w, block in ((3, 10, 1 << 20), (4, 3, 1 << 20), (60, 7, 1 << 20), (60, 7, 9), (60, 60, 16), (61, 13, 13)):
        monkeypatch.setattr(stats, "INDEX_BLOCK", block)
        words = [rng.choice("abcdefgh") for _ in range(n)]
        lines = corpus(spark, *[" ".join(words[k : k + 5]) for k in range(0, n, 5)])
        windows = [words[s : s + w] for s in range(n - w + 1)] or [words]
        want = sum(len(set(x)) / len(x) for x in windows) / len(windows)
        assert one(stats.mattr(lines, window=w))["mattr"] == pytest.approx(want)
    with pytest.raises(ValueError):
        stats.mattr(lines, window=0)


def test_positions_and_follow(spark):
    kinds = stats.types(corpus(spark, "qokeedy qokal daiin y"))
    p = {r["glyph"]: r for r in stats.positions(kinds).collect()}
    assert p["q"]["initial"] == 2 and p["y"]["final"] == 2 and p["l"]["final"] == 1 and p["o"]["total"] == 2 and p["y"]["initial"] == 1 and p["y"]["bin0"] == 1
    got = one(stats.follow(stats.types(corpus(spark, "qok qol qy")), "q", "o"))
    assert (got["occurrences"], got["followed"]) == (3, 2)
    assert one(stats.initial_share(stats.types(corpus(spark, "oq qo"))))["share"] == 0.5
    assert one(stats.initial_share(stats.types(corpus(spark, "a"))))["share"] == 0


def test_distance_counts_glyphs(spark):
    rows = spark.createDataFrame([("kitten", "sitting", 3), ("flaw", "lawn", 2), ("d@194;n", "dan", 1), ("d@194;n", "d@195;n", 1), ("d@194;n", "d@194;n", 0), ("", "", 0)], "a string, b string, want int")
    assert all(r["d"] == r["want"] for r in rows.withColumn("d", stats.distance(F.col("a"), F.col("b"))).collect())
    assert rows.filter("a = ''").select(stats.similarity(F.col("a"), F.col("b"))).first()[0] == 1


def test_neighbours(spark):
    got = one(stats.adjacent(corpus(spark, "daiin daiin dain", "ol chedy")))
    assert got["pairs"] == 3 and got["identical_share"] == pytest.approx(1 / 3) and got["distance1_share"] == pytest.approx(1 / 3) and got["mean_similarity"] == pytest.approx(0.6)


def test_total_variation(spark):
    frame = lambda rows: spark.createDataFrame([("c", *r) for r in rows], "corpus string, k string, p long, q long")
    tv = lambda rows: one(stats.total_variation(frame(rows), ["corpus"], "p", "q"))["tv"]
    assert tv([("a", 1, 3), ("b", 1, 0)]) == 0.5 and tv([("a", 1, 0), ("b", 0, 4)]) == 1 and tv([("a", 1, 0)]) == 0


def test_line_effects_and_profile(spark):
    w = lambda *n: " ".join("x" * k for k in n)
    got = one(stats.line_effects(corpus(spark, w(3, 5, 5, 7), w(5, 4, 9), w(1, 1))))
    assert (got["first_mean"], got["last_mean"], got["inner_count"]) == (4, 8, 3) and got["inner_mean"] == pytest.approx(14 / 3)
    p = one(stats.line_profile(corpus(spark, w(6, 5, 4, 3, 2), w(8, 5, 4, 4, 5, 2))))
    assert [p[k] for k in ("first", "second", "middle", "penultimate", "last")] == [7, 5, 4, 4, 2]


def test_edges(spark):
    e = {r["glyph"]: r for r in stats.edge_glyphs(corpus(spark, "dar chol dam", "sor oty qom")).collect()}
    assert e["m"]["line_end"] == 2 and e["r"]["other_end"] == 2 and sum(r["other_end"] for r in e.values()) == 4 and sum(r["other_start"] for r in e.values()) == 4
    apart = one(stats.edge_divergence(corpus(spark, "ka ka kam", "ka ka kam")))
    assert apart["end_divergence"] == 1 and apart["start_divergence"] == 0


def test_paragraph_lines(spark):
    got = one(stats.paragraph_lines(corpus(spark, "kaiin kol", "dar dy", par=(0,))))
    assert (got["start_mean"], got["other_mean"], got["initial_tv"]) == (4, 2.5, 1)


def test_signature(spark):
    got = one(stats.signature(corpus(spark, "kaiin daiin daiin", "qol qokdy sol", par=(0,)), window=4, least=1))
    assert (got["tokens"], got["types"], got["glyphs"]) == (6, 5, 26) and got["ttr"] == pytest.approx(5 / 6) and got["hapax_rate"] == pytest.approx(4 / 5)
    assert (got["gallows_start"], got["gallows_other"], got["pairs"]) == (1, 0, 4) and got["gallows_contrast"] == math.inf and got["identical_share"] == 0.25
    assert got["h2"] <= got["h1"] <= got["h0"]
    assert stats.signature(corpus(spark)).count() == 0
