import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiloom.functions.prng import Picker, Stream, draw, draws, permutation
from lexiloom.operators import controls, generators, holdout, stats, structure, verify


def pages(spark, *rows):
    df = spark.createDataFrame([("c", p, s, None, list(t)) for p, s, t in rows], "corpus string, page long, section string, language string, words array<string>")
    return structure.pages_of(df)


def test_similarity_by_distance(spark):
    rows = pages(spark, (10, "X", "pqr"), (11, "X", "qrs"), (13, "Y", "s"), (17, "Y", "pqrs"))
    got = structure.similarity_by_distance(rows, buckets=((1, 2), (3, 4), (5, 6), (8, 9))).collect()
    assert sorted((r["lo"], round(r["mean"], 6), r["pairs"]) for r in got) == [(1, round((1 / 2 + 1 / 3) / 2, 6), 2), (3, 0.125, 2), (5, 0.75, 1), (8, 0.0, 0)]


def test_section_contrast(spark):
    rows = pages(spark, (1, "H", "ab"), (2, "R", "xy"), (3, "H", "bc"), (4, "R", "yz"), (5, None, "ab"))
    got = {r["lo"]: r for r in structure.section_contrast(rows, buckets=((1, 1), (2, 2))).collect()}
    assert got[1]["same_pairs"] == 0 and got[1]["diff_pairs"] == 3 and got[1]["contrast"] == 0
    assert got[2]["same_pairs"] == 2 and got[2]["same_mean"] == pytest.approx(1 / 3) and got[2]["contrast"] == 0


def test_paragraph_contrast_stays_on_its_page(spark):
    rows = [("c", 1, 0, True, ["a", "b"]), ("c", 1, 1, False, ["b", "c"]), ("c", 1, 2, True, ["x"]), ("c", 2, 0, True, ["x"]), ("c", 2, 1, False, ["x"])]
    sets = structure.line_sets(spark.createDataFrame(rows, "corpus string, page long, line_no int, par_start boolean, words array<string>"))
    got = structure.paragraph_contrast(sets, buckets=((1, 1),)).first()
    assert (got["same_pairs"], got["diff_pairs"]) == (2, 1) and got["same_mean"] == pytest.approx((1 / 3 + 1) / 2) and got["contrast"] == pytest.approx(2 / 3)


def test_labels(spark):
    labels = spark.createDataFrame([(1, "H", "a"), (1, "H", "z"), (2, "H", "b"), (9, "H", "a")], "page long, section string, form string").withColumn("idx", F.monotonically_increasing_id())
    text = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c")], "page long, form string")
    got = structure.label_rate(labels, text).first()
    assert (got["hits"], got["total"]) == (2, 3)
    only = spark.createDataFrame([("a",)], "form string")
    got = structure.label_rate(labels, text, only).first()
    assert (got["hits"], got["total"]) == (1, 1)
    pool = structure.pools(spark.createDataFrame([(1, "H"), (2, "H"), (3, None)], "page long, section string"))
    assert {r["pool"] for r in pool.collect()} == {"H", structure.NO_SECTION}
    numbered = labels.select("section", "form", (F.row_number().over(Window.orderBy("page", "form")) - 1).alias("idx"))
    moved = structure.shuffled_labels(numbered, pool, 50).collect()
    assert len(moved) == 200 and {r["page"] for r in moved} == {1, 2}


def test_groups_keep_their_order(spark):
    for keys, want in (list("ccbacab"), [0, 1, 4, 2, 6, 3, 5]), ([None, "z", "y", None, "z"], [0, 3, 1, 4, 2]):
        df = spark.createDataFrame(list(enumerate(keys)), "idx long, key string")
        got = sorted((r["place"], r["idx"]) for r in structure.stable_groups(df).collect())
        assert [i for _, i in got] == want


def test_draws(spark):
    assert draws(408, 0, 1)[0] == 0.5364534999243915
    got = [r["r"] for r in spark.range(3000).select(draw(408, F.col("id")).alias("r"), "id").orderBy("id").collect()]
    assert got == draws(408, 0, 3000).tolist()
    assert spark.range(1).select(draw(5, F.lit(2**33 + 7))).first()[0] == draws(5, 2**33 + 7, 1)[0]
    s = Stream(7)
    assert [s() for _ in range(1500)] == draws(7, 0, 1500).tolist()
    assert sorted(permutation(50, Stream(1))) == list(range(50)) and permutation(0, Stream(1)) == []
    picker, random = Picker({"a": 3, "b": 1}), Stream(1)
    assert 0.7 < sum(picker(random) == "a" for _ in range(4000)) / 4000 < 0.8
    for bad in ({}, {"a": 0}, {"a": -1, "b": 2}):
        with pytest.raises(ValueError):
            Picker(bad)


def test_holdout_draw(spark, tmp_path):
    names = [f"f{k}{s}" for k in range(1, 41) for s in "rv"]
    rows = [(k, n, k, "H" if k < 60 else "B", "A" if k < 40 else "B") for k, n in enumerate(names)]
    frame = spark.createDataFrame(rows, "id long, name string, seq long, illustration_type string, currier_language string")
    chosen = holdout.draw(frame)
    counts = {r["stratum"]: r["n"] for r in chosen.groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    assert counts == {"H/A": 3, "H/B": 2, "B/B": 2}
    assert holdout.held_pages(frame, chosen).count() == 14 and sorted(map(tuple, chosen.collect())) == sorted(map(tuple, holdout.draw(frame).collect()))
    record = holdout.freeze(str(tmp_path / "h.json"), chosen)
    assert holdout.freeze(str(tmp_path / "h.json"), chosen) == record
    with pytest.raises(ValueError):
        holdout.freeze(str(tmp_path / "h.json"), chosen, seed=1)


def lines(spark, *text):
    return spark.createDataFrame([("c", 0, k, k == 0, t.split()) for k, t in enumerate(text)], "corpus string, page long, line_no int, par_start boolean, words array<string>")


def test_controls(spark):
    html = "<script>x</script><p>The Latin Library nav</p>[1] In príncipio creávit Deus cælum et terram [2] et cœpit<b>The Classics Page</b>"
    page = spark.createDataFrame([(1, html)], "page_id long, html string")
    latin = controls.latin(page)
    assert [r["word"] for r in latin.orderBy("idx").collect()] == "in principio creavit deus caelum et terram et coepit".split()
    plain, cipher = controls.substitution(latin)
    made = {r["idx"]: r["w"] for r in latin.select("idx", controls.encipher(F.col("word"), plain, cipher).alias("w")).collect()}
    assert sorted(plain) == sorted(cipher) and made[5] == made[7] and len(made[1]) == 9
    with pytest.raises(Exception, match="no substitute"):
        latin.select(controls.encipher(F.concat("word", F.lit("!")), plain, cipher)).collect()
    source = lines(spark, "daiin ol chedy", "", "qokeedy dal", "ol")
    words = stats.indexed(source).select("idx", "word")
    noise = {r["idx"]: r["word"] for r in controls.gibberish(words).collect()}
    assert [len(noise[k]) for k in range(6)] == [5, 2, 5, 7, 3, 2]
    order = "".join(r["glyph"] for r in controls.glyph_intervals(words).orderBy("lo").collect())
    assert order == "dainolcheyqk"
    mixed = [r["word"] for r in controls.shuffled(words).orderBy("idx").collect()]
    assert sorted(mixed) == sorted("daiin ol chedy qokeedy dal ol".split())
    poured = controls.pour(controls.skeleton(source), latin, "l").orderBy("line_no").collect()
    assert [r["words"] for r in poured] == [["in", "principio", "creavit"], ["deus", "caelum"], ["et"]]
    with pytest.raises(Exception, match="not enough words"):
        controls.pour(controls.skeleton(source), latin.filter("idx < 3"), "l").collect()
    assert controls.build_controls(spark, source, latin).select("corpus").distinct().count() == 5


def context():
    glyphs = "qokeedychaintlsr"
    random = Stream(3)
    words = ["".join(glyphs[int(random() * 16)] for _ in range(3 + k % 5)) for k in range(200)]
    return generators.Context([8] * 25, [3 + k % 5 for k in range(200)], words, [8] * 25, "in principio creavit deus caelum et terram terra autem".split())


@pytest.mark.parametrize("name", list(generators.FAMILIES))
def test_every_family_fills_the_layout_the_same_way_twice(name):
    family, ctx = generators.FAMILIES[name], context()
    for params in verify.subsample(verify.enumerate_grid(family.space), 6):
        try:
            words = family.generate(params, ctx, Stream(11))
        except ValueError:
            assert name == "Verbose cipher"  # too few units for the alphabet
            continue
        assert len(words) == 200 and words == family.generate(params, ctx, Stream(11))


def test_corpora_are_generated_apart_and_agree_with_plain_python(spark):
    rows = [("x", 1, 0, True, ["ab", "cd"]), ("x", 1, 1, False, []), ("x", 2, 0, False, ["e"]), ("y", 3, 0, True, ["f", "gh", "i"])]
    source = spark.createDataFrame(rows, "language string, page long, line_no int, par_start boolean, words array<string>")
    runs = spark.createDataFrame([(generators.SHUFFLED, "{}", r, 7 + r) for r in range(3)], "family string, params string, replicate int, seed long")
    got = {(r["language"], r["replicate"], r["page"], r["line_no"]): r["words"] for r in generators.generated_by(source, "language", runs).collect()}
    for r in range(3):
        own = [["ab", "cd", "e"][k] for k in permutation(3, Stream(7 + r))]
        assert got["x", r, 1, 0] == own[:2] and got["x", r, 2, 0] == own[2:] and sorted(got["y", r, 3, 0]) == ["f", "gh", "i"]
    assert len(got) == 9


def test_generator_parts():
    starts, ends = generators.edge_slots("qokeedy chol qodam chedy dar dy".split(), [3, 3])
    assert starts == {"qo": 1, "ch": 1} and ends == {"am": 1, "": 1}
    ctx = generators.Context([2], [3, 2], ["aba", "ab"], [2])
    assert generators.by_frequency(ctx.digraphs)[0] == "ab" and generators.glyph_list("d@194;@x") == ["d", "@194;", "@", "x"]
    assert [len(verify.enumerate_grid(f.space)) for f in generators.FAMILIES.values()] == [108, 288, 48, 4, 256]
    copy = generators.CopySource("lines1", [2, 2, 2])
    assert copy.choose(1, lambda: 0.99) == 0
    for n in (1, 2, 3, 4):
        copy.wrote(n)
    assert {copy.choose(5, lambda r=r: r) for r in (0.0, 0.49, 0.5, 0.99)} == {2, 3}


def test_distances_and_ranks(spark):
    v = spark.createDataFrame([("ref", "a", 4.0), ("ref", "b", 2.0), ("c1", "a", 4.0), ("c1", "b", 0.0), ("c2", "a", 1.0), ("c2", "b", 4.0)], "corpus string, metric string, value double")
    got = {r["corpus"]: r["distance"] for r in verify.aggregate_distances(verify.z_distances(v, "ref")).collect()}
    assert got["ref"] == 0 and got["c2"] == pytest.approx((3 / 2**0.5 + 2 / (8 / 3) ** 0.5) / 2)
    assert verify.enumerate_grid({"b": [1, 2], "a": ["x"]}) == [{"a": "x", "b": 1}, {"a": "x", "b": 2}] and verify.enumerate_grid({}) == [{}]
    assert len(verify.subsample(list(range(50)), 7)) == 7
    results = spark.createDataFrame([("f", 0, 2.0), ("f", 0, 4.0), ("f", 1, 1.0), ("f", 1, 3.0), ("f", 2, 2.0), ("f", 2, 2.0)], "family string, combo int, distance double")
    assert [(r["combo"], r["rank"]) for r in verify.ranked(results).orderBy("rank").collect()] == [(1, 1), (2, 2), (0, 3)]


def test_search_prefers_words_of_the_right_length(spark, monkeypatch):
    class Toy:
        name, space = "Toy", {"len": [1, 4, 9]}

        @staticmethod
        def generate(p, ctx, random):
            return ["abcdefghi"[: p["len"]]] * ctx.count

    source = lines(spark, *["abcd bcda cdab"] * 6)
    rows = [(i, str(n), Toy.generate({"len": n}, generators.Context([3] * 6, [], [], []), None)) for i, n in enumerate((1, 4, 9))]
    made = None
    for combo, name, words in rows:
        part = source.select(F.lit(name).alias("corpus"), "page", "line_no", "par_start", F.array(*[F.lit(w) for w in words[:3]]).alias("words"))
        made = part if made is None else made.unionByName(part)
    vectors = verify.vector(stats.signature(made))
    reference = verify.vector(stats.signature(source)).select("metric", "value")
    best = verify.scaled_distance(vectors, reference, verify.scales(vectors)).orderBy("distance").first()
    assert best["corpus"] == "4"
