import inspect
import os
import random as plain_random
import tracemalloc
from itertools import islice

import pytest

from lexiloom.functions.prng import Stream, draws, permutation, permuted, quick
from lexiloom.operators import control_tasks, controls, generators, stats, structure
from lexiloom.plans import model_queries, reports
from lexiloom.scratch import session_folder

PARAMS = {"copyMode": "lines3", "editProb": 0.6, "secondEditProb": 0, "editSlot": "uniform", "inventorySource": "realFragments", "inventoryDepth": "full", "pFresh": 0.1, "pFunction": 0.25, "lexiconSize": 60, "pLineStartContent": 0.8, "pLineEndContent": 0.7}


def corpus_rows(pages=90):
    r = plain_random.Random(5)
    vocabulary = ["".join(r.choice("abcdeh") for _ in range(r.randint(1, 7))) for _ in range(60)]
    return [(r_key, page, f"s{page % 3}", line, line % 4 == 0, [r.choice(vocabulary) for _ in range(r.randint(0, 6))]) for page in range(pages) for r_key in ["x" if page % 3 else "y"] for line in range(3)]


@pytest.fixture(scope="module")
def source(spark):
    return spark.createDataFrame(corpus_rows(), "language string, page long, section string, line_no int, par_start boolean, words array<string>").repartition(5).persist()


def held_whole(rows, key):
    own = sorted((r[1], r[3], r[5]) for r in rows if r[0] == key and r[5])
    words, counts = [w for _, _, x in own for w in x], [len(x) for _, _, x in own]
    return own, generators.Context(counts, [len(w) for w in words], words, counts, words)


def runs_of(spark, families):
    rows = [(f, p, r, 40 + r) for f, p in families for r in range(2)]
    return spark.createDataFrame(rows, "family string, params string, replicate int, seed long")


def test_f9_contrast_of_generated_pages_in_their_task_is_that_of_all_pairs(spark, source):
    runs = reports._replicates(spark, "Structured self-citation", PARAMS, 2, 7)
    made = generators.generated_by(source, "language", runs)
    assert "collect_list" not in made._jdf.queryExecution().toString()  # no corpus in a row
    sections = source.select("page", "section").distinct()
    pages = structure.pages_of(made.join(sections, "page"), ["language", "replicate"], ("section",))
    expected = {(r["language"], r["replicate"], r["lo"]): r for r in structure.section_contrast(pages, ["language", "replicate"]).collect()}
    found = reports.null_replicates(spark, source, "language", PARAMS, 2, 7).collect()
    assert len(found) == len(expected) == 2 * 2 * 7 and sum(r["same_pairs"] for r in found) > 0 < sum(r["diff_pairs"] for r in found)
    for r in found:
        e = expected[r["language"], r["replicate"], r["lo"]]
        assert (r["same_pairs"], r["diff_pairs"]) == (e["same_pairs"], e["diff_pairs"]) and r["contrast"] == pytest.approx(e["contrast"])


def test_draws_and_orders_made_in_blocks_are_those_made_one_by_one():
    assert list(islice(iter(quick(7, 16), None), 100)) == draws(7, 0, 100).tolist()
    for n in (0, 1, 2, 3, 50, 300):
        assert permuted(n, 3, 7).tolist() == permuted(n, 3).tolist() == permutation(n, Stream(3))


def test_words_are_made_as_they_are_asked_for_and_the_far_past_is_dropped(monkeypatch):
    _, ctx = held_whole(corpus_rows(), "x")
    for family, p in ((generators.Structured, PARAMS), (generators.SelfCitation, {"copyMode": "words16", "editProb": 0.6, "secondEditProb": 0.3, "opMix": "balanced"})):
        whole = family.generate(p, ctx, Stream(5))
        assert inspect.isgenerator(family.stream(p, ctx, Stream(5)))
        monkeypatch.setattr(generators.Lately, "spare", 5)
        assert family.generate(p, ctx, quick(5)) == whole
        monkeypatch.undo()
    made = generators.Lately()
    for k in range(20_000):
        made.append(k)
        made.forget(k - 10)
    assert len(made) == 20_000 and made[19_995] == 19_995 and len(made.words) < 5000


@pytest.mark.parametrize("key", ["x", "y"])
def test_f1_every_family_makes_of_counts_and_a_stream_what_it_makes_of_all_words(spark, source, key):
    chosen = []
    own, ctx = held_whole(corpus_rows(), key)
    for name, family in generators.FAMILIES.items():
        grid = generators.verify.subsample(generators.verify.enumerate_grid(family.space), 4)
        for p in [*grid, *([family.space | {"copyMode": "words16", "editProb": 0.6, "secondEditProb": 0, "editSlot": "uniform", "inventorySource": "synthetic", "inventoryDepth": "full", "pFresh": 0.1, "pFunction": 0.2, "lexiconSize": 20, "pLineStartContent": 0.5, "pLineEndContent": 0.5, "pGlobalReuse": 0.2}] if name == "Structured self-citation" else [])]:
            try:
                expected = family.generate(p, ctx, Stream(40))
            except ValueError:
                continue  # too few units for the alphabet
            chosen.append((name, generators.json.dumps(p), expected))
    runs = spark.createDataFrame([(f, p, k, 40) for k, (f, p, _) in enumerate(chosen)], "family string, params string, replicate int, seed long")
    made = {}
    for r in sorted(generators.generated_by(source.filter(generators.F.col("language") == key), "language", runs).collect(), key=lambda r: (r["page"], r["line_no"])):
        made.setdefault(r["replicate"], []).append((r["page"], r["line_no"], r["words"]))
    assert len({f for f, _, _ in chosen}) >= 4
    for k, (_, _, words) in enumerate(chosen):
        assert [(p, n) for p, n, _ in made[k]] == [(p, n) for p, n, _ in own]
        assert [w for _, _, x in made[k] for w in x] == words[: len([w for _, _, x in own for w in x])]


def test_f10_f7_lines_made_apart_by_language_in_no_row_of_a_whole_corpus(spark, source):
    made = reports.stock_replicates(spark, source, "language", PARAMS, 2)
    assert "collect_list" not in made._jdf.queryExecution().toString()
    counted = {(r["language"], r["replicate"]): (r["lines"], r["words"]) for r in made.groupBy("language", "replicate").agg(generators.F.count("*").alias("lines"), generators.F.sum(generators.F.size("words")).alias("words")).collect()}
    for key in "xy":
        own = held_whole(corpus_rows(), key)[0]
        assert counted[key, 0] == counted[key, 1] == (len(own), sum(len(x) for _, _, x in own))
    expected = {(r["replicate"], r["lo"]): r for r in structure.similarity_by_distance(structure.pages_of(made, ["replicate"], ()), ["replicate"]).collect()}
    whole = structure.PAGE_BLOCK
    for block in (whole, 70):  # pages of one block, and of several
        structure.PAGE_BLOCK = block
        try:
            found = reports.campaign_null(spark, source, "language", PARAMS, replicates=2).collect()
        finally:
            structure.PAGE_BLOCK = whole
        assert len(found) == len(expected) == 14
        for r in found:
            e = expected[r["replicate"], r["lo"]]
            assert r["pairs"] == e["pairs"] and r["mean"] == pytest.approx(e["mean"])


def test_f3_f6_words_of_a_shuffled_corpus_and_of_the_real_one_are_compared_where_they_are(spark, source):
    found = {(r["language"], r["replicate"], r["lo"]): r["contrast"] for r in reports.shuffled_replicates(spark, source, "language", 2).collect()}
    made = {}
    for key in "xy":
        own, ctx = held_whole(corpus_rows(), key)
        for k in range(2):
            order = permutation(len(ctx.words), Stream(generators.policy.SHUFFLED_SEED + k))
            words = iter([ctx.words[j] for j in order])
            made[key, k] = [(key, k, page, f"s{page % 3}", [next(words) for _ in x]) for page, _, x in own]
    rows = [r for part in made.values() for r in part]
    frame = spark.createDataFrame(rows, "language string, replicate int, page long, section string, words array<string>")
    pages = structure.pages_of(frame, ["language", "replicate"], ("section",))
    expected = {(r["language"], r["replicate"], r["lo"]): r["contrast"] for r in structure.section_contrast(pages, ["language", "replicate"]).collect()}
    assert found == pytest.approx(expected)
    real = {(r["language"], r["lo"]): r for r in structure.section_contrast(structure.pages_of(source, ["language"], ("section",)), ["language"]).collect()}
    for r in structure.contrast_of_lines(source, "language", generators.BETWEEN).collect():
        e = real[r["language"], r["lo"]]
        assert (r["same_pairs"], r["diff_pairs"], r["contrast"]) == (e["same_pairs"], e["diff_pairs"], pytest.approx(e["contrast"]))


def test_f4_f5_orders_and_copies_are_not_sent_through_the_driver(spark):
    words = spark.range(500).selectExpr("id as idx", "concat('w', id) as word")
    plan = controls.shuffled(words)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert [r["word"] for r in controls.shuffled(words).orderBy("idx").collect()] == [f"w{k}" for k in permutation(500, Stream(generators.policy.SHUFFLE_SEED))]
    made = controls.self_citations(10**12, [3] * 12, {"a": 2, "b": 1}, quick(1))  # far more than would be held
    assert len(list(islice(made, 1000))) == 1000


def test_f3_a_task_that_holds_a_corpus_writes_no_table(spark, source):
    at = session_folder(spark).removeprefix("file://")
    os.makedirs(at, exist_ok=True)
    before = set(os.listdir(at))
    assert reports.shuffled_replicates(spark, source, "language", 2).count() == 28
    assert set(os.listdir(at)) == before


def test_f3_nothing_is_held_beside_words_that_are_put_in_order():
    n, lengths = 300_000, [3, 0, 2]
    tracemalloc.start()
    permuted(n, 3, 4096)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * 4 * n
    drawn = [f"w{k % 3}" for k in range(sum(lengths))]
    lines = generators.pa.table({"page": [1, 2, 3], "n": lengths})
    corpus = generators._Corpus([{"family": generators.SHUFFLED, "seed": s} for s in (5, 6)])
    corpus.words.add(generators.pa.array(drawn))
    corpus.parts = lines.to_batches()
    made = {}
    for run, _, _, words in corpus.made():
        made.setdefault(run["seed"], []).extend(words.to_pylist())
    for seed in (5, 6):  # the second in place of the words, which the first has left as they were
        words = [drawn[k] for k in permutation(len(drawn), Stream(seed))]
        assert made[seed] == [words[:3], [], words[3:]]
    assert corpus.words.at.tolist() == [int(w[1:]) for x in made[6] for w in x]


def test_f10_words_are_counted_where_they_are_made(spark, source):
    plan = model_queries.stock_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    out = [x for x in plan.splitlines() if "MapInArrow" in x]
    assert len(out) == 1 and "par_start" not in out[0].rsplit("[", 1)[1]  # no line leaves the task
    then, schema = generators.counted("language", "string")
    sums = [generators.F.sum(c).alias(c) for c in ("lines", "words")]
    found = reports.stock_replicates(spark, source, "language", PARAMS, 3, then=then, schema=schema).groupBy("language", "replicate").agg(*sums)
    made = reports.stock_replicates(spark, source, "language", PARAMS, 3).select("language", "replicate", generators.F.lit(1).alias("lines"), generators.F.size("words").alias("words"))
    assert sorted(found.collect()) == sorted(made.groupBy("language", "replicate").agg(*sums).collect())


def test_f1_words_made_many_at_once_are_those_made_one_by_one_and_are_counted_there(spark):
    rows = [r for r in corpus_rows() if r[5]]
    lines = [r[5] for r in sorted(rows, key=lambda r: (r[1], r[3]))]
    words, counts = [w for x in lines for w in x], [len(x) for x in lines]
    plain = generators.Coded()
    plain.add(generators.pa.array(words))
    ctx = generators.Context(counts, [len(w) for w in words], words, counts, plain)
    layout = generators.Layout(generators.pa.table({"line_no": range(len(counts)), "n": counts}))
    met = 0
    for name, family in generators.FAMILIES.items():
        for p in generators.verify.enumerate_grid(family.space):
            try:
                found = family.blocks(p, ctx, 7)
            except ValueError:
                continue
            if found is not None:
                met += 1
                made = layout.generated({"family": name, "params": generators.json.dumps(p), "seed": 7}, ctx)
                assert [w for _, x in made for w in x.to_pylist()] == layout_of(family.generate(p, ctx, quick(7)), counts), (name, p)
    assert met >= 10
    plan = queries_of_words(spark)
    out = [x for x in plan.splitlines() if "MapInArrow" in x]
    assert len(out) == 1 and "par_start" not in out[0].rsplit("[", 1)[1]


def layout_of(words, counts):
    words = iter(words)
    return [list(islice(words, n)) for n in counts]


def queries_of_words(spark):
    from lexiloom.plans import structure_queries

    return structure_queries.generated_words(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_f2_controls_made_in_tasks_have_the_signatures_of_those_poured(spark, source):
    lines = source.filter("language = 'x'").withColumn("corpus", generators.F.lit("x"))
    latin = spark.createDataFrame([("latin", p, 0, False, ["arma", "virumque", "cano", "æneas"[1:], f"w{'abc'[p % 3]}"]) for p in range(7)], "corpus string, page long, line_no int, par_start boolean, words array<string>")
    found = control_tasks.signatures(lines, latin)
    assert not [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in x and "words" in x.rsplit("[", 1)[1]]
    poured = stats.signature(controls.build_controls(spark, lines, stats.indexed(latin).select("idx", "word")))
    expected = {r["corpus"]: r.asDict() for r in poured.collect()}
    made = {r["corpus"]: r.asDict() for r in found.collect()}
    assert set(made) == set(expected) == set(control_tasks.NAMES)
    for key, row in made.items():
        assert row.pop("corpus") == expected[key].pop("corpus") and row == pytest.approx(expected[key], abs=1e-9), key
