from pyspark.sql import functions as F

import corpus_pipeline
from lexiloom.llm import minhash, quality, queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    rows = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == first.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows.append(docs.count())
    assert first.count() > rows[0] >= rows[1] >= rows[2] > 0 and rows[3] == rows[4]
    counts = [r["n"] for r in docs.groupBy("shard").count().withColumnRenamed("count", "n").collect()]
    assert max(counts) - min(counts) <= 1
    # Brute force of the second stage: what is left has no near copies, and nothing alone is gone.
    before, after = (spark.read.parquet(f"{tmp_path}/{k}") for k in (0, 1))
    groups = minhash.near_duplicates(spark, before, similar=corpus_pipeline.SIMILAR).filter("kept").count()
    assert after.count() == groups
    scored = quality.score(spark, first, quality.train(first, spark.read.parquet(f"{SF}/labels.parquet")))
    assert scored.filter(f"score >= {quality.ACCEPT}").count() == rows[0]


def test_the_stage_groups_from_four_fifths_on(spark):
    words, odd = [f"w{i}" for i in range(104)], [f"v{i}" for i in range(12)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-10] + odd[:10])), (3, " ".join(words[:-12] + odd))]  # 90 / 110 and 88 / 112 to the first
    docs = spark.createDataFrame([rows[0], rows[1], (4, "alone in the whole corpus here")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()) == [1, 4]
    docs = spark.createDataFrame([rows[0], rows[2]], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()) == [1, 3]


def test_repeated_and_null_rows_survive_the_filters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0)], docs.schema))
    out = corpus_pipeline.near_duplicate_stage(spark, odd, SF)
    assert out.count() == 5 and out.columns == docs.columns


def test_rows_are_judged_by_themselves(spark):
    """Rows without a doc_id, or of one doc_id, stay or go by their own texts."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    clean = [" ".join(f"{a}{k}" for k in range(40)) for a in "xyz"]
    rows = [(1, item, "e", "s", 1), (1, clean[0], "e", "s", 1), (None, item, "e", "s", 1), (None, clean[1], "e", "s", 1), (None, clean[1], "e", "s", 1), (2, clean[1], "e", "s", 1), (3, clean[2], "e", None, 1), (3, clean[0], "e", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_lo", F.lit(1)).withColumnsRenamed({"_lo": "size_"})
    out = corpus_pipeline.decontamination_stage(spark, docs, SF)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == sorted((r[0] or 0, r[1]) for r in rows if r[1] != item)
    out = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == sorted([(1, item), (1, clean[0]), (2, clean[1]), (3, clean[2])])
    assert corpus_pipeline.quality_stage(spark, docs, SF).columns == docs.columns


def test_the_stage_leaves_texts_in_their_files(spark, tmp_path):
    """No copy of the texts is written, none is moved, and nothing of the groups stays on disk."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    docs.unionByName(docs).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    out = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert set(docs.inputFiles()) <= set(out.inputFiles())
    assert not any("/minhash-" in f or f.endswith("/rows") for f in out.inputFiles())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    written = corpus_pipeline.near_duplicate_stage(spark, docs.filter("true OR doc_id > 0").repartition(3), SF)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in written.collect())


def test_every_query_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)] + ["pipeline"]
