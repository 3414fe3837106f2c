import ast
import os

import __spark_entry__ as entry
from lexiloom.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 4


def test_sql_is_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.queries()) <= set(entry.queries())


def test_nothing_else_imports_the_optional_package():
    for folder, _, names in os.walk(f"{ROOT}/lexiloom"):
        if not folder.startswith(f"{ROOT}/lexiloom/llm"):
            for name in names:
                if name.endswith(".py"):
                    tree = ast.parse(open(os.path.join(folder, name), encoding="utf-8").read())
                    used = [n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)] + [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
                    assert not any(u.startswith("lexiloom.llm") for u in used)


def test_stream(spark, tmp_path):
    from lexiloom.streaming.tokens import running_types

    docs = spark.createDataFrame([("en", "a b a"), ("fr", "b")], "lang string, text string")
    docs.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    q = running_types(stream, ["lang"]).writeStream.outputMode("complete").format("memory").queryName("kinds").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("kinds").collect())) == [("en", "a", 2), ("en", "b", 1), ("fr", "b", 1)]
