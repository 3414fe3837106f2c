import re

from lexiloom.llm import decontam

DOCS, ITEMS = "doc_id long, text string, items string", "item_id long, text string, n long"


def words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())


def brute(docs, items, size):
    out = []
    for d, text, _ in docs:
        w, hit, found = words(text), set(), set()
        for i, t, _ in items:
            v = words(t)
            n = min(size, len(v))
            for s in range(len(v) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add("null" if i is None else str(i))
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def fixture():
    passage = "the quick brown Fox jumps over a lazy dog while nobody, looks at it twice"
    docs = [(1, f"intro words. {passage}! more", "x"), (2, "the quick brown fox jumps over a lazy dog", "x"), (3, None, "x"), (4, "", "x"), (5, "nothing here " * 300, None), (6, f"{passage} {passage}", "x"), (None, "short item", "x"), (6, f"{passage} {passage}", "x")]
    docs += [(100 + k, f"filler number {k} of many", "x") for k in range(40)] + [(900, "pad " * 50_000 + passage + " pad" * 50_000, "x")]
    items = [(10, passage, 1), (2, "short ITEM", 1), (3, None, 1), (4, "..", 1), (None, "filler number 7", 1), (10, passage, 1), (11, "brown fox jumps over a lazy dog while nobody looks", 1)]
    return docs, items


def test_against_brute_force_in_one_block_and_in_many(spark):
    docs, items = fixture()
    want = brute(docs, items, 10)
    for block in (1_000_000, 1):
        out = decontam.contamination(spark, spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block_words=block).collect()
        got = [(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in out]
        assert sorted(got, key=str) == want


def test_empty_tables(spark):
    docs, items = fixture()
    empty = decontam.contamination(spark, spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS))
    assert empty.count() == len(docs) and empty.filter("n_hit > 0").count() == 0
    assert decontam.contamination(spark, spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0
