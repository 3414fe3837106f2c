import pytest

from lexiloom.llm import spread


@pytest.mark.parametrize("blocks", [spread.MOST_BLOCKS, 2])
def test_having_ids(spark, monkeypatch, blocks):
    """Dense, sparse, negative and repeated ids, by bitmaps and by a shuffle."""
    monkeypatch.setattr(spread, "MOST_BLOCKS", blocks)
    some = [*range(0, 70_000, 3), -1, -32_768, -32_769, 1 << 33, (1 << 33) + 7, (1 << 62) + 32_767, -(1 << 63), None, 3]
    there = [*range(-40_000, 40_000, 7), *some, 6, 6, (1 << 33) + 8, (1 << 62) + 32_766]
    rows = spark.createDataFrame([(i, "x") for i in there], "id long, text string")
    out = spread.having_ids(rows, spark.createDataFrame([(i,) for i in some], "id long"), "id")
    assert out.columns == rows.columns
    known = set(some) - {None}
    assert sorted(r["id"] for r in out.collect()) == sorted(i for i in there if i in known)
