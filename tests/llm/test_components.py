import random

from lexiloom.llm.components import components
from lexiloom.llm.scratch import Scratch


def test_paths_stars_and_repeats(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 300)] + [(5, 3), (3, 5), (3, 3), (None, 3), (9, None)]
    links += [(rng.randrange(400, 700), rng.randrange(400, 700)) for _ in range(120)]
    root = {x: x for ab in links for x in ab if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    linked = {x for a, b in links if a is not None and b is not None and a != b for x in (a, b)}
    out = components(Scratch(spark, "t"), spark.createDataFrame(links, "a long, b long"))
    assert sorted((r["node"], r["component"]) for r in out.collect()) == sorted((x, find(x)) for x in linked)
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0
