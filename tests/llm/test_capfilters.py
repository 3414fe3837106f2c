import numpy as np

from lexiloom.llm import capfilters

SCHEMA = "vec_id long, embedding array<float>, label int, rep long"


def brute(ids, x, cosine=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= cosine
    np.fill_diagonal(link, False)
    least = np.array(ids)
    while True:
        new = np.minimum(least, np.where(link, least[None, :], least.max()).min(axis=1))
        if (new == least).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids, link.sum(axis=1), least, strict=True)}
        least = new


def vectors(n=400, dim=24):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((n, dim))
    near = np.concatenate([base[:60] + rng.standard_normal((60, dim)) * 0.12, base[:1] + rng.standard_normal((80, dim)) * 0.1, base[5:6].repeat(30, 0), base[7:9] * 3])
    return np.concatenate([base, near]).astype(np.float32)


def test_links_against_brute_force(spark, monkeypatch):
    x = vectors()
    want = brute(list(range(len(x))), x.astype(np.float64))
    rows = [(i, v.tolist(), 0, 1) for i, v in enumerate(x)]
    for chunk in (capfilters.CHUNK, 16):
        monkeypatch.setattr(capfilters, "CHUNK", chunk)
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in capfilters.cap_links(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
        true, found = sum(n for n, _ in want.values()), sum(n for n, _ in got.values())
        assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.98 * true
        assert sum(got[i][1] != want[i][1] for i in want) <= 0.02 * len(want)


def test_odd_vectors(spark):
    rows = [(1, None, 0, 0), (2, [], 0, 0), (3, [0.0, 0.0], 0, 0), (4, [1.0, None], 0, 0), (5, [float("nan"), 1.0], 0, 0), (6, [float("inf"), 1.0], 0, 0), (7, [1.0, 1.0], 0, 0), (8, [2.0, 2.0], 0, 0), (9, [2.0, 2.0], 0, 0), (None, [2.0, 2.0], 0, 0), (10, [1.0, 1.0, 0.0], 0, 0), (11, [-0.0, 1.0], 0, 0), (12, [0.0, 1.0], 0, 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in capfilters.cap_links(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10))
    assert got[7] == (2, 7, True) and got[8] == (2, 7, False) and got[9] == (2, 7, False)
    assert got[11] == (1, 11, True) and got[12] == (1, 11, False) and got[None] == (0, None, False)
    assert capfilters.cap_links(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_decoding_finds_all_filters_over_the_threshold():
    code = capfilters.Code(16, 3000)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((50, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows, filters = code.decode(x)
    y = x @ code.rotation
    total = np.zeros((50, 1))
    for (lo, hi), w in zip(code.cuts, code.words, strict=True):
        total = (total[:, :, None] + (y[:, lo:hi] @ w)[:, None, :]).reshape(50, -1)
    for k in range(50):
        got, all_ = set(filters[rows == k].tolist()), set(np.flatnonzero(total[k] >= code.threshold).tolist())
        assert all_ <= got and (got == all_ or len(got) == capfilters.LEAST)


def test_recall_does_not_fall_with_the_number_of_vectors():
    rng = np.random.default_rng(3)
    for dim in (64, 128):
        x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, 400, dim)))
        y -= (y * x).sum(axis=1, keepdims=True) * x
        y = 0.95 * x + (1 - 0.95**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
        for n in (10_000, 1_000_000, 100_000_000):
            code = capfilters.Code(dim, n)
            lists = [np.split(f, np.cumsum(np.bincount(r, minlength=400))[:-1]) for r, f in (code.decode(x), code.decode(y))]
            assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(*lists, strict=True)]) >= 0.95


def test_huge_finite_components(spark):
    rows = [(1, [1e308, 1e308]), (2, [1e308, 9e307]), (3, [1.0, 1.0]), (4, [1.0, -1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in capfilters.cap_links(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}
