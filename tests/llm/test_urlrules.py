import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from lexiloom.llm import urlrules

URLS = "id long, url string, host string, tokens string"


def judged(url, rules=urlrules.RULES):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_fixed_rules(spark):
    urls = ["http://a.Example.com/en/7x?q#f", "http://example.com/en/8", "https://xexample.com/en/7", "http://com/en/", "ftp://a.net/de/8", "http://b.example.net/de/8", "http://example.net/de/9", "x.org/es/", "http://x.org/es/1://y/", None, "", "http://", "http://h?x=/en/", "http://É.com/en/\nz", "a://b.com#/en/"]
    rows = [(k, u, "x", "y") for k, u in enumerate(urls)] + [(None, urls[0], "", ""), (0, urls[0], "", "")]
    labels = spark.createDataFrame([], "id long, bad boolean")
    out = urlrules.judge(spark, spark.createDataFrame(rows, URLS), labels).collect()
    want = sorted((str(r[0]), *map(str, judged(r[1])[:3]), judged(r[1])[3] or "allow") for r in rows)
    assert sorted((str(r["id"]), str(r["host"]), str(r["path"]), str(r["rule"]), r["verdict"]) for r in out) == want
    assert urlrules.judge(spark, spark.createDataFrame([], URLS), labels).count() == 0


def test_mined_rules_match_by_their_tokens(spark):
    rows, labels = [], []
    for k in range(400):
        casino, shop = k % 4 == 0, k % 3 == 0
        rows.append((k, f"http://site{k % 7}.{'biz' if casino else 'info'}/{'win' if shop else 'read'}/{k}", "", ""))
        if k < 300:
            labels.append((k, casino and shop))
    labels += [(None, True), (1, None), (3, False), (999, True)]
    out = urlrules.judge(spark, spark.createDataFrame(rows, URLS), spark.createDataFrame(labels, "id long, bad boolean")).collect()
    assert all((r["verdict"] == "block") == (r["id"] % 12 == 0) for r in out)


def test_pruning_keeps_the_shortest(spark):
    rules = spark.createDataFrame([(["a"], 0.9, 0.1), (["a", "b"], 0.9, 0.1), (["b", "c"], 0.8, 0.1), (["b", "c", "d"], 0.95, 0.1), (["a", "c"], 0.99, 0.1)], "rule array<string>, confidence double, support double")
    assert sorted(r["rule"] for r in urlrules.pruned(rules).collect()) == [["a"], ["a", "c"], ["b", "c"], ["b", "c", "d"]]


def test_rules_match_brute_force(spark):
    """All token sets of the labelled urls, counted one by one, pruned, and matched by inclusion."""
    rng, rows, labels = random.Random(2), [], []
    for k in range(240):
        host, first = rng.choice(["a.com", "b.com", "c.net"]), rng.choice(["en", "de", "es"])
        rows.append((k, f"http://{host}/{first}/{rng.randrange(99)}", "", ""))
        if k % 2:
            labels.append((k, rng.random() < (0.95 if (host, first) in {("a.com", "en"), ("c.net", "es")} else 0.1)))
    fixed = (("b.com", "/de/", "block"), ("c.net", "/en/", "allow"))
    urls, marks = spark.createDataFrame(rows, URLS), spark.createDataFrame(labels, "id long, bad boolean")
    host, path = urlrules.host_and_path(F.col("url"))
    tokens = {r["id"]: frozenset(r["t"]) for r in urls.select("id", urlrules.url_tokens(host, path, F.col("url")).alias("t")).collect()}
    rule = {r[0]: judged(r[1], fixed)[3] for r in rows}
    mark = dict(labels)
    known = {k: bool(mark.get(k)) or rule[k] == "block" for k in tokens if k in mark or rule[k]}
    least = max(urlrules.SUPPORT * len(known), urlrules.LEAST_URLS)
    every = {frozenset(c) for k in known for n in range(1, len(tokens[k]) + 1) for c in combinations(sorted(tokens[k]), n)}
    share = {}
    for c in every:
        of = [known[k] for k in known if c <= tokens[k]]
        if sum(of) >= least and sum(of) >= urlrules.CONFIDENCE * len(of):
            share[c] = sum(of) / len(of)
    kept = [c for c in share if not any(d < c and share[d] >= share[c] for d in share)]
    assert kept
    want = {k: rule[k] or ("block" if any(c <= tokens[k] for c in kept) else "allow") for k in tokens}
    out = urlrules.judge(spark, urls, marks, fixed).collect()
    assert {r["id"]: r["verdict"] for r in out} == want
    assert {r["id"] for r in out if r["mined"]} == {k for k in tokens if any(c <= tokens[k] for c in kept)}


def test_very_long_urls_and_other_columns(spark):
    rows = [(1, "http://h.com/en/" + "a/" * 500_000 + "?" + "q" * 100_000, "x"), (2, "http://" + "s." * 50_000 + "com/en/", "y")]
    urls = spark.createDataFrame(rows, "id long, url string, tokens string").withColumns({"bad": F.lit(1), "key": F.lit(2), "fixed": F.lit(3), "mined": F.lit(4)})
    out = {r["id"]: (r["rule"], r["verdict"], len(r["path"])) for r in urlrules.judge(spark, urls, spark.createDataFrame([], "id long, bad boolean")).collect()}
    assert out == {1: ("com/en/", "block", 4 + 1_000_000), 2: ("com/en/", "block", 4)}
