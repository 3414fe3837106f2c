"""URL filters: fixed rules by host and path, and association rules mined from labels.

Tokens of a url are its host's last one, two and three labels and the whole host,
up to three path segments by place (digits as ``#``), the depth, the extension and
the first query key: at most eleven, whatever the url. Spark's FP-growth mines
sets of tokens together with the label; a rule is a token set whose urls bear the
label with at least ``confidence`` and ``support``, and LEAST_URLS of them. A rule that contains another
of no less confidence is pruned. Rules are filed under their rarest token (an
inverted index): a url meets only the rules filed under one of its tokens, and a
rule fires if all of its tokens are there.

A url is labelled by what is known of it: bad if the labels call it bad or a fixed
rule blocks it, else good if the labels call it good or a fixed rule allows it. So
mining carries what the fixed rules say over to urls that none of them fits, as far
as the labels of other urls do not speak against it.

Fixed rules win over mined ones. A fixed rule fits its host and subdomains if the
path starts with the rule's; the longest wins.

Edge cases. Null url or none with ``://``: host and path empty, no fixed rule, no
tokens, and verdict ``allow``. Null id: kept. Repeated rows each get a verdict;
for mining, all labels of an id count as one, and it is bad if any says so. No
url with a label or a fixed rule: no mined rule. Empty table: empty result. Columns other than id and
url are not looked at.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.scratch import Scratch

#: Host, path and verdict.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
SUPPORT = 0.002
CONFIDENCE = 0.8
#: A rule rests on this many urls at least, however few are labelled.
LEAST_URLS = 10
_BAD = "!bad"
#: So many rules at most are broadcast; more meet the tokens by a shuffle.
FEW_RULES = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null without one."""
    text = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    labels = F.split(host, r"\.")
    n = F.size(labels)
    # The whole host has the name of a suffix, so that short hosts do not count twice.
    suffix = lambda k: F.when((host != "") & (n >= k), F.concat(F.lit("h:"), F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    shape = lambda s: F.regexp_replace(s, r"[0-9]+", "#")
    segment = lambda k: F.when(F.size(segments) > k, F.concat(F.lit(f"p{k}:"), shape(F.get(segments, F.lit(k)))))
    last = F.get(segments, F.size(segments) - 1)
    extension = F.regexp_extract(last, r"\.([A-Za-z0-9]{1,5})$", 1)
    key = F.regexp_extract(url, r"\?([^=&#]+)", 1)
    tokens = F.array(
        suffix(1), suffix(2), suffix(3), F.when(host != "", F.concat(F.lit("h:"), host)), segment(0), segment(1), segment(2),
        F.when(host != "", F.concat(F.lit("depth:"), F.least(F.size(segments), F.lit(9)).cast("string"))),
        F.when(extension != "", F.concat(F.lit("ext:"), extension)), F.when(key != "", F.concat(F.lit("q:"), key)),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(tokens)))


def mine(spark: SparkSession, labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """rule (sorted tokens), confidence and support, mined from ``labelled`` (tokens, bad)."""
    items = labelled.filter(F.size("tokens") > 0).select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(_BAD)))).otherwise(F.col("tokens")).alias("items"))
    n = items.count()
    if n < LEAST_URLS:
        return spark.createDataFrame([], "rule array<string>, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, LEAST_URLS / n)), minConfidence=confidence).fit(items)
    found = model.associationRules.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == _BAD))
    return found.select(F.array_sort("antecedent").alias("rule"), "confidence", "support")


def pruned(rules: DataFrame) -> DataFrame:
    """``rules`` without those that contain another of no less confidence; subsets meet by an equi-join."""
    subsets = F.transform(F.sequence(F.lit(1), F.pow(F.lit(2), F.size("rule")).cast("int") - 2), lambda m: F.filter("rule", lambda x, i: (F.shiftright(m, 0).bitwiseAND(F.pow(F.lit(2), i).cast("int"))) > 0))
    parts = rules.filter(F.size("rule") > 1).select(F.col("rule").alias("whole"), F.col("confidence").alias("c"), F.explode(subsets).alias("rule"))
    worse = parts.join(rules, "rule").filter(F.col("confidence") >= F.col("c")).select(F.col("whole").alias("rule")).distinct()
    return rules.join(worse, "rule", "left_anti")


def matches(rows: DataFrame, rules: DataFrame, frequency: DataFrame) -> DataFrame:
    """key of each of ``rows`` (key, tokens) on which a rule fires, with the first of these; ``frequency`` has token and df."""
    by_token = rules.withColumn("token", F.explode("rule")).join(frequency, "token", "left")
    filed = by_token.groupBy("rule").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).alias("rarest")).select(F.col("rarest.token").alias("token"), "rule")
    filed = filed.groupBy("token").agg(F.collect_list("rule").alias("filed"))  # the rules of one token; all of them are FEW_RULES or a table
    small = rules.limit(FEW_RULES + 1).count() <= FEW_RULES
    near = rows.select("key", "tokens", F.explode("tokens").alias("token")).join(F.broadcast(filed) if small else filed, "token")
    fires = F.filter("filed", lambda r: F.size(F.array_except(r, F.col("tokens"))) == 0)
    return near.select("key", F.explode(fires).alias("rule")).groupBy("key").agg(F.min("rule").alias("mined"))


def judge(spark: SparkSession, urls: DataFrame, labels: DataFrame, fixed=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """id, host, path, rule, verdict and mined (the tokens of a mined rule that fires, or null) for each row of ``urls`` (id, url); ``labels`` has id and bad."""
    scratch = Scratch(spark, "urls")
    host, path = host_and_path(F.col("url"))
    rows = urls.select("id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("tokens", url_tokens(F.col("host"), F.col("path"), F.col("url"))).drop("url")
    text, verdict = fixed_rule(F.col("host"), F.col("path"), fixed)
    rows = scratch.write(rows.withColumns({"rule": text, "fixed": verdict, "key": F.monotonically_increasing_id()}), "urls")
    marks = labels.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.coalesce("bad", F.lit(False))).alias("bad"))
    known = rows.select("id", "tokens", "fixed").join(marks, "id", "left")
    bad = F.coalesce(F.col("bad"), F.lit(False)) | F.coalesce(F.col("fixed") == "block", F.lit(False))
    known = known.filter("bad IS NOT NULL OR fixed IS NOT NULL").select("tokens", bad.alias("bad"))
    rules = scratch.write(pruned(scratch.write(mine(spark, known, support, confidence), "mined")), "rules")
    out = rows.select("id", "host", "path", "rule", "fixed", "key")
    if rules.isEmpty():
        out = out.withColumn("mined", F.lit(None).cast("array<string>"))
    else:
        wanted = rules.select(F.explode("rule").alias("token")).distinct()  # only tokens of rules are counted
        frequency = rows.select(F.explode("tokens").alias("token")).join(F.broadcast(wanted) if rules.limit(FEW_RULES + 1).count() <= FEW_RULES else wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        out = out.join(matches(rows.select("key", "tokens"), rules, frequency), "key", "left")
    method = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return out.select("id", "host", "path", "rule", F.coalesce("fixed", method).alias("verdict"), F.array_join("mined", " ").alias("mined"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages``; a page is labelled by the row of ``labels`` with its id, bad if toxic, and by the fixed rules."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("bad"))
    out = judge(spark, pages, labels)
    return out.withColumnRenamed("id", "page_id")
