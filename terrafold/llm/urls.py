"""Operator 10, URL filters.

Rules decide first. The rest is judged by two smoothed variable-order Markov models of characters, one fitted to all
allowed and one to all blocked URLs: the difference of their log-likelihoods a character, against a threshold that is
calibrated on held-out allowed URLs. A character and the ORDER before it are a gram: grams are counted over all
labelled URLs, and each different gram of the URLs to judge is scored once. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import LOWER, UPPER, small, staged
from terrafold.operators import order

# The rules of the registered query, host and path, allow or block.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

#: Longest context in characters; the weight of the next shorter context, in characters seen; the alphabet's nominal size.
ORDER, BACKOFF, ALPHABET = 4, 5.0, 128
#: Of the allowed URLs that are held out, all of them, this share may score as blocked. One in HELD_OUT is held out.
FALSE_BLOCK, HELD_OUT = 0.01, 5


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, by_rule (allow, block or null) for each row. A null url has an empty host and path."""
    p = pages.select("page_id", F.col("url").alias("url"))
    part = lambda k: F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?s:.*?)://([^/?#]*)([^?#]*)", k)
    p = p.withColumn("host", F.translate(part(1), UPPER, LOWER)).withColumn("path", part(2))
    chosen = rule_of = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        chosen, rule_of = F.when(fits, verdict).otherwise(chosen), F.when(fits, host + path).otherwise(rule_of)
    return p.withColumn("rule", rule_of).withColumn("by_rule", chosen)


#: Start and end of a URL.
START, END = "\\u0002", "\\u0003"


def grams(urls: DataFrame, keep: list[str]) -> DataFrame:
    """keep, gram: each character of url, and its end, behind the ORDER characters before it."""
    u = urls.select(*keep, F.expr(f"concat(repeat('{START}', {ORDER}), url, '{END}')").alias("__u"))
    return u.select(*keep, F.expr(f"explode(transform(sequence(1, length(__u) - {ORDER}), i -> substring(__u, i, {ORDER + 1})))").alias("gram"))


def fit(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, n_allow, n_block for each seen character behind a context of 0 to ORDER characters; context, k (the key's length), ctx_allow, ctx_block."""
    whole = grams(labelled, ["by_rule"]).groupBy("gram").agg(*[F.count_if(F.col("by_rule") == c).alias(f"n_{c}") for c in ("allow", "block")])
    one = whole.select("n_allow", "n_block", F.expr(f"explode(transform(sequence(1, {ORDER + 1}), k -> right(gram, k)))").alias("key"))
    pairs = staged(one.groupBy("key").agg(F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block")), "pairs")
    context = F.expr("substring(key, 1, length(key) - 1)").alias("context")
    contexts = pairs.groupBy(context, F.length("key").alias("k")).agg(F.sum("n_allow").alias("ctx_allow"), F.sum("n_block").alias("ctx_block"))
    return pairs, contexts


def scored(found: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """gram, d: log-likelihood as blocked less that as allowed, for each different gram of found.

    Each context's estimate is blended with that of the next shorter one: (n + BACKOFF * shorter) / (n_ctx + BACKOFF);
    contexts that the model lacks leave the shorter estimate as it is.
    """
    pairs, contexts = model
    g = found.select("gram").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1))))
    g = g.withColumn("key", F.expr("right(gram, k)")).withColumn("context", F.expr("substring(key, 1, k - 1)"))
    # Each key's counts first, as many grams share a short one.
    keys = g.select("key", "context", "k").distinct().join(pairs, "key", "left").join(small(contexts), ["context", "k"], "left").drop("context", "k")
    g = g.drop("context").join(small(staged(keys, "keys")), "key")
    seen = F.struct("k", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_allow", "n_block", "ctx_allow", "ctx_block")])
    g = g.groupBy("gram").agg(F.array_sort(F.collect_list(seen)).alias("x"))  # ORDER + 1 each
    p = lambda c: f"aggregate(x, double(1.0 / {ALPHABET}), (p, y) -> (y.n_{c} + {BACKOFF} * p) / (y.ctx_{c} + {BACKOFF}))"
    return g.select("gram", F.expr(f"ln({p('block')}) - ln({p('allow')})").alias("d"))


def scores(urls: DataFrame, ratios: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """keep and score, the mean of d over all of a URL's grams; key tells rows apart. A URL's grams are summed where they are made, before a shuffle."""
    joined = grams(urls, [key, *keep]).join(small(ratios), "gram", "left")
    # Rounded, so that the order of summing can't tip a verdict.
    return joined.groupBy(key).agg(*[F.first(c).alias(c) for c in keep], F.round(F.sum("d") / F.count("*"), 9).alias("score")).drop(key)


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict, score (null where a rule decided) for each row of pages.

    Null urls and urls without :// have empty host and path and are judged like others, by the model on their whole
    text (null: as empty). Where the rules give no URL of one class, the model allows all. Ties with the threshold are
    allowed. Repeated rows get equal verdicts, null ids stay, and an empty table gives no row.
    """
    rows = ruled(pages, rules)
    known = rows.where("by_rule is not null and url is not null").select("by_rule", "url").distinct().withColumn("__hash", F.xxhash64("url"))
    known = staged(known, "known")
    held = F.pmod("__hash", F.lit(HELD_OUT)) == 0
    train = known.where(~held)
    classes = {r[0] for r in train.select("by_rule").distinct().collect()}  # two at most
    decided = rows.where("by_rule is not null").withColumn("score", F.lit(None).cast("double"))
    left = rows.where("by_rule is null").withColumn("given", F.col("url")).withColumn("url", F.coalesce("url", F.lit("")))
    if len(classes) == 2:
        test = known.where(held & (F.col("by_rule") == "allow")).select("url")
        found = grams(left, []).distinct().unionByName(grams(test, []).distinct())
        ratios = staged(scored(found, fit(train)), "ratios")
        cut = order.quantiles(scores(test.withColumn("__row", F.monotonically_increasing_id()), ratios, "__row", ["url"]), "score", [1 - FALSE_BLOCK]).first()
        limit = max(0.0, cut["value"] if cut else 0.0)
        left = scores(left.withColumn("__row", F.monotonically_increasing_id()), ratios, "__row", ["page_id", "given", "host", "path", "rule", "by_rule"])
    else:
        limit, left = 0.0, left.drop("url").withColumn("score", F.lit(None).cast("double"))
    rows = decided.unionByName(left.withColumnRenamed("given", "url"))
    by_model = F.when(F.coalesce("score", F.lit(0.0)) > limit, "block").otherwise("allow")
    return rows.select("page_id", "url", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "score")
