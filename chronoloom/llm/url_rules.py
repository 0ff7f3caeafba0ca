"""URL filters: a rule list, and association rules mined by Spark's FP-growth for what the list does not cover.

A url is cut into tokens (scheme, domain suffixes, host labels, path parts without numbers, query keys). FP-growth mines token
sets that go with the label "unwanted"; rules below the least confidence or support go, and so do rules that a
subset of theirs, at least as confident, makes needless. All tokens of a url count. Tokens below the least support are in
no rule and go first. Tokens that labelled pages only hold together (told by sums of two 64-bit hashes) are mined as one and
put in each other's place in the rules found: a rule with two of them is needless, so this gives the same rules. Each rule is indexed under its rarest token; a page meets only the rules
indexed under one of its tokens and matches if it has all tokens of the rule.

Defined results: a null url or one without `://` has empty host and path, fits no rule and is allowed. Repeated pages get equal
verdicts and stay repeated. Without labels, or if no rule is sure enough, the method allows. An empty table gives
an empty result. Only page_id and url are read.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule, verdict), rule as host/path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
UNWANTED = "label=unwanted"
#: Mined rules up to which their index is broadcast; beyond it the join shuffles.
BROADCAST_RULES = 100_000

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    return F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))


def host_and_path(pages: DataFrame) -> DataFrame:
    rest = pages.select("page_id", "url", _rest(F.col("url")).alias("_rest"))
    raw_host = F.regexp_extract("_rest", r"^([^/?#]*)", 1)
    return rest.select(
        "page_id",
        "url",
        F.coalesce(F.translate(raw_host, _CAPITALS, _SMALL), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
    )


def listed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def url_tokens(pages: DataFrame) -> DataFrame:
    """Adds tokens: a set of strings for each url."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.filter(F.split(F.translate("path", _CAPITALS, _SMALL), r"[/._-]+"), lambda x: (x != "") & ~x.rlike(r"^\d+$"))
    query = F.regexp_extract_all("url", F.lit(r"[?&]([^=&#]+)="), 1)
    tokens = F.concat(
        F.array(F.concat(F.lit("scheme="), F.substring_index("url", "://", 1))),
        suffixes,
        F.transform(labels, lambda x: F.concat(F.lit("host="), x)),
        F.transform(parts, lambda x: F.concat(F.lit("path="), x)),
        F.transform(query, lambda x: F.concat(F.lit("query="), x)),
    )
    return pages.withColumn("tokens", F.when(F.col("host") != "", F.array_distinct(tokens)).otherwise(F.array().cast("array<string>")))


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float, least_pages: int = 20) -> DataFrame:
    """Rules (rule_tokens, key, confidence) from labelled (tokens, unwanted); key is a rule's rarest token.

    A rule holds for min_support of the labelled pages and for least_pages of them."""
    spark = labelled.sparkSession
    schema = "rule_tokens array<string>, key string, confidence double"
    n = labelled.count()
    if n < least_pages:
        return spark.createDataFrame([], schema)
    support = max(min_support, least_pages / n)
    # Pages of one token set and label are one row, m times.
    rows = labelled.groupBy("tokens", "unwanted").agg(F.count("*").alias("m"))
    sums = [F.sum(F.xxhash64(F.lit(k), F.array_join("tokens", "\n")).cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]
    stats = rows.select("m", "tokens", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("m").alias("freq"), *sums)
    # At most n / least count times the tokens of a page.
    classes = (
        stats.where(F.col("freq") >= math.ceil(support * n))
        .groupBy("freq", "h1", "h2")
        .agg(F.sort_array(F.collect_list("token")).alias("members"))
        .select(F.col("members")[0].alias("token"), "freq", "members")
    )
    baskets = (
        rows.select("tokens", "unwanted", "m", F.explode_outer("tokens").alias("token"))
        .join(F.broadcast(classes.select("token", F.col("token").alias("kept"))), "token", "left")
        .groupBy("tokens", "unwanted", "m")
        .agg(F.collect_set("kept").alias("kept"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
        .select(F.concat("kept", F.when(F.col("unwanted"), F.array(F.lit(UNWANTED))).otherwise(F.array().cast("array<string>"))).alias("items"))
    )
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(UNWANTED))).select(
        F.sort_array("antecedent").alias("rule_tokens"), "confidence"
    )
    # A rule goes if dropping some of its tokens leaves a rule that is as confident.
    smaller = found.select(
        F.col("rule_tokens").alias("_whole"), F.col("confidence").alias("_sure"), F.explode(F.transform("rule_tokens", lambda x: F.array_remove("rule_tokens", x))).alias("rule_tokens")
    )
    needless = smaller.join(found, "rule_tokens").where(F.col("confidence") >= F.col("_sure")).select(F.col("_whole").alias("rule_tokens")).distinct()
    needed = found.join(needless, "rule_tokens", "left_anti")
    # One rule for each choice of a member of every class in it.
    item = "struct<freq:bigint,token:string>"
    choices = F.aggregate(
        "classes",
        F.array(F.array().cast(f"array<{item}>")),
        lambda acc, members: F.flatten(F.transform(acc, lambda rule: F.transform(members, lambda x: F.concat(rule, F.array(x))))),
    )
    return (
        needed.withColumn("token", F.explode("rule_tokens"))
        .join(classes, "token")
        .groupBy("rule_tokens", "confidence")
        .agg(F.collect_list(F.transform("members", lambda x: F.struct(F.col("freq").alias("freq"), x.alias("token")))).alias("classes"))
        .select("confidence", F.explode(choices).alias("rule"))
        .select(F.sort_array(F.transform("rule", lambda x: x["token"])).alias("rule_tokens"), F.array_min("rule")["token"].alias("key"), "confidence")
    )


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct urls that some rule matches, with the confidence of the surest."""
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    urls = pages.where(F.size("tokens") > 0).select("url", "tokens", F.explode("tokens").alias("key"))
    hits = urls.join(rules, "key").where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    return hits.groupBy("url").agg(F.max("confidence").alias("confidence"))


def filter_urls(
    pages: DataFrame, labels: DataFrame, rules=RULES, min_support: float = 0.001, min_confidence: float = 0.5
) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence of the mined rule for each row of pages.

    labels: page_id, unwanted (boolean). The list's verdict stands; elsewhere a mined rule blocks."""
    cut = url_tokens(host_and_path(pages))
    labelled = cut.where(F.size("tokens") > 0).join(labels.where(F.col("unwanted").isNotNull()).select("page_id", "unwanted"), "page_id")
    mined = mine_rules(labelled.select("tokens", "unwanted"), min_support, min_confidence)
    found = match_rules(cut, mined)
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    return (
        cut.join(found, "url", "left")
        .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence")
    )
