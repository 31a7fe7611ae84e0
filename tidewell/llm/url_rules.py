"""URL filters: listed host and path rules, and association rules mined from labelled URLs.

Spark's FP-growth finds token combinations of labelled URLs; those that imply a bad URL with enough
URLs behind them and enough confidence are kept, without any that a shorter and as sure one implies. Tokens that occur
in the same labelled URLs are one item, so that shared long paths do not multiply combinations. An inverted index
matches the rules: each is posted under its rarest item, and a URL that has a token of it is tested for the others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.shared import ascii_lower, cut, fresh_names

#: Labelled URLs that mining takes, in expectation (distinct URLs with the least hash).
MOST_LABELS = 200_000
#: Bad labelled URLs that a rule needs at least.
LEAST_COUNT = 10
#: Largest rule index that is broadcast; beyond it matching is a shuffle join.
MOST_BROADCAST = 10_000
BAD = "label=bad"
_RULES = "rule_id bigint, tokens array<array<string>>, posted array<string>, confidence double, support double"


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules: list[HostRule]) -> tuple[Column, Column]:
    """(rule name, verdict) of the longest listed rule that fits, else nulls.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    """
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels, top domain, path segments without digits, query keys."""
    host, path = host_of(url), path_of(url)
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = lambda parts, mark: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    labels = F.split(host, r"\.")
    return F.array_distinct(
        F.concat(
            kept(F.array(scheme), "scheme="),
            kept(labels, "host="),
            kept(F.array(F.element_at(labels, -1)), "top="),
            kept(F.filter(F.split(path, "/"), lambda x: ~x.rlike("[0-9]")), "path="),
            kept(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), "key="),
        )
    )


def _labelled(labelled: DataFrame, most: int) -> DataFrame:
    """(url, bad, tokens) of distinct labelled URLs."""
    known = labelled.where("url is not null and bad is not null").groupBy("url").agg(F.max("bad").alias("bad"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64(F.lit(13), "url"), F.lit(1 << 40)) < int((1 << 40) * most / n))
    spread = known.repartition(labelled.sparkSession.sparkContext.defaultParallelism, "url")
    return cut(spread.select("url", "bad", url_tokens(F.col("url")).alias("tokens")))


def _items(urls: DataFrame, least: int) -> DataFrame:
    """(item, alternatives, n): tokens of at least so many URLs; those of exactly the same URLs are one item, named by the least.

    The URLs of a token are compared by their number and two 64-bit sums of their hashes.
    """
    of = urls.select(F.explode("tokens").alias("token"), F.xxhash64("url").alias("a"), F.xxhash64(F.lit(7), "url").alias("b"))
    tokens = of.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).where(F.col("n") >= least)
    return cut(tokens.groupBy("n", "a", "b").agg(F.min("token").alias("item"), F.sort_array(F.collect_list("token")).alias("alternatives")).select("item", "alternatives", "n"))


def mine_rules(labelled: DataFrame, least_support: float = 0.005, least_confidence: float = 0.9, most_labels: int = MOST_LABELS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(rule_id, tokens, posted, confidence, support): combinations that imply a bad URL.

    labelled: url string, bad boolean; rows with a null are left out, a URL with both labels is bad. At most
    about MOST_LABELS distinct URLs are mined. A rule has at least least_count bad URLs, which are at least the share
    least_support of the mined ones (its support), and makes up at least least_confidence of the mined URLs with the
    combination. tokens: for each item the tokens that stand for it, of which a URL needs one. A rule with a
    shorter one inside it that is as sure is left out. posted: the tokens of the rule's item that the fewest mined URLs
    have. No rows, no rules.
    """
    spark = labelled.sparkSession
    urls = _labelled(labelled, most_labels)
    n = urls.count()
    least = max(least_count, math.ceil(least_support * n))
    if n < least or urls.where("bad").limit(least).count() < least:
        return spark.createDataFrame([], _RULES)
    items = _items(urls, least)
    named = urls.select("url", "bad", F.explode("tokens").alias("item")).join(items.select("item"), "item").groupBy("url", "bad").agg(F.collect_set("item").alias("items"))
    baskets = cut(named.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")))
    # half a URL below the least number, so that no rounding of the share asks for one more
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / max(baskets.count(), 1), minConfidence=least_confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
    sure = cut(found.select(F.sort_array("antecedent").alias("items"), "confidence", (F.round(F.col("support") * baskets.count()) / n).alias("support")))

    # a part of a rule has its first item among the rule's
    wholes = sure.select(F.col("items").alias("whole"), F.col("confidence").alias("own"), F.explode("items").alias("first"))
    parts = sure.select(F.col("items").alias("part"), F.get("items", F.lit(0)).alias("first"), "confidence")
    inside = (F.size("part") < F.size("whole")) & (F.col("confidence") >= F.col("own")) & (F.size(F.array_except("part", "whole")) == 0)
    covered = wholes.join(parts, "first").where(inside).select(F.col("whole").alias("items")).distinct()
    kept = sure.join(covered, "items", "left_anti").select(F.xxhash64("items").alias("rule_id"), "items", "confidence", "support")

    each = kept.select("rule_id", "confidence", "support", F.explode("items").alias("item")).join(items, "item")
    one = F.struct("n", "item", "alternatives")
    rules = each.groupBy("rule_id", "confidence", "support").agg(F.transform(F.sort_array(F.collect_list(F.struct("item", "alternatives"))), lambda x: x["alternatives"]).alias("tokens"), F.min_by("alternatives", one).alias("posted"))
    return cut(rules.select("rule_id", "tokens", "posted", "confidence", "support"))


def matched_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls (column url) that some mined rule fits, with the number of fitting rules. Null urls fit none.

    A URL meets only the rules that are posted under one of its tokens. The index is broadcast up to MOST_BROADCAST rules.
    """
    index = rules.select("rule_id", F.explode("posted").alias("token"), F.col("tokens").alias("wanted"))
    index = F.broadcast(index) if index.count() <= MOST_BROADCAST else index
    tokens = urls.where("url is not null").select("url").distinct().select("url", url_tokens(F.col("url")).alias("own")).withColumn("token", F.explode("own"))
    fits = F.forall("wanted", lambda alternatives: F.arrays_overlap(alternatives, F.col("own")))
    return tokens.join(index, "token").where(fits).groupBy("url").agg(F.count_distinct("rule_id").alias("n_rules"))


def judge_urls(pages: DataFrame, listed: list[HostRule], rules: DataFrame) -> DataFrame:
    """Adds host, path, rule and verdict to pages (url string and any other columns).

    verdict: the listed rule's, else block if a mined rule fits, else allow. A null url or one without :// has an
    empty host and path, no listed rule and is judged by its tokens (a null or empty one: allow). Repeated rows are
    judged alike, input columns of the added names are replaced, other columns pass through. No pages, no rows.
    """
    lowered = {"host", "path", "rule", "verdict"}
    own = [F.col(f"p.`{c}`") for c in pages.columns if c.lower() not in lowered]
    (mark,) = fresh_names(pages, "hit")
    hit = matched_urls(pages, rules).select(F.col("url").alias("m_url"), F.lit(True).alias("m_hit"))
    joined = pages.alias("p").join(hit.alias("m"), F.col("p.url") == F.col("m.m_url"), "left")
    parsed = joined.select(*own, host_of(F.col("p.url")).alias("host"), path_of(F.col("p.url")).alias("path"), F.col("m.m_hit").alias(mark))
    name, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    mined = F.when(F.col(mark), "block").otherwise("allow")
    return parsed.withColumns({"rule": name, "verdict": F.coalesce(verdict, mined)}).drop(mark)
