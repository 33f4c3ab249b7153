"""URL filters: curated rules first, association rules for the rest.

URLs that a curated rule decides are the labels, less the tokens that the rules test (or a given table of labels). FP-growth mines which combinations of URL
tokens go with blocking; rules below a support or confidence, and those that a shorter rule already covers, are
pruned. The rest is matched through an inverted index from each rule's rarest token to the rule.

Only what can be in a rule is mined. A token that is a rule by itself covers all combinations with it; one that too few
blocked URLs hold, or all labelled ones, is in none; and tokens of exactly the same URLs, as the pieces of a path that many
share, are one: any of them stands for the class. Where URLs still hold more than WIDE classes, as paths of many depths
do, FP-growth would list the exponentially many combinations of nested classes. There combinations grow level by
level instead, each only from ones whose every token still tells something; the rules are the same.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import settle

#: Rules and tokens up to this number are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 10_000
#: Classes of tokens in one URL up to which FP-growth lists all combinations.
WIDE = 12
_BLOCK = "verdict:block"
_ALLOW = "verdict:allow"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(_lower_ascii(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """verdict and text of the longest rule that fits (of equal ones the first listed), else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.text).alias("rule"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host and parts of hyphenated ones, all pieces of the path, names in the query. Numbers in the path read as 0."""
    tag = lambda prefix: lambda x: F.concat(F.lit(prefix), x)
    labels = F.filter(F.split(host, "[.]"), lambda x: x != "")
    words = F.flatten(F.transform(F.filter(labels, lambda x: x.rlike("[-_]")), lambda x: F.split(x, "[-_]")))
    pieces = F.filter(F.split(_lower_ascii(path), "/"), lambda x: x != "")
    place = F.transform(pieces, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), F.regexp_replace(x, "[0-9]+", "0")))
    names = F.regexp_extract_all(_lower_ascii(url), F.lit(r"[?&]([^=&#]+)="), F.lit(1))
    return F.array_distinct(F.concat(F.transform(labels, tag("host:")), F.transform(words, tag("word:")), place, F.transform(names, tag("query:"))))


def _tested(rules: list[Rule]) -> list[str]:
    """Tokens that curated rules test themselves. What these decide says nothing new about them, so nothing is learnt on them."""
    hosts = [f"host:{x}" for r in rules for x in r.host.split(".")]
    return sorted({*hosts, *(f"path{i}:{x}" for r in rules for i, x in enumerate(x for x in r.path.split("/") if x)), *(f"path0:{x}" for r in rules for x in r.path.split("/") if x)})


def token_classes(labelled: DataFrame) -> DataFrame:
    """labelled: row, tokens, blocked. token, rep, n and blocked of tokens by the class of those that stand in exactly the same rows. Settled.

    n and blocked: rows, and blocked ones, that hold the token. Rows are compared by 128 bits of hashes of their numbers.
    """
    bits = lambda seed: F.bit_xor(F.xxhash64("row", F.lit(seed)))
    each = labelled.select("row", "blocked", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.count_if("blocked").alias("blocked"), bits(1).alias("x"), bits(2).alias("y"))
    each = settle(each)
    reps = each.groupBy("n", "blocked", "x", "y").agg(F.min("token").alias("rep"))
    return settle(each.join(reps.hint("merge"), ["n", "blocked", "x", "y"]).select("token", "rep", "n", "blocked"))


def _small(df: DataFrame) -> DataFrame:
    """A settled table to join with, broadcast up to a number of rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_RULES else df.hint("merge")


def _by_fp_growth(baskets: DataFrame, least: int, confidence: float) -> DataFrame:
    """baskets: items, blocked. Antecedents of rules for blocking with confidence; support counts all labelled rows."""
    items = baskets.select(F.concat("items", F.array(F.when(F.col("blocked"), F.lit(_BLOCK)).otherwise(F.lit(_ALLOW)))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least / baskets.count() * (1 - 1e-9), minConfidence=confidence).fit(items)
    return model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == _BLOCK)).select(F.array_sort("antecedent").alias("antecedent"), "confidence")


def _by_levels(baskets: DataFrame, least: int, confidence: float) -> DataFrame:
    """The same rules but those of which a token says nothing new: level by level, from combinations that are frequent, are no rule, and lose rows with every token."""
    now = settle(baskets.select("row", "blocked", F.explode("items").alias("item")).select("row", "blocked", F.array("item").alias("items")))
    sizes = now.groupBy("items").agg(F.count("*").alias("n"))
    found = []
    while True:
        left = now.select("row", "blocked", "items", F.slice("items", 1, F.size("items") - 1).alias("head"))
        right = left.select("row", "head", F.element_at("items", -1).alias("last"))
        grown = left.join(right.hint("merge"), ["row", "head"]).where(F.element_at("items", -1) < F.col("last")).select("row", "blocked", F.concat("items", F.array("last")).alias("items"))
        grown = settle(grown)
        counts = grown.groupBy("items").agg(F.count("*").alias("n"), F.count_if("blocked").alias("hit")).where(F.col("hit") >= least)
        # a combination with as many rows as one of its parts adds nothing to it
        parts = counts.select("items", "n", "hit", F.explode("items").alias("out")).select("items", "n", "hit", F.array_remove("items", F.col("out")).alias("part"))
        told = parts.join(sizes.select(F.col("items").alias("part"), F.col("n").alias("m")).hint("merge"), "part", "left").groupBy("items").agg(F.first("n").alias("n"), F.first("hit").alias("hit"), F.count_if(F.coalesce(F.col("m") > F.col("n"), F.lit(False))).alias("more"))
        told = settle(told.where(F.col("more") == F.size("items")).select("items", "n", "hit", (F.col("hit") / F.col("n")).alias("confidence")))
        found.append(told.where(F.col("confidence") >= confidence).select(F.col("items").alias("antecedent"), "confidence"))
        following = told.where(F.col("confidence") < confidence)
        if following.isEmpty():
            return reduce(DataFrame.unionByName, found)
        sizes = following.select("items", "n")
        now = settle(grown.join(sizes.select("items").hint("merge"), "items", "left_semi"))


def _uncovered(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """Rules less those that a shorter one is part of: each is looked up, under its rarest token, among the tokens of the others. Settled."""
    rules = settle(rules)
    places = rules.select("antecedent", F.explode("antecedent").alias("token")).join(counts.hint("merge"), "token")
    index = places.groupBy("antecedent").agg(F.min_by("token", F.struct("n", "token")).alias("token")).select(F.col("antecedent").alias("less"), "token")
    member = rules.select("antecedent", F.explode("antecedent").alias("token"))
    covered = member.join(index.hint("merge"), "token").where((F.size("less") < F.size("antecedent")) & (F.size(F.array_except("less", "antecedent")) == 0)).select("antecedent").distinct()
    return settle(rules.join(covered.hint("merge"), "antecedent", "left_anti"))


def mine_rules(labelled: DataFrame, *, min_support: float, min_confidence: float) -> DataFrame:
    """labelled: row, tokens, blocked. token, classes and confidence: rules for blocking, none covered by a shorter one, under each token of their rarest class. Settled.

    A rule fits what holds a token of each of its classes. With nothing labelled there are none.
    """
    rows = labelled.count()
    least = max(1, math.ceil(min_support * rows))
    classes = token_classes(labelled)
    usable = settle(classes.where((F.col("blocked") >= least)))
    sure = usable.where(F.col("blocked") >= min_confidence * F.col("n"))
    open_reps = settle(usable.where((F.col("blocked") < min_confidence * F.col("n")) & (F.col("n") < rows) & (F.col("token") == F.col("rep"))).select("token"))
    baskets = labelled.select("row", "blocked", F.explode("tokens").alias("token")).join(_small(open_reps), "token", "left_semi")
    baskets = settle(baskets.groupBy("row", "blocked").agg(F.sort_array(F.collect_list("token")).alias("items")))
    single = sure.where(F.col("token") == F.col("rep")).select(F.array("token").alias("antecedent"), (F.col("blocked") / F.col("n")).alias("confidence"))
    found = single
    widest = baskets.agg(F.max(F.when(F.col("blocked"), F.size("items")))).first()[0] or 0
    if widest:
        mined = _by_fp_growth(baskets, least, min_confidence) if widest <= WIDE else _by_levels(baskets, least, min_confidence)
        found = single.unionByName(mined)
    reps = usable.where(F.col("token") == F.col("rep")).select("token", "n")
    rules = _uncovered(found, reps)
    members = usable.groupBy("rep").agg(F.sort_array(F.collect_list("token")).alias("members"), F.first("n").alias("n"))  # tokens of one class stand together in every URL that has one
    whole = rules.select("antecedent", "confidence", F.explode("antecedent").alias("rep")).join(members.hint("merge"), "rep")
    whole = whole.groupBy("antecedent", "confidence").agg(F.collect_list("members").alias("classes"), F.min_by("members", F.struct("n", "rep")).alias("rarest"))
    return settle(whole.select(F.explode("rarest").alias("token"), "classes", "confidence"))


def judge_urls(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", labels: DataFrame | None = None, min_support: float = 0.01, min_confidence: float = 0.9) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence of every row.

    labels: url, blocked; without it the URLs that curated rules decide. A null URL, or one without '://', has empty host
    and path and no tokens that rules know but by labels; what no rule blocks is allowed. Rows that repeat are judged
    each; with nothing labelled all is allowed. Further columns are not read.
    """
    url = F.col("url")
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    parsed = own.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    parsed = parsed.withColumn("found", matched_rule(F.col("host"), F.col("path"), rules))
    tested = F.array(*[F.lit(x) for x in (_tested(rules) if labels is None else [])]).cast("array<string>")
    token_list = lambda df: df.withColumn("tokens", F.coalesce(F.array_except(tokens(F.col("url"), F.col("host"), F.col("path")), tested), F.array().cast("array<string>")))
    if labels is None:
        labelled = token_list(parsed.where("found is not null")).select("tokens", (F.col("found.verdict") == "block").alias("blocked"))
    else:
        given = labels.select("url", "blocked").where("url is not null and blocked is not null")
        labelled = token_list(given.withColumn("host", host_of(url)).withColumn("path", path_of(url))).select("tokens", "blocked")
    labelled = settle(settle(labelled).withColumn("row", F.monotonically_increasing_id()))
    index = _small(mine_rules(labelled, min_support=min_support, min_confidence=min_confidence))
    open_urls = token_list(parsed.where("found is null and url is not null").select("url", "host", "path").distinct()).select("url", "tokens")
    posted = open_urls.select("url", "tokens", F.explode("tokens").alias("token"))
    fits = F.forall("classes", lambda c: F.arrays_overlap(c, F.col("tokens")))
    blocked = posted.join(index, "token").where(fits).groupBy("url").agg(F.max("confidence").alias("confidence"))
    judged = parsed.join(settle(blocked).hint("merge"), "url", "left")
    verdict = F.when(F.col("found").isNotNull(), F.col("found.verdict")).when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("found").isNull(), F.col("confidence")).alias("confidence"))
