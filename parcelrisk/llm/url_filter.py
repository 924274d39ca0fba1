"""URL filter: fixed host and path rules, and rules mined from labelled URLs.

Mining: a URL's tokens (host labels, path segments, file kind, query names)
and the label of its page form one transaction; Spark's FP-growth finds the
frequent token sets.  A set X becomes a block rule when X with the bad label
reaches the support, and its share of X the confidence.  All labelled URLs
are used.  Tokens that occur in exactly the same URLs (a site's host, its labels,
a path that only it has) say the same, so they are one item for the mining; a
rule holds such a class where any token of it would make the rule.  A rule that
contains another one never changes a verdict and is left out.  So the sets that
are mined don't multiply with the parts of a path.

Matching: an inverted index posts each rule under the tokens of its rarest class;
distinct URLs meet it by token, and a posted rule is verified against all tokens.
Common tokens therefore carry no postings unless a rule has no rarer one.

Edge cases: a null URL, or one without ``://``, has an empty host and path and
no tokens, fits no rule and is allowed.  Rows are judged one by one, so null
ids and repeated rows need no rule; the longest fixed rule (host and path
together) wins.  Labels with null id or value don't count.  Without labelled
rows nothing is mined; an empty table of pages gives an empty result.  Other
columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, col, written

_BAD = "label:bad"


@dataclass(frozen=True)
class Rule:
    verdict: str            # "allow" or "block"
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.coalesce(F.position(F.lit("://"), url), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; null if none."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column) -> Column:
    """The different tokens of a URL; none without a host."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)

    def marked(kind: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))

    tokens = F.concat(
        marked("scheme:", F.array(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
        marked("host:", F.array(host)),
        marked("name:", F.split(host, r"[.:]", -1)),
        marked("path:", F.split(path, r"[/.]", -1)),
        marked("kind:", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))),
        marked("query:", F.transform(F.split(query, "&", -1),
                                     lambda x: F.regexp_extract(x, r"^([^=]*)", 1))))
    return F.when(host != "", F.array_distinct(tokens)).otherwise(F.array().cast("array<string>"))


def _merged(bags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bags with one item for tokens of the same bags, (item, tokens) of the items).

    Tokens are of the same bags when two 64-bit sums and two 64-bit parities over the
    hashes of their bags, and the number of these, are the same."""
    at = bags.select("bag", F.explode("items").alias("token"))
    h1, h2 = F.xxhash64("bag"), F.xxhash64(F.lit(1), "bag")
    same = at.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(h1).alias("x1"), F.bit_xor(h2).alias("x2"),
        F.sum(h1.cast("decimal(20,0)")).alias("s1"), F.sum(h2.cast("decimal(20,0)")).alias("s2"))
    # the label is an item of its own, whatever occurs with it
    classes = same.groupBy("n", "x1", "x2", "s1", "s2", F.col("token") == _BAD).agg(
        F.sort_array(F.collect_list("token")).alias("tokens"))
    classes = written(classes.select(F.get("tokens", F.lit(0)).alias("item"), "tokens"), "url-items")
    items = classes.select("item", F.explode("tokens").alias("token"))
    merged = at.join(items, "token").groupBy("bag").agg(F.collect_set("item").alias("items"))
    return merged, classes


def mine_rules(labelled: DataFrame, url_col: str = "url", bad_col: str = "bad",
               min_support: float = 0.001, min_confidence: float = 0.6) -> DataFrame:
    """(tokens, alternatives, post, support, confidence): the least token sets whose
    URLs are bad.

    ``labelled`` has URLs and a boolean; ``min_support`` is the least share of
    all rows that have the whole set and are bad; ``tokens`` has the first token of each
    class of the rule and ``alternatives`` all of them, of which one has to be there;
    ``post`` is the rarest of ``tokens``."""
    spark = labelled.sparkSession
    bags = labelled.filter(col(bad_col).isNotNull()).select(F.concat(
        url_tokens(col(url_col)), F.when(col(bad_col), F.array(F.lit(_BAD))).otherwise(
            F.array().cast("array<string>"))).alias("items")).filter(F.size("items") > 0)
    bags = written(bags.withColumn("bag", F.monotonically_increasing_id()), "url-bags")
    n = bags.count()
    schema = "tokens array<string>, alternatives array<array<string>>, post string, support double, confidence double"
    if not n:
        return spark.createDataFrame([], schema)
    merged, classes = _merged(bags)
    sets = written(FPGrowth(itemsCol="items", minSupport=min_support).fit(
        written(merged, "url-merged")).freqItemsets.select(
        F.sort_array("items").alias("items"), "freq"), "url-sets")
    bad = sets.filter(F.array_contains("items", _BAD) & (F.size("items") > 1)).select(
        F.array_remove("items", _BAD).alias("items"), F.col("freq").alias("n_bad"))
    rules = bad.join(sets, "items").select(
        F.col("items").alias("tokens"), (F.col("n_bad") / n).alias("support"),
        (F.col("n_bad") / F.col("freq")).alias("confidence"))
    rules = rules.filter(F.col("confidence") >= min_confidence)
    single = sets.filter(F.size("items") == 1).select(
        F.get("items", F.lit(0)).alias("token"), F.col("freq").alias("n_token"))
    posted = rules.withColumn("token", F.explode("tokens")).join(single, "token").join(
        classes.select(F.col("item").alias("token"), F.col("tokens").alias("any")), "token")
    post = posted.groupBy("tokens", "support", "confidence").agg(
        F.min(F.struct("n_token", "token"))["token"].alias("post"),
        F.transform(F.sort_array(F.collect_list(F.struct("token", "any"))),
                    lambda x: x["any"]).alias("alternatives"))
    return _least(written(post.select("tokens", "alternatives", "post", "support", "confidence"), "url-rules"))


def _least(rules: DataFrame) -> DataFrame:
    """The rules that contain no other one: those that do meet it by its rarest item."""
    within = rules.select(F.col("tokens").alias("less"), "post")
    met = rules.select("tokens", F.explode("tokens").alias("post")).join(within, "post").filter(
        (F.size("less") < F.size("tokens")) & (F.size(F.array_except("less", "tokens")) == 0))
    return rules.join(met.select("tokens").distinct(), "tokens", "left_anti").select(*rules.columns)


def matched_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """(url): the different URLs that at least one mined rule matches."""
    tokened = urls.select(col(url_col).alias("url")).filter("url is not null").distinct().select(
        "url", url_tokens(F.col("url")).alias("have"))
    if "alternatives" not in rules.columns:          # each token stands for itself
        rules = rules.withColumn("alternatives", F.transform("tokens", lambda x: F.array(x)))
    at = F.array_position("tokens", F.col("post")).cast("int") - 1
    index = rules.select(F.explode(F.get("alternatives", at)).alias("post"), F.col("alternatives").alias("need"))
    posted = tokened.select("url", "have", F.explode("have").alias("post"))
    return posted.join(index, "post").filter(F.forall(
        "need", lambda one: F.arrays_overlap(one, F.col("have")))).select("url").distinct()


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               fixed=RULES) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule`` (the fixed rule that
    decides, else null), ``verdict`` and ``mined`` (a mined rule matches)."""
    bad = matched_urls(pages, rules, url_col).withColumn("hit", F.lit(True))
    src = pages.select(col(id_col).alias("id"), col(url_col).alias("url"))
    df = src.join(bad, "url", "left").select(
        "id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.coalesce("hit", F.lit(False)).alias("mined"))
    name, verdict = fixed_rule(F.col("host"), F.col("path"), fixed)
    df = df.select("id", "host", "path", name.alias("rule"), verdict.alias("verdict"), "mined")
    df = df.withColumn("verdict", F.coalesce("verdict", F.when(F.col("mined"), "block").otherwise(
        "allow")))
    return df.withColumnRenamed("id", id_col)


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): URLs of pages whose id is labelled of low quality or toxic."""
    bad = labels.filter("doc_id is not null and (quality is not null or toxic is not null)").select(
        F.col("doc_id").alias("id"),
        (F.coalesce(F.col("quality") == 0, F.lit(False))
         | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    return pages.select(F.col("page_id").alias("id"), "url").join(bad, "id").select("url", "bad")
