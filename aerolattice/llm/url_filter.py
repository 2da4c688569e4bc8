"""URL filter in DataFrame functions and MLlib: rules by host and path, else gradient-boosted trees.

The trees see lexical features alone: lengths, depth, digits, entropy, parameters, hyphens and statistics
of the host's suffix. They are trained from labelled URLs, of each verdict a sample of bounded size by a hash of
the URL; the statistics of a suffix that a URL is trained with come from the hosts of other folds. Where no
labels are given, hosts with a word of SEED_WORDS between dots and hyphens are labelled block and all others
allow, and no feature names the words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of the contract as (host, path, verdict).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Words that mark a host as unwanted.
SEED_WORDS = ("spam", "farm", "pills", "cheap", "bets", "free", "adult", "casino", "porn", "xxx", "viagra", "poker", "lottery", "escort", "torrent", "warez")
#: Labelled URLs of each verdict that are trained from, about and at most by a hair, and folds of hosts for the statistics of suffixes.
MAX_LABELLED, FOLDS = 5_000, 5
TREES, DEPTH, SEED = 20, 3, 5
FEATURES = ("url_chars", "host_chars", "path_chars", "depth", "labels", "digit_ratio", "host_digit_ratio", "hyphens", "entropy", "params", "query_chars", "suffix_chars", "suffix_share", "suffix_blocked")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path joined, and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, kind in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits for each character of ``text``, by its own shares of characters."""
    n = F.length(text)
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c))) / n)
    return F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))


def features(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path) with the lexical features and ``suffix``, the host's last label."""
    url, digits = F.coalesce("url", F.lit("")), r"[0-9]"
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    n = F.greatest(F.length(url), F.lit(1))
    return urls.select(
        "*",
        F.length(url).alias("url_chars"), F.length("host").alias("host_chars"), F.length("path").alias("path_chars"),
        F.size(F.filter(F.split("path", "/"), lambda x: x != "")).alias("depth"), F.size(F.split("host", r"\.")).alias("labels"),
        (F.regexp_count(url, F.lit(digits)) / n).alias("digit_ratio"),
        (F.regexp_count("host", F.lit(digits)) / F.greatest(F.length("host"), F.lit(1))).alias("host_digit_ratio"),
        F.regexp_count("host", F.lit("-")).alias("hyphens"), F.when(F.length(url) > 0, entropy(url)).otherwise(0.0).alias("entropy"),
        F.size(F.filter(F.split(query, "&"), lambda x: x != "")).alias("params"), F.length(query).alias("query_chars"),
        F.substring_index("host", ".", -1).alias("suffix"),
    ).withColumn("suffix_chars", F.length("suffix"))


def seed_labels(urls: DataFrame) -> Column:
    """1 for a host with a word of SEED_WORDS, else 0."""
    return F.arrays_overlap(F.split("host", r"[.\-]"), F.array(*map(F.lit, SEED_WORDS))).cast("int")


def _blocked(n: Column, blocked: Column) -> Column:
    return ((blocked + 1) / (n + 2)).alias("suffix_blocked")


class UrlModel:
    """The trees, and the statistics of suffixes in what they were trained from (2 * MAX_LABELLED rows at most)."""

    def __init__(self, trees: GBTClassificationModel | None, suffixes: DataFrame | None):
        self.trees, self.suffixes = trees, suffixes

    @staticmethod
    def _vectors(rows: DataFrame, suffixes: DataFrame, *more: str) -> DataFrame:
        joined = rows.join(F.broadcast(suffixes), ["suffix", *more], "left").fillna({"suffix_share": 0.0, "suffix_blocked": 0.5})
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(joined)

    @classmethod
    def train(cls, labelled: DataFrame) -> UrlModel:
        """From rows (url, host, path, label 0 or 1); both labels are needed, else no trees are grown."""
        found = dict(tuple(r) for r in labelled.where("label in (0, 1)").groupBy("label").count().collect())
        share = F.pmod(F.xxhash64("url"), F.lit(1 << 40)) / (1 << 40)  # a sample by hash takes no sort
        drawn = reduce(lambda c, k: c | ((F.col("label") == k) & (share < MAX_LABELLED / found[k])), found, F.lit(False))
        rows = features(labelled.where(drawn)).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS))).cache()
        try:
            sizes = dict(tuple(r) for r in rows.groupBy("label").count().collect())
            if len(sizes) < 2:
                return cls(None, None)
            total = sum(sizes.values())
            spark = labelled.sparkSession
            of_fold = rows.groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.sum("label").alias("blocked")).collect()  # of the sample
            of_fold = spark.createDataFrame(of_fold, "suffix string, fold long, n long, blocked long")
            of_suffix = of_fold.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
            suffixes = of_suffix.select("suffix", (F.col("n") / total).alias("suffix_share"), _blocked(F.col("n"), F.col("blocked")))
            others = of_suffix.join(of_fold.select("suffix", "fold", F.col("n").alias("own_n"), F.col("blocked").alias("own")), "suffix")
            others = others.select("suffix", "fold", (F.col("n") / total).alias("suffix_share"), _blocked(F.col("n") - F.col("own_n"), F.col("blocked") - F.col("own")))
            weights = F.when(F.col("label") == 1, total / (2 * sizes[1])).otherwise(total / (2 * sizes[0]))
            vectors = cls._vectors(rows, others, "fold").select("features", F.col("label").cast("double").alias("label"), weights.alias("weight"))
            trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, weightCol="weight", stepSize=0.3).fit(vectors.coalesce(1))
        finally:
            rows.unpersist()
        return cls(trees, suffixes)

    def judge(self, urls: DataFrame) -> DataFrame:
        """``urls`` (url, host, path) with ``block_probability``."""
        if self.trees is None:
            return urls.withColumn("block_probability", F.lit(0.0))
        scored = self.trees.transform(self._vectors(features(urls), self.suffixes))
        return scored.select(*urls.columns, vector_to_array("probability")[1].alias("block_probability"))


def judge(pages: DataFrame, labels: DataFrame | None = None, rules: tuple = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, host, path, rule, block_probability and verdict of each row of ``pages``.

    ``labels`` has url and label (1 block, 0 allow). A rule's verdict goes before the trees'. Null URLs and
    those without ``://`` have an empty host and path, which no rule fits. Equal rows have equal results;
    other columns are left out. Without labels of both kinds all that no rule fits is allowed.
    """
    own = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url")).withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    if labels is None:
        labelled = own.withColumn("label", seed_labels(own)).select("url", "host", "path", "label").distinct()
    else:
        labelled = labels.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "label")
    judged = UrlModel.train(labelled).judge(own)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_trees = F.when(F.col("block_probability") > 0.5, "block").otherwise("allow")
    return judged.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, by_trees))
