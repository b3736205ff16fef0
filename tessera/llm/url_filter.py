"""URL filtering: rules where one fits, and gradient-boosted trees on lexical features for all other URLs.

Features are lengths, depth, digit ratio, character entropy, parameter counts and suffix statistics (how often labelled URLs
under the same host suffix were to be blocked, smoothed by the overall share), all built-in functions. The trees are Spark's,
fitted on a bounded sample of labelled URLs: ``most_labelled`` distinct URLs, those with the smallest hashes, so copies of one
URL count once. Only hashes below a threshold that follows the number of URLs are sorted, and a task sends about its share of
the sample. The suffix statistics and the overall share count all labelled rows; their table is broadcast where it is small,
and joined by shuffle otherwise.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is judged like others, its
features those of an empty text; URLs of any length are taken whole; a URL labelled both ways is learned as what most of its
rows say, ``block`` on ties, and equal hashes are ordered by URL; where labelled URLs are missing, or are all of one kind, the
trees give way to that kind, or to ``allow``; repeated rows give repeated results; empty tables give empty results; other
columns stay, those whose names the operator adds are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.storage import materialize


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))
FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "path_digits", "hyphens", "entropy", "n_params", "query_length", "has_fragment", "secure", "suffix_share", "suffix_seen")
_PRIOR = 20.0  # labelled URLs that the overall share counts for in a suffix's share
_MOST_BROADCAST = 100_000, 8 << 20  # suffixes, and their bytes, that are broadcast


def split_url(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null and where there is no ``://``."""
    # (?s) lets the first part hold line breaks; it is reluctant, so it ends at the first "://".
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, whole, k), F.lit("")) for k in (1, 2))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def _suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def features(urls: DataFrame, url_column: str) -> DataFrame:
    """Lexical features, with the columns host, path and suffix."""
    url = F.coalesce(F.col(url_column), F.lit(""))
    host, path = split_url(url)
    rows = urls.withColumn("host", host).withColumn("path", path).withColumn("_chars", F.array_distinct(F.split(url, "")))
    n = F.greatest(F.length(url), F.lit(1))
    # Entropy over characters: how often each of them comes is what the URL gets shorter without it.
    run = F.transform("_chars", lambda c: F.length(url) - F.length(F.replace(url, c, F.lit(""))))
    entropy = F.aggregate(F.filter(run, lambda k: k > 0), F.lit(0.0), lambda a, k: a - k / n * F.log2(k / n))
    query = F.when(F.instr(url, "?") > 0, F.regexp_extract(url, r"(?s)^[^?]*\?([^#]*)", 1)).otherwise("")
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", ""))
    columns = {
        "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"),
        "depth": F.size(F.array_remove(F.split("path", "/"), "")), "host_labels": F.size(F.split("host", r"\.")),
        "digit_ratio": digits(url) / n, "path_digits": digits(F.col("path")), "hyphens": F.length(url) - F.length(F.translate(url, "-", "")),
        "entropy": entropy, "n_params": F.size(F.array_remove(F.split(query, "[&;]"), "")), "query_length": F.length(query),
        "has_fragment": (F.instr(url, "#") > 0).cast("int"), "secure": url.startswith("https:").cast("int"),
    }
    return rows.withColumns({k: v.cast("double") for k, v in columns.items()}).withColumn("suffix", _suffix(F.col("host"))).drop("_chars")


@dataclass
class UrlModel:
    """Fitted trees and the suffix statistics of all labelled URLs; without trees, one verdict for all."""

    trees: PipelineModel | None
    suffixes: DataFrame | None
    share: float
    small: bool = False

    def blocked(self, rows: DataFrame) -> DataFrame:
        """``rows`` of ``features`` with the trees' verdict in ``_blocked``."""
        if self.trees is None:
            return rows.withColumn("_blocked", F.lit(self.share > 0.5))
        judged = self.trees.transform(_with_suffix(rows.join(F.broadcast(self.suffixes) if self.small else self.suffixes.hint("merge"), "suffix", "left"), self.share))
        return judged.withColumn("_blocked", F.col("prediction") == 1).drop("_features", "rawPrediction", "probability", "prediction", "suffix_share", "suffix_seen")


def _with_suffix(rows: DataFrame, share: float) -> DataFrame:
    known = F.coalesce("_n", F.lit(0.0))
    return (
        rows.withColumn("suffix_share", (F.coalesce("_blocks", F.lit(0.0)) + share * _PRIOR) / (known + _PRIOR))
        .withColumn("suffix_seen", F.log1p(known))
        .drop("_n", "_blocks")
    )


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` distinct URLs with the smallest hashes: url, label, and the numbers of their rows and of those to block."""
    one = rows.groupBy("url").agg(F.count("*").cast("double").alias("own_n"), F.sum("label").alias("own_blocks"))
    one = materialize(one.withColumn("own", F.shiftrightunsigned(F.xxhash64("url"), 1)), "labelled_urls")
    n = one.count()
    if n > most:  # six deviations more than are wanted, then the exact number
        one = one.where(F.col("own") < int((most + 6 * math.sqrt(most) + 6) / n * 2**63))
    chosen = one.orderBy("own", "url").limit(most)
    return chosen.select("url", (F.col("own_blocks") * 2 >= F.col("own_n")).cast("double").alias("label"), "own_n", "own_blocks")


def fit(labelled: DataFrame, url_column: str = "url", label_column: str = "label", most_labelled: int = 20_000, trees: int = 12, depth: int = 4) -> UrlModel:
    """Learn from URLs labelled 1 (block) and 0 (allow)."""
    rows = labelled.where(F.col(label_column).isNotNull() & F.col(url_column).isNotNull()).select(F.col(url_column).alias("url"), F.col(label_column).cast("double").alias("label"))
    counts = rows.groupBy(_suffix(split_url(F.col("url"))[0]).alias("suffix")).agg(F.count("*").cast("double").alias("_n"), F.sum("label").alias("_blocks"))
    suffixes = materialize(counts, "suffixes")
    all_of = suffixes.agg(F.sum("_n").alias("n"), F.sum("_blocks").alias("blocks"), F.count("*").alias("rows"), F.sum(F.octet_length("suffix")).alias("bytes")).first()
    share = all_of.blocks / all_of.n if all_of.n else 0.0
    if share in (0.0, 1.0):
        return UrlModel(None, None, share)
    sample = materialize(features(_sample(rows, most_labelled).coalesce(1), "url"), "sample")
    # Statistics leave a URL's own rows out, else the trees would trust suffixes that are seen once. The sample's are few.
    met = materialize(suffixes.join(F.broadcast(sample.select("suffix").distinct()), "suffix", "left_semi"), "met_suffixes")
    without = sample.join(F.broadcast(met), "suffix").withColumn("_n", F.col("_n") - F.col("own_n")).withColumn("_blocks", F.col("_blocks") - F.col("own_blocks"))
    without = _with_suffix(without, share)
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    booster = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=trees, maxDepth=depth, seed=7, maxMemoryInMB=128)
    fitted = booster.fit(table.transform(without).select("_features", "label"))
    return UrlModel(PipelineModel([table, fitted]), suffixes, share, all_of.rows <= _MOST_BROADCAST[0] and all_of.bytes <= _MOST_BROADCAST[1])


def judge(urls: DataFrame, rules: tuple[Rule, ...], model: UrlModel, url_column: str = "url") -> DataFrame:
    """``urls`` with host, path, rule (the longest that fits, else null), verdict and ``by_model`` (whether the trees gave it)."""
    added = ["host", "path", "rule", "verdict", "by_model"]
    kept = [c for c in urls.columns if c not in added]
    # Input columns travel in a struct, so none can clash with a feature.
    packed = urls.select(F.col(url_column).alias("_url"), F.struct(*kept).alias("_row"))
    rows = model.blocked(features(packed, "_url"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(str(r)), str(r))):
        rule = F.when(fits(r, F.col("host"), F.col("path")), F.lit(str(r))).otherwise(rule)
        verdict = F.when(fits(r, F.col("host"), F.col("path")), F.lit(r.verdict)).otherwise(verdict)
    own = F.when(F.col("_blocked"), "block").otherwise("allow")
    return rows.select("_row.*", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), verdict.isNull().alias("by_model"))


def labelled_by(urls: DataFrame, rules: tuple[Rule, ...], url_column: str = "url") -> DataFrame:
    """URLs that a rule fits, labelled by the longest."""
    host, path = split_url(F.coalesce(F.col(url_column), F.lit("")))
    label = F.lit(None).cast("double")
    for r in sorted(rules, key=lambda r: (len(str(r)), str(r))):
        label = F.when(fits(r, host, path), F.lit(float(r.verdict == "block"))).otherwise(label)
    return urls.select(F.col(url_column).alias("url"), label.alias("label")).where("label is not null")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All URLs of ``pages``; the trees learn from those that rules decide."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, RULES, fit(labelled_by(pages, RULES)))
