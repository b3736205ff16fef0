"""Quality rules combined by weak supervision.

Each rule looks at a text's statistics and votes that it is good (1), bad (-1), or abstains (0). Expectation-maximisation over
all texts estimates how often each rule votes, and how, on good and on bad texts; the posterior probability of being good then
takes the place of demanding that every rule passes. Texts enter the estimate as counts of vote patterns, of which there are
at most 3 to the power of the number of rules, however many texts there are.

Everything is built-in DataFrame functions. Defined cases: texts of any length are judged whole; equal votes have equal
posteriors, and a posterior at the threshold is kept; null, empty and blank texts have no words, all statistics are 0 and
they fail; a text of less than five words has no repeated window; rows without an id are judged like others; repeated rows
give repeated results; empty tables give empty results; columns other than the text are not looked at and stay, but for those named like
a result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.storage import materialize

_SPACE = r"[\x20\x09-\x0D]"
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules need besides.

    A text's windows are compared by hash; only texts that have a window twice go on to sort them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.translate(text, _BLANKS[1:], " " * (len(_BLANKS) - 1))
    # The input's columns travel in one of their own, so none of them can have the name of a helper.
    step = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_column).alias("text"))
    step = step.withColumn("_words", F.array_remove(F.split(plain, " "), ""))
    step = step.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    five = F.transform(F.sequence(F.lit(0), F.size("_hashes") - 5), lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(5))))
    step = step.withColumn("_windows", F.when(F.size("_hashes") >= 5, five).otherwise(F.array().cast("array<bigint>")))
    step = step.withColumn("_twice", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    sorted_windows = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("_sorted", F.when(F.col("_twice"), sorted_windows))
    same = lambda x, i: (F.get("_sorted", i - 1)["h"] == x["h"]) | F.coalesce(F.get("_sorted", i + 1)["h"] == x["h"], F.lit(False))
    repeated = F.array_sort(F.transform(F.filter("_sorted", lambda x, i: F.coalesce(same(x, i), F.get("_sorted", i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))
    step = step.withColumn("_at", repeated)
    # A repeated window covers its five words, or those up to the next one.
    covered = F.aggregate("_at", F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")), lambda s, p: F.struct((s["n"] + F.least(F.lit(5), p - s["last"])).alias("n"), p.alias("last")))["n"]
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0)
    step = step.withColumn("_lines", lines)
    squeezed = F.translate(text, _BLANKS, "")
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]++", ""))
    stats = {
        "n_words": F.size("_words"),
        "word_chars": F.length(squeezed),
        "n_symbols": F.length(text) - F.length(F.translate(text, _SYMBOLS, "")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size("_lines"),
        "n_distinct_words": F.size(F.array_distinct("_hashes")),
        "n_letters": letters,
        "n_capitals": F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", "")),
        "n_shouts": F.length(text) - F.length(F.translate(text, "!?", "")),
    }
    kept = [c for c in docs.columns if c not in stats]
    return step.select(*(F.col(f"row.`{c}`").alias(c) for c in kept), *(v.cast("long").alias(k) for k, v in stats.items()))


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, F.lit(-1))
    return (vote if good is None else vote.when(good, F.lit(1))).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Votes of every rule, from the columns of ``statistics``. Most rules know bad texts only, and abstain on all others."""
    c, n, chars = F.col, F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    variety = F.least(n, F.lit(200))
    return {
        "symbols": _vote(c("n_symbols") * 10 > n),
        "letters": _vote(c("n_letters") * 10 < chars * 8, c("n_letters") * 10 >= chars * 9),
        "repeats": _vote(c("n_repeat_words") * 10 > n),
        "dup_lines": _vote(c("n_dup_lines") * 10 > c("n_lines") * 3),
        "variety": _vote(c("n_distinct_words") * 10 < variety * 4, c("n_distinct_words") * 10 >= variety * 7),
        "shouts": _vote(c("n_shouts") * 10 > n),
        "capitals": _vote(c("n_capitals") * 10 > chars * 3),
        "word_length": _vote((chars < n * 3) | (chars > n * 10)),
    }


#: What a rule's votes (-1, 0, 1) are taken to be before anything is learned, on good and on bad texts.
_GOOD, _BAD = {-1: 0.05, 0: 0.45, 1: 0.5}, {-1: 0.5, 0: 0.4, 1: 0.1}


@dataclass(frozen=True)
class Weights:
    """Log-odds of being good: a bias, and what each vote of each rule adds."""

    bias: float
    of: dict[tuple[str, int], float]

    def log_odds(self) -> Column:
        total = F.lit(self.bias)
        for r in dict.fromkeys(r for r, _ in self.of):
            total = total + F.when(F.col(r) == 1, self.of[r, 1]).when(F.col(r) == -1, self.of[r, -1]).otherwise(self.of[r, 0])
        return total

    def posterior(self) -> Column:
        return 1 / (1 + F.exp(-self.log_odds()))


def expectation_maximisation(votes: DataFrame, names: list[str], rounds: int = 12, prior: float = 0.8, weight: float = 20.0) -> Weights:
    """Learn from vote patterns how often each rule votes, and how, on good and on bad texts.

    What is assumed at first is also a prior worth ``weight`` texts, so that "good" keeps its meaning. At first only cast votes
    count; later abstentions tell something too. A vote never counts against what it says. A round is one aggregation over
    patterns that gives two sums for each vote of each rule."""
    patterns = votes.groupBy(*names).agg(F.count("*").alias("n")).select(F.array(*names).alias("votes"), "n")
    patterns = materialize(patterns, "patterns")
    now = Weights(math.log(prior / (1 - prior)), {(r, v): math.log(_GOOD[v] / _BAD[v]) if v else 0.0 for r in names for v in (-1, 0, 1)})
    for _ in range(rounds):
        # The weights are one array, so a round's generated code is that of the round before. Each rule has its part of the bias.
        table = F.array(*(F.lit(now.of[r, v] + now.bias / len(names)) for r in names for v in (-1, 0, 1)))
        odds = sum((F.get(table, F.get("votes", F.lit(k)) + 3 * k + 1) for k in range(len(names))), F.lit(0.0))
        p = patterns.select("n", (1 / (1 + F.exp(-odds))).alias("p"), F.posexplode("votes").alias("rule", "vote"))
        rows = p.groupBy("rule", "vote").agg(F.sum(F.col("p") * F.col("n")).alias("g"), F.sum((1 - F.col("p")) * F.col("n")).alias("b")).collect()
        sums = {(names[r.rule], r.vote): (r.g, r.b) for r in rows}
        good, bad = (sum(sums.get((names[0], v), (0.0, 0.0))[k] for v in (-1, 0, 1)) for k in range(2))
        of = {}
        for r in names:
            for v in (-1, 0, 1):
                seen = sums.get((r, v), (0.0, 0.0))
                on_good = (seen[0] + weight * _GOOD[v]) / (good + weight)
                on_bad = (seen[1] + weight * _BAD[v]) / (bad + weight)
                odds = math.log(on_good / on_bad)
                of[r, v] = max(odds, 0.0) if v > 0 else min(odds, 0.0) if v < 0 else odds
        share = (good + prior * weight) / (good + bad + weight)
        now = Weights(math.log(share / (1 - share)), of)
    return now


def judge(docs: DataFrame, text_column: str = "text", threshold: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (of its columns those in ``carry``, if given) with statistics, ``base_failed``, ``quality`` (posterior probability
    of being good) and ``kept``; columns of these names are replaced, all others stay. The carried columns are written once
    with the statistics, so leave the text out where it isn't needed."""
    votes = rules()
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    carry = docs.columns if carry is None else carry
    known = statistics(docs.select(F.struct(*carry).alias("row"), F.col(text_column).alias("text"))).drop("text")
    stats = [c for c in known.columns if c != "row"]
    judged = materialize(known.withColumn("base_failed", base).withColumns(votes), "statistics")
    learned = expectation_maximisation(judged.select(*votes), list(votes))
    verdict = {"base_failed": F.col("base_failed"), "quality": learned.posterior(), "kept": ~F.col("base_failed") & (learned.posterior() >= threshold)}
    others = [c for c in carry if c not in stats and c not in verdict]
    return judged.select(*(F.col(f"row.`{c}`").alias(c) for c in others), *stats, *(v.alias(k) for k, v in verdict.items()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all whole ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = judge(docs, carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
