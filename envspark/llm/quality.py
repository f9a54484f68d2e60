"""Quality rules by weak supervision, in DataFrame functions only.

Rules vote good (1), bad (-1) or abstain (0).  Expectation-maximisation over the table of vote
patterns (at most 3^rules rows, whatever the corpus) estimates for each rule how often it votes
bad on bad documents and good on good ones; the posterior probability of being good replaces an
all-must-pass filter.

Cases: null and empty texts have no words, fail the base rules and are not kept; repeated rows are
judged alike; on an empty table the rules keep their prior accuracies and nothing is returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, texts

#: Length of the word windows whose repetition counts.
WINDOW = 8
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WORD = r"[^\x20\x09-\x0D]"
ROUNDS = 25
#: Pseudo-counts (bad documents voted bad / not, good documents voted good / not) and the prior share of good documents.
PRIOR = {"hit": 2.0, "miss": 6.0, "pass": 99.0, "slip": 1.0, "good": 0.8, "weight": 20.0}

#: Bounds: rules are set so that they seldom vote bad on good documents, and catch some of the bad ones.
LEAST_PASS, LEAST_HIT = 0.98, 0.1


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules look at, each text being parsed once."""
    step = texts(docs).select(
        "doc_id",
        F.length("text").alias("n_chars"),
        F.array_remove(F.split("text", SPACE), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOL, ""))).alias("n_symbols"),
        (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).alias("n_bangs"),
        (F.upper("text") == F.col("text")).alias("shouted"),
    )
    step = step.select(
        "doc_id", "n_symbols", "n_bangs", "shouted",
        F.size(F.filter("lines", lambda x: x.rlike(SYMBOL))).alias("n_symbol_lines"),
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(
            F.size("words") >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))),
        ).otherwise(F.array().cast("array<long>")).alias("windows"),
    )
    # only texts in which some window occurs twice are sorted
    step = step.withColumn(
        "ordered",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:long,i:int>>")),
    ).drop("windows")
    at = lambda k: F.get(F.col("ordered"), k)["h"]
    found = F.filter("ordered", lambda x, k: at(k - 1).eqNullSafe(x["h"]) | at(k + 1).eqNullSafe(x["h"]))
    step = step.withColumn("starts", F.array_sort(F.transform(found, lambda x: x["i"]))).drop("ordered")
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n"), (p + WINDOW).alias("end")),
        lambda acc: acc["n"],
    )
    return step.withColumn("n_repeat_words", covered).drop("starts")


def rules() -> dict[str, Column]:
    """Rule -> vote.  A rule abstains where its measure says little.  Each kind of junk is looked at
    by more than one rule, as accuracies are learnt from agreement."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    symbols, length, repeats = F.col("n_symbols") / chars, F.col("word_chars") / words, F.col("n_repeat_words") / words
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    dup, bangs = F.col("n_dup_lines") / lines, F.col("n_bangs") / words
    return {
        "long_enough": vote(F.col("n_words") < 20, F.col("n_words") >= 50),
        "few_symbols": vote(symbols > 0.05, symbols < 0.02),
        "plain_words": vote(F.col("n_symbols") / words > 0.2, F.col("n_symbols") / words < 0.05),
        "plain_lines": vote(F.col("n_symbol_lines") / lines > 0.5, F.col("n_symbol_lines") / lines < 0.2),
        "lines_differ": vote(dup > 0.3, dup < 0.1),
        "phrases_differ": vote(repeats > 0.3, repeats < 0.1),
        "word_length": vote((length < 2.5) | (length > 14), length.between(3.5, 10)),
        "not_shouted": vote((bangs > 0.3) | (F.col("shouted") & (F.col("n_words") >= 20)), (bangs < 0.1) & ~F.col("shouted")),
    }


def log_odds(names: list[str], acc: dict[str, tuple[float, float]], good: float) -> Column:
    """Log odds of being good, given the votes: acc[rule] = P(bad vote | bad), P(good vote | good), among votes cast."""
    out = F.lit(math.log(good / (1 - good)))
    for r in names:
        hit, ok = acc[r]
        out = out + F.when(F.col(r) == 1, math.log(ok / (1 - hit))).when(F.col(r) == -1, math.log((1 - ok) / hit)).otherwise(0.0)
    return out


def accuracies(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[dict[str, tuple[float, float]], float]:
    """EM over ``patterns`` (one row per distinct combination of votes, with its count n).  It
    starts from the prior accuracies; pseudo-counts hold a rule that hardly votes near its prior."""
    w, p = PRIOR["weight"], PRIOR
    prior = (p["hit"] / (p["hit"] + p["miss"]), p["pass"] / (p["pass"] + p["slip"]))
    acc, good = dict.fromkeys(names, prior), p["good"]
    for _ in range(rounds):
        q = 1 / (1 + F.exp(-log_odds(names, acc, good)))
        e = patterns.select("n", *names, q.alias("q"))
        sums = [F.sum("n"), F.sum(F.col("n") * F.col("q"))]
        for r in names:
            cast = F.col(r) != 0
            sums += [
                F.sum(F.when(F.col(r) == -1, F.col("n") * (1 - F.col("q"))).otherwise(0.0)),
                F.sum(F.when(cast, F.col("n") * (1 - F.col("q"))).otherwise(0.0)),
                F.sum(F.when(F.col(r) == 1, F.col("n") * F.col("q")).otherwise(0.0)),
                F.sum(F.when(cast, F.col("n") * F.col("q")).otherwise(0.0)),
            ]
        got = [float(x or 0) for x in e.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
        clip = lambda x, low: min(max(x, low), 0.999)
        good = clip((got[1] + w * p["good"]) / (got[0] + w), 0.05)
        for k, r in enumerate(names):
            bad, bad_cast, ok, ok_cast = got[2 + 4 * k : 6 + 4 * k]
            acc[r] = clip((bad + w * prior[0]) / (bad_cast + w), LEAST_HIT), clip((ok + w * prior[1]) / (ok_cast + w), LEAST_PASS)
    return acc, good


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every document with its measures, votes, posterior ``quality`` and verdict ``good``."""
    votes = rules()
    names = list(votes)
    voted = store(measures(docs).withColumns(votes), "votes")
    patterns = store(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "patterns")
    acc, good = accuracies(patterns, names)
    quality = 1 / (1 + F.exp(-log_odds(names, acc, good)))
    return voted.withColumn("quality", quality).withColumn("good", F.col("quality") >= threshold)
