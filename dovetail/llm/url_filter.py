"""URL filters: rules first, then gradient-boosted trees on lexical features. DataFrame functions only on the executors.

Labelled URLs are those of hosts with a word of a seed list (block) and all others (allow). About ``SAMPLE_ROWS`` of them
at most, distinct and dealt by hash, reach the driver, where the trees are grown on feature columns; the grown trees
become one arithmetic expression, so every URL is judged inside generated code. Suffix statistics are block rates of
all labelled rows by last label of the host, smoothed by the overall rate; up to ``MOST_SUFFIXES`` of them are broadcast, and
more are joined by shuffle with the frequent ones salted.

Null URLs and those without ``://`` have an empty host and path, no rule, and zero features. Equal rows get equal
verdicts. A very long URL is one text like others: its features are counts over its letters. Other columns are kept, columns of the names made here are replaced; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dovetail.llm import common

#: The rules of the contract, (host, path, verdict).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Words of hosts that label a URL as unwanted.
SEED_WORDS = ["ads", "adult", "bets", "casino", "pills", "spam", "xxx", "viagra", "porn", "gambl"]
SAMPLE_ROWS = 20_000
MOST_SUFFIXES, SALTS = 100_000, 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "entropy", "parameters", "longest_label", "suffix_rate"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(text, _SHAPE, 1)
    lowered = F.when(F.octet_length(host) == F.char_length(host), F.lower(host)).otherwise(F.translate(host, _UPPER, _LOWER))
    return lowered, F.regexp_extract(text, _SHAPE, 2)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as its text and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for of, start, said in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is asked first
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(of + start)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _count(text: Column, letters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, letters, ""))


def with_features(urls: DataFrame) -> DataFrame:
    """``urls`` (with url, host, path) and the lexical features, without the suffix rate."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    size = F.greatest(F.char_length(host), F.lit(1)).cast("double")
    entropy = F.lit(0.0)
    for letter in "abcdefghijklmnopqrstuvwxyz0123456789-.":
        share = _count(host, letter) / size
        entropy = entropy - F.when(share > 0, share * F.log2(share)).otherwise(0.0)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return urls.withColumns(
        {
            "suffix": F.substring_index(host, ".", -1),
            "url_length": F.char_length(url).cast("double"),
            "host_length": F.char_length(host).cast("double"),
            "path_length": F.char_length(path).cast("double"),
            "depth": _count(path, "/").cast("double"),
            "labels": _count(host, ".").cast("double"),
            "digit_ratio": _count(url, "0123456789") / F.greatest(F.char_length(url), F.lit(1)),
            "host_digits": _count(host, "0123456789").cast("double"),
            "hyphens": _count(host, "-").cast("double"),
            "entropy": entropy,
            "parameters": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1.0),
            "longest_label": F.array_max(F.transform(F.split(host, r"\."), F.char_length)).cast("double"),
        }
    )


def grow(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 10) -> tuple[float, list]:
    """Boosted regression trees for the log-odds of y. A tree is a leaf's value or (feature, threshold, left, right); left is at most the threshold."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1) if len(x) else np.zeros(x.shape, int)
    score, grown = np.full(len(y), base), []

    def node(rows: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, left: int):
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = (1e-6, None, None)
        for f in range(x.shape[1]) if left and len(rows) >= 2 * least else ():
            k = len(edges[f]) + 1
            b = binned[rows, f]
            gs, hs, ns = (np.cumsum(np.bincount(b, w, k))[:-1] for w in (gradient[rows], hessian[rows], np.ones(len(rows))))
            fine = (ns >= least) & (len(rows) - ns >= least)
            gain = np.where(fine, gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), 0)
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), f, int(gain.argmax()))
        _, f, cut = best
        if f is None:
            value = float(rate * g / (h + 1))
            score[rows] += value
            return value
        low = binned[rows, f] <= cut
        return (f, float(edges[f][cut]), node(rows[low], gradient, hessian, left - 1), node(rows[~low], gradient, hessian, left - 1))

    for _ in range(trees if len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        grown.append(node(np.arange(len(y)), y - p, p * (1 - p), depth))
    return base, grown


def score(model: tuple[float, list]) -> Column:
    """The log-odds of a block, over the feature columns."""

    def column(tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        f, threshold, low, high = tree
        return F.when(F.col(FEATURES[f]) <= threshold, column(low)).otherwise(column(high))

    total = F.lit(model[0])
    for tree in model[1]:
        total = total + column(tree)
    return total


def fit(features: DataFrame, seed_words: list[str], sample_rows: int = SAMPLE_ROWS) -> tuple[tuple[float, list], DataFrame, float, int]:
    """The model, from a bounded sample; suffix, suffix_rate and n, and the overall rate and number, of all labelled rows."""
    labelled = features.where(F.col("host") != "").withColumn("label", F.col("host").rlike("|".join(seed_words)).cast("double"))
    total = labelled.agg(F.count("*").alias("n"), F.sum("label").alias("blocked"), F.approx_count_distinct("url").alias("urls")).first()
    rate = float(((total.blocked or 0.0) + 1) / (total.n + 2))
    rates = common.stash(labelled.groupBy("suffix").agg(((F.sum("label") + 20 * rate) / (F.count("*") + 20)).alias("suffix_rate"), F.count("*").alias("n")), "suffix-rates")
    share = min(1.0, sample_rows / max(total.urls, 1))
    sample = labelled.where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int(share * (1 << 20))).select("url", "suffix", "label", *FEATURES[:-1]).dropDuplicates(["url"])
    rows = sorted(with_rates(sample, rates, rate, total.n).collect(), key=lambda r: r.url)  # about sample_rows, as each URL is there once
    x = np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(len(rows), len(FEATURES))
    return grow(x, np.array([r.label for r in rows])), rates, rate, total.n


def with_rates(rows: DataFrame, rates: DataFrame, rate: float, total: int) -> DataFrame:
    """``rows`` (suffix) with suffix_rate; ``rate`` where there is none."""
    if rates.limit(MOST_SUFFIXES + 1).count() <= MOST_SUFFIXES:
        joined = rows.join(F.broadcast(rates.drop("n")), "suffix", "left")
    else:
        hot = [r.suffix for r in rates.where(F.col("n") > total / 1000.0).select("suffix").collect()]  # a thousand at most
        is_hot = F.col("suffix").isin(hot) if hot else F.lit(False)
        salted = rows.withColumn("salt", F.when(is_hot | (F.col("suffix") == ""), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0))
        spread = rates.drop("n").withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        joined = salted.join(spread, ["suffix", "salt"], "left").drop("salt")
    return joined.withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(rate)))


def judge(urls: DataFrame, rules: list[tuple[str, str, str]] = RULES, seed_words: list[str] = SEED_WORDS) -> DataFrame:
    """``urls`` (url) with host, path, rule, verdict, and block_score (the trees' log-odds)."""
    made = ("host", "path", "rule", "verdict", "block_score")
    mine = urls.select(*(c for c in urls.columns if c not in made and c not in ("suffix", *FEATURES)))
    host, path = host_and_path(F.col("url"))
    features = with_features(mine.withColumns({"host": host, "path": path}))
    model, rates, rate, total = fit(features, seed_words)
    scored = with_rates(features, rates, rate, total).withColumn("block_score", score(model))
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    return scored.withColumns({"rule": rule, "verdict": F.coalesce(said, F.when(F.col("block_score") > 0, "block").otherwise("allow"))}).select(*mine.columns, *made)
