"""Calibration of verdicts: standardization, a logistic fit by gradient descent, thresholds and gates.

The fit takes a few hundred probes on the driver (PROBES at most, by rule); what
the probes measure is computed by the engine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx

EPOCHS, RATE, L2, PROBES = 4000, 0.1, 1e-3, 2000
COMMON_WEIGHT, HEADING_WEIGHT, PASSAGES, MIN_WORD = 1 / 3, 0.5, 5, 3
MIN_AUC, MIN_POSITIVES, MIN_NEGATIVES = 0.85, 4, 8
#: Quantile of off-topic rows that sets hard and its ceiling; least width of the weak band and the greatest weak threshold.
HARD_QUANTILE, HARD_CEILING, MIN_BAND, WEAK_CEILING = 0.95, 0.5, 0.08, 0.95
#: Questions written by people from which their gate counts, and the share of them that may be withheld.
MIN_HUMAN, MAX_WITHHELD = 8, 1 / 3
SEED = 424_242


def lcg(seed: int):
    """Numbers in [0, 1) of a 32-bit linear congruence."""
    state = seed & 0xFFFFFFFF
    while True:
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        yield state / (2**32 - 1)


def sample(items: list, n: int, seed: int) -> list:
    """n different items, in the order in which the congruence names them."""
    random, used, out = lcg(seed), set(), []
    while len(out) < n and len(used) < len(items):
        i = int(next(random) * len(items))
        if i not in used and i < len(items):
            used.add(i)
            out.append(items[i])
    return out


@dataclass
class Fit:
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.std) @ self.weights + self.bias
        return 1 / (1 + np.exp(-z))

    def column(self, names: list[str]) -> Column:
        z = F.lit(float(self.bias))
        for n, m, s, w in zip(names, self.mean, self.std, self.weights):
            z = z + (F.col(n) - float(m)) / float(s) * float(w)
        return 1 / (1 + F.exp(-z))


def fit(x: np.ndarray, y: np.ndarray) -> Fit:
    """Class-balanced logistic regression by full-batch gradient descent."""
    if len(x) > PROBES:
        raise ValueError(f"at most {PROBES} probes are fitted on the driver")
    positives = max(1, int(y.sum()))
    weight = np.where(y == 1, len(y) / (2 * positives), len(y) / (2 * max(1, len(y) - positives)))
    mean = (x * weight[:, None]).sum(0) / weight.sum()
    std = np.sqrt((weight[:, None] * (x - mean) ** 2).sum(0) / weight.sum())
    std[std == 0] = 1
    z = (x - mean) / std
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(EPOCHS):
        error = weight * (1 / (1 + np.exp(-(z @ w + b))) - y)
        w, b = w - RATE * (z.T @ error / weight.sum() + L2 * w), b - RATE * error.sum() / weight.sum()
    return Fit(mean, std, w, b)


def auc(positive: np.ndarray, negative: np.ndarray) -> float:
    """Pairs in the right order; ties count half."""
    if not len(positive) or not len(negative):
        return float("nan")
    low, high = np.searchsorted(np.sort(negative), positive, "left"), np.searchsorted(np.sort(negative), positive, "right")
    return float((low + high).sum() / 2 / len(positive) / len(negative))


def quantile(values: np.ndarray, q: float) -> float:
    s = np.sort(values)
    return float(s[min(len(s) - 1, int(q * len(s)))])


def thresholds(positive: np.ndarray, negative: np.ndarray, adjacent: np.ndarray) -> tuple[float, float]:
    """hard and weak from the probabilities of answerable, off-topic and adjacent rows.

    hard is where off-topic rows end, HARD_CEILING at most. weak lies between the
    adjacent rows and the lowest answerable ones, not below where off-topic rows end nor
    above the answerable median, and MIN_BAND above hard.
    """
    floor, ceiling = quantile(positive, 0.05), quantile(negative, HARD_QUANTILE)
    hard = min(ceiling, HARD_CEILING)
    near = adjacent[adjacent > max(ceiling, 0.05)]
    top = quantile(near, 0.9) if len(near) else 0.0
    between = float(np.sqrt(top * floor)) if hard < top < floor else 0.9 * floor
    weak = min(max(between, ceiling, hard), max(quantile(positive, 0.5), hard))
    return hard, min(WEAK_CEILING, max(weak, hard + MIN_BAND))


def calibrated(x: np.ndarray, y: np.ndarray, seed: int = SEED ^ 0xCF01D, folds: int = 5, adjacent: np.ndarray | None = None, human: np.ndarray | None = None, distance: int = 0) -> dict:
    """The fit, its cross-validated AUC, thresholds hard and weak, and the reason why a gate stops it (None: it passes).

    x: signals of answerable (y = 1) and off-topic (0) probes; adjacent: of rows whose
    source ranks low; human: of questions written by people, never fitted; distance: the
    column of the best distance, whose weight must not be above zero.
    """
    order = sample(list(range(len(y))), len(y), seed)
    held, told = np.zeros(len(y)), np.zeros(len(y), bool)
    for f in range(folds):
        test = np.array(order[f::folds], int)
        train = np.setdiff1d(np.arange(len(y)), test)
        if len(test) and 0 < y[train].sum() < len(train):
            held[test], told[test] = fit(x[train], y[train]).probability(x[test]), True
    none = np.zeros((0, x.shape[1]))
    whole = fit(x, y)
    p = whole.probability(x)
    quality = auc(held[told & (y == 1)], held[told & (y == 0)])
    if np.isnan(quality):
        quality = auc(p[y == 1], p[y == 0])
    n, off = int((y == 1).sum()), int((y == 0).sum())
    hard, weak = thresholds(p[y == 1], p[y == 0], whole.probability(none if adjacent is None else adjacent)) if n and off else (0.0, 0.0)
    asked = whole.probability(none if human is None else human)
    reason = None
    if n < MIN_POSITIVES:
        reason = "few positives"
    elif off < MIN_NEGATIVES:
        reason = "few negatives"
    elif not quality >= MIN_AUC:
        reason = "auc"
    elif not whole.weights[distance] <= 0:
        reason = "distance weight"
    elif len(asked) >= MIN_HUMAN and (asked < hard).mean() > MAX_WITHHELD:
        reason = "human questions withheld"
    return {"fit": whole, "auc": quality, "hard": hard, "weak": weak, "passed": reason is None, "reason": reason}


def coverage(pairs: DataFrame, common: DataFrame) -> DataFrame:
    """(query_id, coverage): the largest weighted share of a query's content words that one of its passages grounds.

    pairs (query_id, query, passage_rank, passage); common (word): corpus-wide words,
    which weigh a third. A word counts in full in the body (itself, its plural or
    singular, or its stem) and by half in the heading, the first line.
    """
    strip = lambda words: F.transform(words, fx.strip_possessive)
    words = F.filter(strip(fx.raw_tokens(F.col("query"))), lambda w: ((F.length(w) >= MIN_WORD) | w.rlike("^[0-9]+$")) & ~w.isin(fx.COVERAGE_STOPWORDS))
    queries = pairs.select("query_id", "query").distinct().select("query_id", F.posexplode(words).alias("_k", "_w"))
    queries = queries.join(F.broadcast(common.select(F.col("word").alias("_w"), F.lit(COMMON_WEIGHT).alias("_c"))), "_w", "left").withColumn("_weight", F.coalesce("_c", F.lit(1.0)))
    listed = queries.groupBy("query_id").agg(F.collect_list(F.struct("_w", "_weight")).alias("_words"), F.sum("_weight").alias("_sum"))  # a query's words
    body, heading = strip(fx.raw_tokens(fx.body_of(F.col("passage")))), strip(fx.raw_tokens(fx.heading_of(F.col("passage"))))
    own = pairs.where(F.col("passage_rank") <= PASSAGES).select("query_id", F.array_distinct(body).alias("_b"), F.array_distinct(heading).alias("_h")).withColumn("_s", F.array_distinct(F.transform("_b", fx.stem)))

    def stands(words: str, w: Column) -> Column:
        singular = F.when(w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
        return F.arrays_overlap(F.array(w, F.concat(w, F.lit("s")), F.concat(w, F.lit("es")), singular), F.col(words))

    credit = lambda x: x["_weight"] * F.when(stands("_b", x["_w"]) | F.array_contains("_s", fx.stem(x["_w"])), 1.0).when(stands("_h", x["_w"]), HEADING_WEIGHT).otherwise(0.0)
    joined = own.join(listed, "query_id").select("query_id", (F.aggregate("_words", F.lit(0.0), lambda s, x: s + credit(x)) / F.col("_sum")).alias("_f"))
    return joined.groupBy("query_id").agg(F.round(F.max("_f"), 6).alias("coverage"))
