"""Quality of retrieval: graded gain, recall, reciprocal ranks, AUC, quantiles, confusion, replayed tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written
from . import vector


def ndcg(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg, recall) at k of ranked (query_id, row_id, vec_rank) against relevant (query_id, n_relevant, with ranked.relevant as 0 or 1)."""
    gain = F.sum(F.when(F.col("vec_rank") <= k, F.col("relevant") / F.log2(F.col("vec_rank") + 1)).otherwise(0.0))
    hit = F.sum(F.when(F.col("vec_rank") <= k, F.col("relevant")).otherwise(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_relevant")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    own = ranked.groupBy("query_id").agg(gain.alias("_gain"), hit.alias("_hit")).join(relevant.where("n_relevant > 0"), "query_id")
    return own.select("query_id", F.round(F.col("_gain") / ideal, 6).alias("ndcg"), F.round(F.col("_hit") / F.col("n_relevant"), 6).alias("recall"))


def reciprocal(ranked: DataFrame, k: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """success_1, success_3 and mrr of the first relevant row of each query: one row, or one for each kind of query (columns `by`)."""
    first = ranked.groupBy(*by, "query_id").agg(F.min(F.when(F.col("relevant") == 1, F.col("vec_rank"))).alias("_r"))
    share = lambda n: F.round(F.avg(F.when(F.col("_r") <= n, 1.0).otherwise(0.0)), 6)
    return first.groupBy(*by).agg(share(1).alias("success_1"), share(3).alias("success_3"), F.round(F.avg(F.when(F.col("_r") <= k, 1 / F.col("_r")).otherwise(0.0)), 6).alias("mrr"))


def _ranged(rows: DataFrame, column: str) -> DataFrame:
    """rows with _bin, ranges of the column that hold about as many rows each, in its order; equal values share a range. To be written before it is used twice."""
    return rows.repartitionByRange(F.col(column)).withColumn("_bin", F.spark_partition_id())


def _carried(counted: DataFrame, column: str) -> DataFrame:
    """(value, _n, _p, _below, _neg): distinct values with the rows, positives, and rows and negatives before them.

    Counts are carried from range to range, so no task sorts all values.
    """
    bins = counted.groupBy("_bin").agg(F.sum("_n").alias("_a"), F.sum(F.col("_n") - F.col("_p")).alias("_c"))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = bins.select("_bin", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("_a", "_from"), ("_c", "_negfrom"))))
    own = Window.partitionBy("_bin").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    out = counted.join(F.broadcast(base), "_bin")
    return out.withColumn("_below", F.col("_from") + F.coalesce(F.sum("_n").over(own), F.lit(0))).withColumn("_neg", F.col("_negfrom") + F.coalesce(F.sum(F.col("_n") - F.col("_p")).over(own), F.lit(0)))


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One row (auc, n_pos, n_neg): ties count half.

    Equal scores are summed first and ranked over their distinct values, in ranges of
    the score that hold about as many rows each.
    """
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).cast("double").alias("_s"), F.col(label).cast("long").alias("_l"))
    tied = written(_ranged(known, "_s").groupBy("_bin", "_s").agg(F.sum("_l").alias("_p"), F.count("*").alias("_n")))
    won = _carried(tied, "_s").withColumn("_won", F.col("_p") * (F.col("_neg") + (F.col("_n") - F.col("_p")) / 2))
    total = won.agg(F.sum("_won").alias("_won"), F.sum("_p").alias("n_pos"), F.sum(F.col("_n") - F.col("_p")).alias("n_neg"))
    return total.select(F.round(F.col("_won") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0)), 6).alias("auc"), F.coalesce("n_pos", F.lit(0)).alias("n_pos"), F.coalesce("n_neg", F.lit(0)).alias("n_neg"))


def quantile_floor(rows: DataFrame, value: str, q: float) -> DataFrame:
    """One row (value): the sorted value at place floor(q n), the last at most; no interpolation. Null without rows."""
    known = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("value"))
    counted = written(_ranged(known, "value").groupBy("_bin", "value").agg(F.lit(0).cast("long").alias("_p"), F.count("*").alias("_n")))
    total = counted.agg(F.sum("_n").alias("_all"))
    at = _carried(counted, "value").withColumn("_end", F.col("_below") + F.col("_n")).crossJoin(F.broadcast(total))
    return at.where(F.col("_end") > F.least(F.col("_all") - 1, F.floor(F.col("_all") * q))).agg(F.min("value").alias("value"))


def distance_signals(ranked: DataFrame) -> DataFrame:
    """(query_id, d0, margin, mean10) of ranked distances."""
    d, r = F.col("distance"), F.col("vec_rank")
    out = ranked.groupBy("query_id").agg(F.min(F.when(r == 1, d)).alias("d0"), F.max(F.when(r <= 5, F.struct(r, d))).alias("_fifth"), F.avg(F.when(r <= 10, d)).alias("_mean"))
    return out.select("query_id", F.round("d0", 6).alias("d0"), F.round(F.col("_fifth.distance") - F.col("d0"), 6).alias("margin"), F.round("_mean", 6).alias("mean10"))


def verdict(probability: Column, hard: float, weak: float) -> Column:
    """none below hard, weak below weak, else strong; unscored without a finite number."""
    bad = probability.isNull() | F.isnan(probability) | (F.abs(probability) == float("inf"))
    return F.when(bad, "unscored").when(probability < hard, "none").when(probability < weak, "weak").otherwise("strong")


def rerank_ladder(quantized: DataFrame, queries: DataFrame, dims: int, k: int = 10, ladder: tuple[int, ...] = (10, 20, 40, 80, 160)) -> DataFrame:
    """(c, recall): of the true k nearest, how many the sketch scan's best c hold."""
    truth = vector.nearest(vector.restored(quantized), queries, k).select("query_id", "row_id")
    found = vector.nearest(vector.sketch_vectors(quantized, dims), vector.pooled_queries(queries, dims), max(ladder)).select("query_id", "row_id", F.col("vec_rank").alias("_r"))
    ranked = truth.join(found, ["query_id", "row_id"], "left")
    steps = F.array(*(F.lit(c).cast("long") for c in ladder))
    return ranked.select("_r", F.explode(steps).alias("c")).groupBy("c").agg(F.round(F.avg(F.when(F.col("_r") <= F.col("c"), 1.0).otherwise(0.0)), 6).alias("recall"))


def confusion(judged: DataFrame) -> DataFrame:
    """(cls, n, correct, withheld, none_but_recovered, none_but_wrong, false_answer) from judged (cls, answerable, found, verdict, n_results).

    An answerable question without results is withheld; with the answer among them it is
    correct, and recovered where the verdict is none; without, it is wrong or a false
    answer. Of the others a verdict none or no result is correct.
    """
    can, found, none, empty = F.col("answerable"), F.col("found"), F.col("verdict") == "none", F.col("n_results") == 0
    counts = {
        "correct": F.when(can, found & ~empty).otherwise(none | empty), "withheld": can & empty, "none_but_recovered": can & ~empty & found & none,
        "none_but_wrong": can & ~empty & ~found & none, "false_answer": F.when(can, ~empty & ~found & ~none).otherwise(~none & ~empty),
    }
    return judged.groupBy("cls").agg(F.count("*").alias("n"), *(F.count_if(c).alias(n) for n, c in counts.items()))


def rank_classes(ranks: DataFrame, depth: int) -> DataFrame:
    """(query_id, class) from ranks (query_id, mode, rank) of the first row that carries the evidence: top3 of hybrid, gap where no mode reaches it within depth, demotion where vector or lexical has it in the top 3, else range."""
    best = lambda m: F.min(F.when((F.col("mode") == m) & (F.col("rank") <= depth), F.col("rank")))
    own = ranks.groupBy("query_id").agg(best("hybrid").alias("_h"), F.least(best("vector"), best("lexical")).alias("_o"), F.min(F.when(F.col("rank") <= depth, F.col("rank"))).alias("_any"))
    named = F.when(F.col("_any").isNull(), "gap").when(F.col("_h") <= 3, "top3").when(F.col("_o") <= 3, "demotion").otherwise("range")
    return own.select("query_id", named.alias("class"))


def replay(tests: DataFrame, ranked: DataFrame, k: int = 10) -> DataFrame:
    """One row (total, passed, verdict) of tests (query_id, expect_id) against ranked (query_id, row_id, fused_rank)."""
    hits = tests.join(ranked.where(F.col("fused_rank") <= k), (tests["query_id"] == ranked["query_id"]) & (F.col("expect_id") == F.col("row_id")), "left_semi").count()
    total = tests.count()
    state = "no-tests" if not total else "pass" if hits == total else "fail"
    return tests.sparkSession.createDataFrame([(total, hits, state)], "total long, passed long, verdict string")
