"""Ranking modes: vector, lexical, augmented and hybrid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.tables import written
from . import lexical, vector

RRF_K, LEXICAL_WEIGHT, GUARD, PIN_TOKENS, PIN_RANKS = 60, 0.5, 0.05, 3, 3
MODES = ("vector", "lexical", "augmented", "hybrid")


def fuse(pool: DataFrame, k: int | None = None, rrf_k: float = RRF_K, weight: float = LEXICAL_WEIGHT, guard: float | None = GUARD) -> DataFrame:
    """Reciprocal ranks of a pool (query_id, row_id, distance, vec_rank, lexical_rank, pinned), ranks from 1.

    A clear nearest row (the second is farther by the share `guard`) stays first; a
    pinned row stands before it.
    """
    score = 1 / (rrf_k + F.col("vec_rank") - 1) + F.coalesce(weight / (rrf_k + F.col("lexical_rank") - 1), F.lit(0.0))
    by = Window.partitionBy("query_id")
    first, second = (F.max(F.when(F.col("vec_rank") == n, F.col("distance"))).over(by) for n in (1, 2))
    clear = F.when(first > 0, (second - first) / first >= guard).otherwise(second > 0) if guard is not None else F.lit(False)
    out = pool.withColumn("fused_score", score).withColumn("_first", F.coalesce((F.col("vec_rank") == 1) & clear, F.lit(False)))
    order = by.orderBy(F.col("pinned").desc(), F.col("_first").desc(), F.round("fused_score", 12).desc(), "distance", "vec_rank")
    out = out.withColumn("fused_rank", F.row_number().over(order).cast("long")).drop("_first", "pinned")
    return out if k is None else out.where(F.col("fused_rank") <= k)


def _near(rows: DataFrame, queries: DataFrame, c: int, exclude: DataFrame | None, tiers: DataFrame | None) -> DataFrame:
    """The c nearest rows of each query, of each tier where there are tiers (at most MAX_DEPTH + 1), ranked together."""
    if tiers is None:
        return vector.nearest(rows, queries, c, exclude=exclude)
    own = rows.join(tiers.select("row_id", "depth"), "row_id")
    out = None
    for (depth,) in sorted(tiers.select("depth").distinct().collect()):
        one = vector.nearest(own.where(F.col("depth") == depth).select("row_id", "vector"), queries, c, exclude=exclude)
        out = one if out is None else out.union(one)
    if out is None:
        return vector.nearest(rows, queries, c, exclude=exclude)
    return out.withColumn("vec_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "row_id")).cast("long"))


def search(records: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, mode: str = "hybrid", exclude: DataFrame | None = None, tiers: DataFrame | None = None, pin: bool = True, near: int | None = None) -> DataFrame:
    """(query_id, row_id, distance, vec_rank, lexical_rank, fused_rank) of the best k.

    records (doc_id, text); vectors as by vector.quantize, row_id being doc_id; queries
    (query_id, text, vector); exclude (row_id) masks rows before every cut. tiers (row_id,
    depth): the layers of a chain, of which each gives its own nearest rows to the pool.
    pin: whether a hit that says the query word for word goes first. near: how many
    nearest rows make the pool (100 or 10 k).

    Rows: a query without tokens has no lexical hits; one without a valid vector finds
    nothing; ties go to the smaller id; without records or queries nothing is found.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if k < 1:
        raise ValueError("k is 1 at least")
    pool, hits = pooled(records, vectors, queries, k, mode, exclude, tiers, near)
    return _ordered(pool, hits, records, queries, k, mode, pin)


def pooled(records: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, mode: str = "hybrid", exclude: DataFrame | None = None, tiers: DataFrame | None = None, near: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(query_id, row_id, distance, lexical_rank, vec_rank) of the candidates that search ranks, and the lexical hits."""
    masked = None if exclude is None else exclude.select(F.col("row_id").alias("record_id"))
    found = _near(vector.restored(vectors), queries, near or max(100, 10 * k), exclude, tiers)
    if mode == "vector":
        return found.select("query_id", "row_id", "distance", F.lit(None).cast("long").alias("lexical_rank"), "vec_rank"), None
    # the hits are few: CANDIDATES for each query
    hits = written(lexical.topk(lexical.bm25(records, queries, query_id="query_id", exclude=masked), cutoff=lexical.CUTOFF).select("query_id", F.col("record_id").alias("row_id"), "lexical_rank"))
    asked, known = hits.select("query_id", "row_id"), None
    if mode != "lexical":  # exact distances of the nearest are known; those of other hits are computed
        known = written(found.select("query_id", "row_id", "distance"))
        asked = asked.join(known, ["query_id", "row_id"], "left_anti")
    others = vector.reranked(asked, vectors, queries).select("query_id", "row_id", "distance")
    pool = (others if known is None else known.union(others)).join(hits, ["query_id", "row_id"], "left")
    return pool.withColumn("vec_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "row_id")).cast("long")), hits


def _ordered(pool: DataFrame, hits: DataFrame | None, records: DataFrame, queries: DataFrame, k: int, mode: str, pin: bool) -> DataFrame:
    if mode == "vector":
        return pool.where(F.col("vec_rank") <= k).select("query_id", "row_id", "distance", "vec_rank", "lexical_rank", F.col("vec_rank").alias("fused_rank"))
    if mode in ("lexical", "augmented"):
        order = Window.partitionBy("query_id").orderBy(*(["lexical_rank"] if mode == "lexical" else ["distance", "row_id"]))
        return pool.withColumn("fused_rank", F.row_number().over(order).cast("long")).where(F.col("fused_rank") <= k).select("query_id", "row_id", "distance", "vec_rank", "lexical_rank", "fused_rank")
    if not pin:
        return fuse(pool.withColumn("pinned", F.lit(False)), k).select("query_id", "row_id", "distance", "vec_rank", "lexical_rank", "fused_rank")
    top = hits.where(F.col("lexical_rank") <= PIN_RANKS).join(records.select(F.col("doc_id").alias("row_id"), F.col("text").alias("_t")), "row_id").join(queries.select("query_id", F.col("text").alias("_q")), "query_id")
    said = fx.phrase(F.col("_q"))
    held = top.where((F.size(F.split(said, " ")) >= PIN_TOKENS) & fx.phrase(F.col("_t")).contains(said))
    pins = held.groupBy("query_id").agg(F.min_by("row_id", "lexical_rank").alias("_pin"))
    pool = pool.join(pins, "query_id", "left").withColumn("pinned", F.coalesce(F.col("_pin") == F.col("row_id"), F.lit(False))).drop("_pin")
    return fuse(pool, k).select("query_id", "row_id", "distance", "vec_rank", "lexical_rank", "fused_rank")


def grid(pool: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, query_id, row_id, fused_rank) of a pool as in fuse under many rules (rule, rrf_k, weight, guard, agree, few).

    guard null: none. agree: lexical ranks count only for rows of vec_rank up to it,
    unless the query has at most `few` lexical hits; null: always.
    """
    many = pool.crossJoin(F.broadcast(rules))  # a handful of rules
    by = Window.partitionBy("rule", "query_id")
    counts = F.col("agree").isNull() | (F.count("lexical_rank").over(by) <= F.col("few")) | (F.col("vec_rank") <= F.col("agree"))
    part = F.when(counts & F.col("lexical_rank").isNotNull(), F.col("weight") / (F.col("rrf_k") + F.col("lexical_rank") - 1)).otherwise(0.0)
    first, second = (F.max(F.when(F.col("vec_rank") == n, F.col("distance"))).over(by) for n in (1, 2))
    clear = F.col("guard").isNotNull() & F.coalesce(F.when(first > 0, (second - first) / first >= F.col("guard")).otherwise(second > 0), F.lit(False))
    scored = many.withColumn("_s", F.round(1 / (F.col("rrf_k") + F.col("vec_rank") - 1) + part, 12)).withColumn("_first", (F.col("vec_rank") == 1) & clear)
    rank = F.row_number().over(by.orderBy(F.col("_first").desc(), F.col("_s").desc(), "distance", "vec_rank"))
    return scored.select("rule", "query_id", "row_id", rank.cast("long").alias("fused_rank"))


def by_pack(hits: DataFrame, k: int) -> DataFrame:
    """The best k of each pack and query of hits (pack, query_id, row_id, distance), with pack_rank; packs are never merged by distance."""
    order = Window.partitionBy("pack", "query_id").orderBy("distance", "row_id")
    return hits.withColumn("pack_rank", F.row_number().over(order).cast("long")).where(F.col("pack_rank") <= k)


def checked(k: int, n_records: int, mode: str = "hybrid", most: int | None = None) -> int:
    """k capped to the corpus and to `most`; a k below 1 or no whole number, and an unknown mode, are errors."""
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k is a whole number of 1 at least")
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if most is not None and k > most:
        raise ValueError(f"k is {most} at most")
    return min(k, max(n_records, 1))


def gated(hits: DataFrame, verdicts: DataFrame, show_abstained: bool = False) -> DataFrame:
    """hits with the verdict of their query (query_id, verdict; missing: unscored); those of the verdict none are withheld unless show_abstained."""
    out = hits.join(verdicts.select("query_id", "verdict"), "query_id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("unscored")))
    return out if show_abstained else out.where("verdict <> 'none'")
