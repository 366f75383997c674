"""Exact nearest neighbours over quantized or plain rows, in blocks.

Queries are packed into blocks that are broadcast, some at a time if they are many.
A task gets each block once, before its own rows; blocks of rows and queries are matrix
products, and only the best k rows of each query leave the task.

Rows: null, empty, non-finite or zero vectors and those of another length than the
first take no part; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as vx

ROW_BLOCK, QUERY_BLOCK, PAIR_BLOCK = 4096, 512, 1024
#: Bytes of query blocks that are broadcast at once.
BROADCAST_BYTES = 32 << 20
#: Hits of queries that a task holds about, and that leave it at once.
STATE, OUT_ROWS = 4_000_000, 100_000


def quantize(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: bool = True) -> DataFrame:
    """(row_id, q, scale, offset, sum_q, sum_q2) of every valid row; cosine normalizes first."""
    vector = F.col(vector_col)
    own = rows.where(vx.valid(vector)).select(F.col(id_col).alias("row_id"), (F.transform(vx.normalized(vector), lambda x: x.cast("float")) if cosine else vector).alias("_v"))
    total = lambda f: F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + f(x))
    return own.select("row_id", F.inline(F.array(vx.quantized(F.col("_v"))))).withColumns({"sum_q": total(lambda x: x), "sum_q2": total(lambda x: x * x)})


def restored(quantized: DataFrame) -> DataFrame:
    """(row_id, vector) of quantized rows."""
    return quantized.select("row_id", vx.restored(F.col("q"), F.col("scale"), F.col("offset")).alias("vector"))


def _blocks(df: DataFrame, size: int, names: tuple[str, str]) -> DataFrame:
    """Packed blocks of (id, vector): ids and matrix as binaries."""
    schema = f"{names[0]} binary, {names[1]} binary"

    def packed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, flat = (np.concatenate(x) for x in zip(*parts))
        return pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary())], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:  # batches may be small; blocks are filled across them
            for at in range(0, len(batch), size):
                part = batch.slice(at, size)
                if n + len(part) > size:
                    yield packed(held)
                    held, n = [], 0
                held.append((part.column(0).to_numpy().astype(np.int64), part.column(1).flatten().to_numpy().astype(np.float64)))
                n += len(part)
        if held:
            yield packed(held)

    return df.mapInArrow(run, schema)


def _with_queries(rows: DataFrame, queries: DataFrame) -> list[DataFrame]:
    """(row_id, vector, qid, qm) of rows, a frame for each BROADCAST_BYTES of queries: the first row of a partition comes once with each block of queries, the others come without, so a task gets the queries once and its rows once."""
    size = queries.agg(F.coalesce(F.sum(8 * F.size("vector")), F.lit(0))).first()[0]
    n = max(1, -(-size // BROADCAST_BYTES))
    own = rows.select("row_id", "vector").withColumn("_first", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0)
    out = []
    for k in range(n):
        some = queries.select("query_id", "vector")
        blocks = _blocks(some if n == 1 else some.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k), QUERY_BLOCK, ("qid", "qm"))
        out.append(own.join(F.broadcast(blocks), F.col("_first"), "left").drop("_first"))
    return out


def _streamed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Of a task of _with_queries: ids and matrix of at most size rows at a time, with all blocks of queries (ids, matrix)."""
    asked: list[tuple[np.ndarray, np.ndarray]] = []
    first: pa.RecordBatch | None = None

    def cut(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
        dim = asked[0][1].shape[1]
        for at in range(0, len(batch), size):
            part = batch.slice(at, size)
            part = part.filter(pc.fill_null(pc.equal(pc.list_value_length(part.column(1)), dim), False))
            if len(part):
                yield part.column(0).to_numpy().astype(np.int64), part.column(1).flatten().to_numpy().astype(np.float64).reshape(-1, dim), asked

    for batch in batches:
        new = batch.column(2).is_valid()
        for at in np.flatnonzero(new.to_numpy(zero_copy_only=False)):  # blocks stand before all other rows, but may take several batches
            q = np.frombuffer(batch.column(2)[at].as_py(), np.int64)
            block = np.frombuffer(batch.column(3)[at].as_py()).reshape(len(q), -1)
            if not asked or block.shape[1] == asked[0][1].shape[1]:
                asked.append((q, block))
            if first is None:
                first = pa.RecordBatch.from_pylist([{n: batch.column(n)[at].as_py() for n in ("row_id", "vector")}], batch.select(["row_id", "vector"]).schema)
        if not asked and len(batch):
            return
        rest = batch.select(["row_id", "vector"]).filter(pc.invert(new))
        if len(rest):
            if first is not None and len(first):
                yield from cut(first)
                first = first.slice(0, 0)
            yield from cut(rest)
    if first is not None and len(first):
        yield from cut(first)


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, as SQL rounds; no negative zero."""
    y = np.abs(x) * 10.0**digits
    low = np.floor(y)
    return np.copysign(low + (y - low >= 0.5), x) / 10.0**digits + 0.0


def nearest(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", exclude: DataFrame | None = None, allow: DataFrame | None = None, skip_self: bool = False, digits: int = 9) -> DataFrame:
    """(query_id, row_id, distance, vec_rank): the k nearest rows (row_id, vector) of each query (query_id, vector), by the distance rounded to digits.

    exclude and allow (row_id) mask rows before the cut. skip_self leaves out the row
    that has the query's id.
    """
    if exclude is not None:
        rows = rows.join(exclude.select("row_id").distinct(), "row_id", "left_anti")
    if allow is not None:
        rows = rows.join(allow.select("row_id").distinct(), "row_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[_Best] = []
        for ids, own, asked in _streamed(batches, ROW_BLOCK):
            best = best or [_Best(q, k) for q, _ in asked]
            square = (own * own).sum(1)
            for (who, block), kept in zip(asked, best):
                near = block @ own.T
                if metric == "cosine":
                    far = np.subtract(1, near, out=near)
                else:
                    far = (block * block).sum(1)[:, None] + square[None] - 2 * near
                kept.take(far, ids, metric, skip_self, digits)
            if sum(x.size for x in best) > STATE:  # what is held leaves; the window below cuts it
                for kept in best:
                    yield from kept.given()
        for kept in best:
            yield from kept.given()

    parts = [both.mapInArrow(run, "query_id long, row_id long, distance double") for both in _with_queries(rows, queries)]
    order = Window.partitionBy("query_id").orderBy("distance", "row_id")
    return reduce(DataFrame.union, parts).withColumn("vec_rank", F.row_number().over(order).cast("long")).where(F.col("vec_rank") <= k)


class _Best:
    """The k nearest rows so far of each query of a block."""

    def __init__(self, who: np.ndarray, k: int):
        self.who, self.k, self.size = who, k, 0
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.limit = np.full(len(who), np.inf)  # the kth distance, where k rows were seen

    def take(self, far: np.ndarray, ids: np.ndarray, metric: str, skip_self: bool, digits: int) -> None:
        """Rows of a product whose rounded distance may be among the k least. far: one less the dot, or squared distances."""
        slack = 10.0**-digits  # rounding moves a distance by half of it
        if skip_self:
            far[self.who[:, None] == ids[None]] = np.inf
        if np.isinf(self.limit).any() and far.shape[1] > self.k:
            least = np.partition(far, self.k - 1, axis=1)[:, self.k - 1]
            some = np.minimum(self.limit, least if metric == "cosine" else np.sqrt(np.maximum(least, 0)))
        else:
            some = self.limit
        most = np.maximum(some, 0) + 2 * slack
        q, r = np.nonzero(far <= (most if metric == "cosine" else most * most)[:, None])
        d = far[q, r]
        good = np.isfinite(d)
        d = d.clip(0, 2) if metric == "cosine" else np.sqrt(np.maximum(d, 0))
        self.held.append((q[good].astype(np.int32), ids[r[good]], _rounded(d[good], digits)))
        self.size += len(self.held[-1][0])
        if self.size >= (1 if np.isinf(self.limit).any() else 2) * self.k * len(self.who):
            self._cut()

    def _cut(self) -> None:
        q, ids, d = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, d, q))
        q, ids, d = q[order], ids[order], d[order]
        start = np.searchsorted(q, np.arange(len(self.who)))
        good = np.arange(len(q)) - start[q] < self.k
        last = start + self.k - 1
        full = (last < len(q)) & (q[np.minimum(last, max(len(q) - 1, 0))] == np.arange(len(self.who))) if len(q) else np.zeros(len(self.who), bool)
        self.limit = np.where(full, d[np.minimum(last, len(q) - 1)] if len(q) else np.inf, np.inf)
        self.held, self.size = [(q[good], ids[good], d[good])], int(good.sum())

    def given(self) -> Iterator[pa.RecordBatch]:
        """What is held, cut to k; then only the limits are kept."""
        if self.size:
            self._cut()
            q, ids, d = self.held[0]
            for at in range(0, len(q), OUT_ROWS):
                end = at + OUT_ROWS
                yield pa.RecordBatch.from_arrays([pa.array(self.who[q[at:end]]), pa.array(ids[at:end]), pa.array(d[at:end])], names=["query_id", "row_id", "distance"])
        self.held, self.size = [], 0


def symmetric(pairs: DataFrame, quantized: DataFrame, dims: int, metric: str = "cosine") -> DataFrame:
    """(a, b, distance) of pairs of rows (a, b) from their codes alone: sums, sums of squares and the product of codes; l2 is squared."""
    side = lambda x: quantized.select(F.col("row_id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("q", "scale", "offset", "sum_q", "sum_q2")))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    c = lambda n: F.col(n).cast("double")
    dot = vx.dot(F.col("q_a"), F.col("q_b"))
    if metric == "cosine":
        product = dims * c("offset_a") * c("offset_b") + c("offset_a") * c("scale_b") * c("sum_q_b") + c("offset_b") * c("scale_a") * c("sum_q_a") + c("scale_a") * c("scale_b") * dot
        distance = 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product))
    else:
        apart = c("offset_a") - c("offset_b")
        distance = dims * apart * apart + 2 * apart * (c("scale_a") * c("sum_q_a") - c("scale_b") * c("sum_q_b")) + c("scale_a") * c("scale_a") * c("sum_q2_a") + c("scale_b") * c("scale_b") * c("sum_q2_b") - 2 * c("scale_a") * c("scale_b") * dot
    return both.select("a", "b", distance.alias("distance"))


def symmetric_all(rows: DataFrame, queries: DataFrame, dims: int, metric: str = "cosine", digits: int = 6) -> DataFrame:
    """(a, b, distance) as in symmetric of every query a with every row b, both as by quantize, rounded.

    Codes travel once: a task gets the blocks of queries before its own rows, forms
    products of blocks and shuffles nothing. Memory holds the queries and one product.
    """
    flat = lambda df, name: df.select(F.col("row_id").alias(name), F.concat(F.transform(F.array("scale", "offset", "sum_q", "sum_q2"), lambda x: x.cast("double")), F.transform("q", lambda x: x.cast("double"))).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows, asked in _streamed(batches, PAIR_BLOCK):
            sb, ob, nb, mb = rows[:, :4].T
            for who, block in asked:
                for at in range(0, len(who), PAIR_BLOCK // 4):
                    q = block[at : at + PAIR_BLOCK // 4]
                    sa, oa, na, ma = (x[:, None] for x in q[:, :4].T)
                    dot = q[:, 4:] @ rows[:, 4:].T  # of whole numbers, so exact
                    if metric == "cosine":
                        far = 1 - (dims * oa * ob + oa * sb * nb + ob * sa * na + sa * sb * dot).clip(-1, 1)
                    else:
                        far = dims * (oa - ob) * (oa - ob) + 2 * (oa - ob) * (sa * na - sb * nb) + sa * sa * ma + sb * sb * mb - 2 * sa * sb * dot
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(who[at : at + len(q)], len(ids))), pa.array(np.tile(ids, len(q))), pa.array(_rounded(far, digits).ravel())], names=["a", "b", "distance"])

    parts = [both.mapInArrow(run, "a long, b long, distance double") for both in _with_queries(flat(rows, "row_id"), flat(queries, "query_id"))]
    return reduce(DataFrame.union, parts)


def candidates_kept(k: int, live: int, rerank: int | None = None, recommended: int | None = None, tier: str = "full", most: int = 4096) -> int:
    """How many candidates the sketch scan keeps: as asked, else as recommended (`most` at most), else 100 or 10 k; four times as many on the micro tier, never more than there are."""
    c = rerank or (min(recommended, most) if recommended else max(100, 10 * k))
    return min(live, max(k, c * (4 if tier == "micro" else 1)))


def sketches(quantized: DataFrame, dims: int, pool: int = 2, bits: int = 4) -> DataFrame:
    """(row_id, sketch): pooled codes."""
    return quantized.select("row_id", vx.pooled(F.col("q"), dims, pool, bits).alias("sketch"))


def sketch_vectors(quantized: DataFrame, dims: int, pool: int = 2, bits: int = 4) -> DataFrame:
    """(row_id, vector) that a sketch stands for, times the pool, so that its dot with a pooled query nears the full one."""
    code = F.transform(vx.pooled(F.col("q"), dims, pool, bits), lambda c: c * (17 if bits == 4 else 1))
    return quantized.select("row_id", F.transform(vx.restored(code, F.col("scale"), F.col("offset")), lambda x: x * pool).alias("vector"))


def pooled_queries(queries: DataFrame, dims: int, pool: int = 2) -> DataFrame:
    mean = lambda i: F.aggregate(F.slice("vector", i * pool + 1, pool), F.lit(0.0), lambda s, x: s + x.cast("double")) / pool
    return queries.select("query_id", F.transform(F.sequence(F.lit(0), F.lit(dims // pool - 1)), mean).alias("vector"))


def two_stage(quantized: DataFrame, queries: DataFrame, dims: int, k: int, rerank: int | None = None, pool: int = 2, bits: int = 4) -> DataFrame:
    """The sketch scan's best C (100 or 10 k at least) ranked again by exact distance, the best k kept."""
    c = max(k, rerank or max(100, 10 * k))
    first = nearest(sketch_vectors(quantized, dims, pool, bits), pooled_queries(queries, dims, pool), c).select("query_id", "row_id")
    return reranked(first, quantized, queries, k)


def reranked(candidates: DataFrame, quantized: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """Candidates (query_id, row_id) by exact distance to quantized rows, the best k of each query."""
    asked = candidates.select("query_id", "row_id")
    full = asked.join(queries.select("query_id", F.col("vector").alias("_q")), "query_id").join(quantized, "row_id").withColumn("vector", vx.restored(F.col("q"), F.col("scale"), F.col("offset")))
    scored = full.select("query_id", "row_id", F.round(vx.cosine_distance(F.col("_q"), F.col("vector")), 9).alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "row_id")
    ranked = scored.withColumn("vec_rank", F.row_number().over(order).cast("long"))
    return ranked if k is None else ranked.where(F.col("vec_rank") <= k)
