"""A vector index in lists: k-means centres, rows by their nearest centre, search in the nearest lists.

Centres are fitted on a bounded sample of rows (SAMPLE, evenly spaced by id); every row
is indexed. A search asks the `probes` lists whose centres are nearest; with all lists
it is exact. Lists are split into blocks, so no list lands in one task. Deleted rows
are masked before every cut; ids never change.

Rows: invalid vectors (null, not finite, zero) are not indexed; repeated ids are rows of
their own; ties go to the smaller id; an empty index finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import written
from . import chunks, vector

#: Rows that the centres are fitted on at most, rounds of the fit, rows of a list that one task scans.
SAMPLE, ROUNDS, BLOCK = 20_000, 12, 8192
LADDER, TARGET_RECALL, MOST_QUERIES = (1, 2, 4, 8, 16, 32, 64, 128, 256), 0.98, 256


def centres(rows: DataFrame, lists: int, seed: int = 7) -> np.ndarray:
    """Centres of rows (row_id, vector) by Lloyd's rounds over directions, from a sample of at most SAMPLE rows; fewer rows than lists are centres each."""
    some = chunks.sampled(rows.select("row_id", "vector"), SAMPLE, "row_id").orderBy("row_id").limit(SAMPLE).toPandas()
    if not len(some):
        return np.zeros((0, 0))
    x = np.array(some["vector"].tolist(), np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    out = x[np.random.default_rng(seed).permutation(len(x))[: min(lists, len(x))]]
    for _ in range(ROUNDS):
        own = (x @ out.T).argmax(1)
        total = np.zeros_like(out)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        new = np.where(size > 1e-30, total / np.maximum(size, 1e-30), out)
        if np.array_equal(new, out):
            break
        out = new
    return out


def assigned(rows: DataFrame, middle: np.ndarray, n: int = 1, id_col: str = "row_id") -> DataFrame:
    """(id, list, list_rank): the n nearest centres of each vector, ties to the smaller list."""
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(len(batch), -1)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
            order = np.argsort(-np.round(x @ middle.T, 9), axis=1, kind="stable")[:, :n]
            who = np.repeat(np.arange(len(batch)), order.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), pa.array(order.ravel().astype(np.int64)), pa.array(np.tile(np.arange(1, order.shape[1] + 1), len(batch)))], names=[id_col, "list", "list_rank"])

    return rows.select(id_col, "vector").mapInArrow(run, f"{id_col} {kind}, list long, list_rank long")


def clusters(rows: DataFrame, k: int) -> DataFrame:
    """(row_id, cluster): topical clusters of rows (row_id, vector) by direction."""
    return assigned(rows, centres(rows, k)).select("row_id", F.col("list").alias("cluster"))


def build(rows: DataFrame, middle: np.ndarray) -> DataFrame:
    """(row_id, vector, list) of every row."""
    return rows.join(assigned(rows, middle).select("row_id", "list"), "row_id").select("row_id", "vector", "list")


def search(index: DataFrame, middle: np.ndarray, queries: DataFrame, k: int, probes: int, exclude: DataFrame | None = None, allow: DataFrame | None = None) -> DataFrame:
    """(query_id, row_id, distance, vec_rank): the k nearest rows by cosine in the `probes` nearest lists of each query (query_id, vector).

    exclude and allow (row_id) mask rows before the cut. With few allowed rows ask more
    lists: filtered() widens until k are found.
    """
    if exclude is not None:
        index = index.join(exclude.select("row_id").distinct(), "row_id", "left_anti")
    if allow is not None:
        index = index.join(allow.select("row_id").distinct(), "row_id", "left_semi")
    blocks = index.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    left = index.join(F.broadcast(blocks), "list").select("list", F.pmod(F.xxhash64("row_id"), "_blocks").cast("int").alias("_block"), "row_id", "vector")  # a row for each list
    asked = assigned(queries, middle, probes, "query_id").join(F.broadcast(blocks), "list").join(queries.select("query_id", "vector"), "query_id")
    right = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), "query_id", "vector")

    def near(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asks):
            return pd.DataFrame({"query_id": [], "row_id": [], "distance": []})
        ids, a, b = rows["row_id"].to_numpy(), np.stack(rows["vector"].to_numpy()).astype(np.float64), np.stack(asks["vector"].to_numpy()).astype(np.float64)
        parts = []
        for at in range(0, len(b), 512):
            far = np.round(1 - (b[at : at + 512] @ a.T).clip(-1, 1), 9) + 0.0
            order = np.lexsort((np.broadcast_to(ids, far.shape), far))[:, :k]
            who = np.repeat(np.arange(len(far)), order.shape[1])
            parts.append(pd.DataFrame({"query_id": asks["query_id"].to_numpy()[at : at + 512][who], "row_id": ids[order.ravel()], "distance": far[who, order.ravel()]}))
        return pd.concat(parts)

    found = left.groupBy("list", "_block").cogroup(right.groupBy("list", "_block")).applyInPandas(near, "query_id long, row_id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "row_id")
    return found.withColumn("vec_rank", F.row_number().over(order).cast("long")).where(F.col("vec_rank") <= k)


def filtered(index: DataFrame, middle: np.ndarray, queries: DataFrame, k: int, probes: int, allow: DataFrame) -> DataFrame:
    """search among the allowed rows; queries that find fewer than k ask twice, then four times the lists, and at last all."""
    done = None
    for p in sorted({min(probes * w, len(middle)) for w in (1, 2, 4)} | {len(middle)}):
        found = written(search(index, middle, queries, k, p, allow=allow))
        full = found.groupBy("query_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= k).select("query_id")
        last = p >= len(middle)
        part = found if last else found.join(full, "query_id", "left_semi")
        done = part if done is None else done.union(part)
        if last:
            return done
        queries = written(queries.join(full, "query_id", "left_anti"))
        if queries.isEmpty():
            return done
    return done


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (recall): the share of truth (query_id, row_id) that was found."""
    both = truth.select("query_id", "row_id").join(found.select("query_id", "row_id", F.lit(1).alias("_hit")), ["query_id", "row_id"], "left")
    return both.agg(F.round(F.avg(F.coalesce("_hit", F.lit(0)).cast("double")), 6).alias("recall"))


def recommended_probes(index: DataFrame, middle: np.ndarray, rows: DataFrame, queries: DataFrame, k: int = 10, target: float = TARGET_RECALL) -> int:
    """The smallest step of LADDER whose recall at k reaches the target, over at most MOST_QUERIES evenly spaced queries."""
    some = written(chunks.sampled(queries.withColumnRenamed("query_id", "row_id"), MOST_QUERIES, "row_id").withColumnRenamed("row_id", "query_id"))
    truth = written(vector.nearest(rows, some, k))
    for p in LADDER:
        if p >= len(middle):
            break
        if (recall(search(index, middle, some, k, p), truth).first()[0] or 0.0) >= target:
            return p
    return len(middle)


def topk_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(query_id, overlap): the share of the k nearest rows that two rankings (query_id, row_id, vec_rank) have in common."""
    left = a.where(F.col("vec_rank") <= k).select("query_id", "row_id")
    right = b.where(F.col("vec_rank") <= k).select("query_id", "row_id", F.lit(1).alias("_hit"))
    return left.join(right, ["query_id", "row_id"], "left").groupBy("query_id").agg(F.round(F.sum(F.coalesce("_hit", F.lit(0))) / k, 6).alias("overlap"))


class VectorIndex:
    """An index kept below a path: batches are appended whole, deletions are a table, compact() rewrites the live rows under their ids.

    The centres are fitted on the first batch (or given) and stay; `rebuild` fits them
    anew.
    """

    def __init__(self, spark: SparkSession, path: str, lists: int = 64, middle: np.ndarray | None = None):
        self.spark, self.path, self.lists = spark, path.rstrip("/"), lists
        self.middle, self.probes, self.n_batches, self.generation = middle, None, 0, 0

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows/generation={self.generation}").select("row_id", "vector", "list")

    def _deleted(self) -> DataFrame | None:
        if not self.n_deletions:
            return None
        return self.spark.read.parquet(f"{self.path}/deleted/generation={self.generation}").select("row_id").distinct()

    n_deletions = 0

    def add(self, rows: DataFrame) -> None:
        """Append a batch (row_id, vector); one invalid vector refuses the whole batch."""
        from ..functions import vectors as vx

        double = rows.select(F.col("row_id").cast("long").alias("row_id"), F.transform("vector", lambda x: x.cast("double")).alias("vector"))
        if not double.where(~vx.valid(F.col("vector"))).isEmpty():
            raise ValueError("the batch has a vector that is null, not finite or zero")
        own = double.withColumn("vector", vx.normalized(F.col("vector")))
        if self.middle is None:
            self.middle = centres(own, self.lists)
        build(own, self.middle).write.mode("overwrite").parquet(f"{self.path}/rows/generation={self.generation}/batch={self.n_batches}")
        self.n_batches += 1

    def delete(self, ids: DataFrame) -> None:
        """Mask rows (row_id)."""
        ids.select(F.col("row_id").cast("long").alias("row_id")).distinct().write.mode("append").parquet(f"{self.path}/deleted/generation={self.generation}")
        self.n_deletions += 1

    def has(self, ids: DataFrame) -> DataFrame:
        """(row_id, stored, deleted) of ids."""
        rows = self._rows().select("row_id", F.lit(True).alias("stored")).distinct()
        out = ids.select("row_id").distinct().join(rows, "row_id", "left")
        dead = self._deleted()
        out = out.withColumn("deleted", F.lit(False)) if dead is None else out.join(dead.withColumn("deleted", F.lit(True)), "row_id", "left")
        return out.select("row_id", F.coalesce("stored", F.lit(False)).alias("stored"), F.coalesce("deleted", F.lit(False)).alias("deleted"))

    def search(self, queries: DataFrame, k: int, probes: int | None = None, allow: DataFrame | None = None) -> DataFrame:
        """The k nearest live rows of queries (query_id, vector); probes: as set by tune(), else all lists."""
        from ..functions import vectors as vx

        asks = queries.select("query_id", vx.normalized(F.col("vector")).alias("vector"))
        rows, dead = self._rows(), self._deleted()
        if dead is not None:
            rows = rows.join(dead, "row_id", "left_anti")
        p = min(probes or self.probes or len(self.middle), len(self.middle))
        return search(rows, self.middle, asks, k, p) if allow is None else filtered(rows, self.middle, asks, k, p, allow)

    def tune(self, queries: DataFrame, k: int = 10, target: float = TARGET_RECALL) -> int:
        """Set the number of lists by measured recall."""
        from ..functions import vectors as vx

        rows = self._rows()
        self.probes = recommended_probes(rows, self.middle, rows.select("row_id", "vector"), queries.select("query_id", vx.normalized(F.col("vector")).alias("vector")), k, target)
        return self.probes

    def state(self) -> DataFrame:
        """One row: stored, live, deleted, deleted_ratio, lists, dims."""
        rows, dead = self._rows(), self._deleted()
        n = rows.agg(F.count("*").alias("stored"))
        gone = rows.join(dead, "row_id", "left_semi") if dead is not None else rows.limit(0)
        out = n.crossJoin(gone.agg(F.count("*").alias("deleted")))
        return out.select("stored", (F.col("stored") - F.col("deleted")).alias("live"), "deleted", F.coalesce(F.round(F.col("deleted") / F.nullif("stored", F.lit(0)), 6), F.lit(0.0)).alias("deleted_ratio"), F.lit(len(self.middle)).alias("lists"), F.lit(int(self.middle.shape[1])).alias("dims"))

    def compact(self) -> None:
        """Rewrite the live rows as a new generation; from half deleted on the centres are fitted anew. Ids stay."""
        rows, dead = self._rows(), self._deleted()
        if dead is None:
            return
        ratio = self.state().first()["deleted_ratio"]
        live = rows.join(dead, "row_id", "left_anti")
        if ratio >= 0.5:
            plain = live.select("row_id", "vector")
            self.middle = centres(plain, self.lists)
            live = build(plain, self.middle)
        live.write.mode("overwrite").parquet(f"{self.path}/rows/generation={self.generation + 1}/batch=0")
        self.generation, self.n_batches, self.n_deletions = self.generation + 1, 1, 0
