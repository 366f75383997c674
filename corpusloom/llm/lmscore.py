"""LM scoring by cross-entropy difference.

Two matched models, one of the target texts and one of all texts, share a
vocabulary (the tokens of a public BPE file), an order (bigrams over unigrams) and
their smoothing. A document's score is the mean over its tokens of target loss less
background loss: the lower, the closer to the target.

Every document's tokens and bigrams are counted, each bigram (context, token) by
itself: the table of bigrams grows with the corpus and is never held in one place.
Documents stand in chunks of about CHUNK tokens. A chunk sends each of its bigrams
once, with its own counts; sums over all chunks come back to it where they differ,
and it scores its documents. Only counts of single tokens are shared by all.

Rows: a null or empty text has no tokens, no losses and no score; repeated rows
count and are scored each; without a target text the target model is uniform; an
empty table gives an empty table. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from ._common import map_rows, materialize, release, small_or_shuffled

#: Added to each unigram count, and the weight of the unigram model in a bigram's estimate.
ADD, WEIGHT = 0.5, 20.0
#: Tokens of the documents that are scored together (a longer document goes alone).
CHUNK = 1 << 20


def bigrams(ids: np.ndarray, size: np.ndarray, start: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each token of texts of the given sizes, one after another, its context and its bigram's key."""
    before = np.concatenate(([start], ids[:-1])).astype(np.int64)
    before[(np.cumsum(size) - size)[size > 0]] = start
    return before, before * vocabulary + ids


class Model:
    """Losses of tokens under one model."""

    def __init__(self, unigrams: np.ndarray, documents: int, start: int):
        self.p1 = (unigrams + ADD) / (unigrams.sum() + ADD * len(unigrams))
        self.total = unigrams + WEIGHT
        self.total[start] += documents

    def losses(self, ids: np.ndarray, before: np.ndarray, bigram: np.ndarray) -> np.ndarray:
        """bigram: the count of each token's bigram."""
        return np.log(self.total[before]) - np.log(bigram + WEIGHT * self.p1[ids])


def _tokens(df: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """(_id, _target, _ids, _chunk) with the ids as 16-bit integers where they fit."""
    wide = len(bpe.encoder(path).tokens) > 1 << 16
    schema = T.StructType([T.StructField("_id", df.schema[id_col].dataType), T.StructField("_target", T.BooleanType()), T.StructField("_ids", T.BinaryType()), T.StructField("_chunk", T.LongType())])
    width = 4 if wide else 2

    def make():
        own = bpe.encoder(path)
        state = {"chunk": TaskContext.get().partitionId() << 32, "n": 0}

        def chunk(n: int) -> int:
            if state["n"] and state["n"] + n > CHUNK:
                state["chunk"] += 1
                state["n"] = 0
            state["n"] += n
            return state["chunk"]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = own.encode_all(batch.column(2))
            if not wide:
                ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
            chunks = pa.array([chunk(len(x) // width) for x in ids], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), chunks], names=schema.names)

        return step

    return map_rows(df, [id_col, "_target", text_col], make, schema, gather=(bpe.GATHER_ROWS, bpe.GATHER_BYTES))


def _flat(column: pa.ChunkedArray | pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows one after another, and how many each row has."""
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, kind), *parts]).astype(np.int64), np.array([len(p) for p in parts], np.int64)


def _unigrams(tokens: DataFrame, vocabulary: int, kind: str) -> np.ndarray:
    """Two rows, of background and target: counts of tokens, then of documents with tokens."""
    size = vocabulary + 1
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("key", "background", "target")])

    def make():
        total = np.zeros((2, size), np.int64)

        def step(batch: pa.RecordBatch) -> None:
            wanted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            ids, n = _flat(batch.column(0), kind)
            for k, rows in enumerate((np.ones(len(n), bool), wanted)):  # the background is every document
                total[k, :-1] += np.bincount(ids[np.repeat(rows, n)], minlength=vocabulary)
                total[k, -1] += np.count_nonzero(n[rows])

        def finish():
            keys = np.flatnonzero(total[0])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total[0, keys]), pa.array(total[1, keys])], names=schema.names)

        step.finish = finish
        return step

    counts = map_rows(tokens, ["_ids", "_target"], make, schema).groupBy("key").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))
    rows, found = counts.toArrow(), np.zeros((2, size), np.int64)  # at most vocabulary + 1 rows
    key = rows["key"].to_numpy()
    found[0, key], found[1, key] = rows["background"].to_numpy(), rows["target"].to_numpy()
    return found


def _sums(tokens: DataFrame, start: int, vocabulary: int, kind: str) -> DataFrame:
    """(_of, key, background, target): counts over all chunks of the bigrams of chunk _of that others hold too."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("_of", "key", "own", "own_target")])

    def make():
        held: list[tuple] = []
        state = {"chunk": None}

        def flush():
            if not held:
                return
            keys, wanted = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held.clear()
            key, at = np.unique(keys, return_inverse=True)
            own, own_target = np.bincount(at), np.bincount(at, wanted).astype(np.int64)
            for k in range(0, len(key), 50_000):
                part = slice(k, k + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[part]), state["chunk"])), pa.array(key[part]), pa.array(own[part]), pa.array(own_target[part])], names=schema.names)

        def step(batch: pa.RecordBatch):
            chunk, wanted = batch.column(2).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            edge = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for lo, hi in zip(edge, edge[1:]):
                if hi > lo:
                    if chunk[lo] != state["chunk"]:
                        yield from flush()
                        state["chunk"] = int(chunk[lo])
                    ids, n = _flat(batch.column(0).slice(lo, hi - lo), kind)
                    if len(ids):
                        held.append((bigrams(ids, n, start, vocabulary)[1], np.repeat(wanted[lo:hi], n)))

        step.finish = flush
        return step

    own = map_rows(tokens, ["_ids", "_target", "_chunk"], make, schema)
    whole = Window.partitionBy("key")  # at most a row for each chunk
    summed = own.withColumn("background", F.sum("own").over(whole)).withColumn("target", F.sum("own_target").over(whole))
    return summed.where("background <> own").select("_of", "key", "background", "target")


def score(df: DataFrame, target: DataFrame, path: str, start: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, n_tokens, loss_target, loss_background and score; target holds the ids of the target documents."""
    ids = materialize(target.select(F.col(id_col).alias("_target_id")).where("_target_id is not null").distinct())
    marked = df.select(F.col(id_col), F.col(text_col)).join(small_or_shuffled(ids, ids.count()), F.col(id_col) == F.col("_target_id"), "left")
    tokens = materialize(_tokens(marked.select(id_col, text_col, F.col("_target_id").isNotNull().alias("_target")), path, id_col, text_col))
    vocabulary = len(bpe.encoder(path).tokens)
    kind = "<u4" if vocabulary > 1 << 16 else "<u2"
    models = [Model(x[:-1].astype(np.float64), int(x[-1]), start) for x in _unigrams(tokens, vocabulary, kind)]
    shared = df.sparkSession.sparkContext.broadcast(models)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("loss_target", "loss_background", "score"))])

    def step(docs: pa.Table, sums: pa.Table) -> pa.Table:
        release()
        flat, size = _flat(docs["_ids"], kind)
        out, full = np.zeros((2, len(size))), size > 0
        if len(flat):
            before, keys = bigrams(flat, size, start, vocabulary)
            key, at = np.unique(keys, return_inverse=True)
            wanted = np.repeat(docs["_target"].to_numpy().astype(bool), size)
            counts = [np.bincount(at, wanted), np.bincount(at).astype(np.float64)]
            place = np.searchsorted(key, sums["key"].to_numpy())
            edge = (np.cumsum(size) - size)[full]
            for k, (name, model) in enumerate(zip(("target", "background"), reversed(shared.value))):
                counts[k][place] = sums[name].to_numpy()
                out[k, full] = np.add.reduceat(model.losses(flat, before, counts[k][at]), edge) / size[full]
        none = size == 0
        return pa.Table.from_arrays([docs["_id"], pa.array(size), *(pa.array(x, mask=none) for x in (out[0], out[1], out[0] - out[1]))], names=schema.names)

    sums = _sums(tokens, start, vocabulary, kind)
    return tokens.groupBy("_chunk").cogroup(sums.groupBy("_of")).applyInArrow(step, schema)
