"""Substring deduplication by content-defined chunking.

A gear hash rolls over the last 16 characters; a word begins a new chunk if the
hash before it falls into a fixed range, every MEAN_WORDS words at about, and after
MAX_WORDS words at the latest. Cuts depend on what stands near them alone, so
insertions elsewhere do not move them and a passage is cut alike wherever it stands.
Common phrases make equal chunks in unlike texts, so chunks are not compared one by
one, but in stretches of STRETCH words and a few more: from each chunk on to the first
that completes them, and from each chunk back. Any repeat of whole chunks and STRETCH
words is covered by such stretches. They are compared by digest: the first in order
(null ids last, id, text hash, place) stays, later ones are repeats. Repeats that touch
or overlap make a run, and runs of at least MIN_RUN words are removed; each of their
words stands in a stretch that one earlier place has as a whole. STRETCH is below
MIN_RUN, as cuts near the ends of a passage depend on what stands before it: two
earlier copies may back the two ends of a run.

Each task drops the repeats within its own blocks before the shuffle (they are
certain, as an earlier stretch stands beside them) and joins them into runs, so what
stands in a third of all documents travels a few times for each block.

Digests have 64 bits; a false removal would need two stretches to collide.

Rows: null and empty texts have no chunks; rows that repeat id and text are one
document and fare alike; other rows with one id are told apart by their text; an
empty table gives an empty table. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import U64, Words, blocks, map_rows, materialize, mix64, powers, prepare

MEAN_WORDS, MAX_WORDS, MIN_RUN = 5, 64, 16
#: Words that one earlier place must have as a whole, at least.
STRETCH = 12
_ROLL = 16
#: Chunks whose stretches a task compares among themselves before it sends them on.
_BLOCK_CHUNKS = 400_000
#: Documents with repeats that are broadcast at most, and the bytes of their ids and runs.
_BROADCAST, _BROADCAST_BYTES = 100_000, 16 << 20
#: Bytes of a broadcast document beside its id, and of a run, at about.
_DOC_BYTES, _RUN_BYTES = 80, 40
#: The column beside those of the caller, under a name that theirs don't have.
RUNS = "_corpusloom_runs"


def gear(codes: np.ndarray) -> np.ndarray:
    """At each place the sum of the last 16 characters' random values, each shifted by its age."""
    out = mix64(codes.astype(U64) + U64(0x51ED270B))
    span = 1
    while span < _ROLL:
        older = out[:-span] << U64(span)
        out[span:] += older
        span *= 2
    return out


def chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first character, end (the next chunk's first, or the text's end) and digest of every chunk."""
    w = Words(texts, kind="space", lower=False)
    n = len(w.start)
    if not n:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    rolled = gear(w.codes)
    inside = w.start - w.at[w.doc]
    cut = (inside >= _ROLL) & ((rolled[np.maximum(w.start - 1, 0)] >> U64(40)) < U64((1 << 24) // MEAN_WORDS))
    cut |= np.concatenate(([True], w.doc[1:] != w.doc[:-1]))
    first = np.flatnonzero(cut)
    place = np.arange(n) - np.repeat(first, np.diff(np.concatenate((first, [n]))))
    cut |= place % MAX_WORDS == 0
    first = np.flatnonzero(cut)
    size = np.diff(np.concatenate((first, [n])))
    place = np.arange(n) - np.repeat(first, size)
    value = mix64(np.add.reduceat(w.hash * powers(MAX_WORDS, 0xA24BAED4963EE407)[place], first))
    digest = (value & ~U64(127)) | ((size - 1).astype(U64) << U64(1))
    doc = w.doc[first]
    start = w.start[first] - w.at[doc]
    last = np.concatenate((doc[1:] != doc[:-1], [True]))
    end = np.where(last, w.lengths[doc], np.concatenate((start[1:], [0])))
    return doc, start, end, digest


_STEP = 0x9E6C63D0876A9A47 | 1


def stretches(doc: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of chunks in order: first and last chunk, digest, first word (within the document) and words of every stretch."""
    n = len(doc)
    end = np.cumsum(((digest >> U64(1)) & U64(63)).astype(np.int64) + 1)
    begin = np.concatenate((np.zeros(1, np.int64), end[:-1]))[:n]
    every = np.arange(n)
    onward = np.searchsorted(end, begin + STRETCH)
    back = np.searchsorted(begin, end - STRETCH, "right") - 1
    ahead = onward < n
    ahead[ahead] = doc[onward[ahead]] == doc[ahead]
    behind = back >= 0
    behind[behind] = (doc[back[behind]] == doc[behind]) & (onward[back[behind]] != every[behind])
    first, last = np.concatenate((every[ahead], back[behind])), np.concatenate((onward[ahead], every[behind]))
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, U64), np.cumsum(mix64(digest) * powers(n, _STEP)[:n], dtype=U64)))
        own = mix64((total[last + 1] - total[first]) * powers(n, pow(_STEP, -1, 1 << 64))[first])
    head = begin[np.searchsorted(doc, doc)] if n else begin
    return first, last, own, begin[first] - head[first], end[last] - begin[first]


def _joined_up(doc: np.ndarray, word: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of spans by document and place, where each run of touching spans begins in it, and each run's words."""
    order = np.lexsort((word, doc))
    at = (doc[order].astype(np.int64) << 32) + word[order]
    reach = np.maximum.accumulate(at + words[order])
    begins = np.flatnonzero(np.concatenate(([True], at[1:] > reach[:-1]))) if len(order) else np.zeros(0, np.int64)
    return order, begins, np.maximum.reduceat(reach, begins) - at[begins] if len(order) else reach


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_digest, _id, _text_hash, _span, _place) of the stretches; _place holds the first word, the words and a bit that marks a run that its task has found."""
    source = df.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text_hash"), F.col(text_col).alias("_text")).where(F.length("_text") > 0)
    schema = T.StructType([T.StructField("_digest", T.LongType()), T.StructField("_id", df.schema[id_col].dataType), T.StructField("_text_hash", T.LongType()), T.StructField("_span", T.LongType()), T.StructField("_place", T.LongType())])

    def make():
        held: list[tuple] = []
        docs: list[tuple[pa.Array, pa.Array]] = []
        state = {"n": 0, "docs": 0}

        def flush():
            if not held:
                return
            doc, start, end, digest = (np.concatenate(x) for x in zip(*held))
            first, last, digest, word, words = stretches(doc, digest)
            doc, start, end = doc[first], start[first], end[last]
            ids, hashes = pa.concat_arrays([d[0] for d in docs]), pa.concat_arrays([d[1] for d in docs])
            held.clear(), docs.clear(), state.update(n=0, docs=0)
            table = pa.table({"i": ids, "h": hashes})
            order = pc.sort_indices(table, sort_keys=[("i", "ascending"), ("h", "ascending")], null_placement="at_end").to_numpy()
            h, i = hashes.to_numpy(), ids.dictionary_encode().indices.fill_null(-1).to_numpy()
            new = np.concatenate(([False], (h[order][1:] != h[order][:-1]) | (i[order][1:] != i[order][:-1])))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(new)  # repeated rows share their rank
            key = (rank[doc] << 32) + start
            by = np.lexsort((key, digest))
            d, k = digest[by], key[by]
            begins = np.concatenate(([True], d[1:] != d[:-1]))[: len(d)]
            least = k[np.maximum.accumulate(np.where(begins, np.arange(len(k)), 0))]
            repeat = np.zeros(len(d), bool)
            repeat[by] = k > least
            again = np.flatnonzero(repeat)
            order, begins, run = _joined_up(doc[again], word[again], words[again])
            head = again[order][begins]
            tail = np.maximum.reduceat(end[again][order], begins) if len(begins) else end[:0]
            fresh = ~repeat
            span = np.concatenate(((start[fresh] << 32) | end[fresh], (start[head] << 32) | tail))
            place = np.concatenate(((word[fresh] << 32) | (words[fresh] << 1), (word[head] << 32) | (run << 1) | 1))
            known = mix64(h[doc[head]].view(U64) ^ mix64(span[len(span) - len(head) :].view(U64)))
            digest = np.concatenate((digest[fresh], known))
            rows = pa.array(np.concatenate((doc[fresh], doc[head])))
            out = pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), ids.take(rows), hashes.take(rows), pa.array(span), pa.array(place)], names=schema.names)
            for at in range(0, len(out), 50_000):
                yield out.slice(at, 50_000)

        def step(batch: pa.RecordBatch):
            base = state["docs"]
            docs.append((batch.column(0), batch.column(1)))
            state["docs"] += len(batch)
            for first, texts in blocks(batch.column(2).to_pylist()):
                doc, start, end, digest = chunks(texts)
                held.append((doc + first + base, start, end, digest))
                state["n"] += len(doc)
            if state["n"] >= _BLOCK_CHUNKS:
                yield from flush()

        step.finish = flush
        return step

    return map_rows(source, ["_id", "_text_hash", "_text"], make, schema)


def _runs(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Start, end and words of the runs that are long enough, from (start, end, words) of repeats that do not overlap."""
    out: list[list[int]] = []
    for start, end, words in sorted(set(spans)):
        if out and out[-1][1] == start:
            out[-1][1] = end
            out[-1][2] += words
        else:
            out.append([start, end, words])
    return [tuple(x) for x in out if x[2] >= MIN_RUN]


def _repeats(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text_hash, _runs) of the documents that lose runs; _runs is an array of (start, end, words)."""
    rows = _rows(df, id_col, text_col)
    order = Window.partitionBy("_digest").orderBy(F.col("_id").asc_nulls_last(), "_text_hash", "_span")
    later = rows.withColumn("_rank", F.rank().over(order)).where("_rank > 1 or _place & 1 = 1")
    lists = later.groupBy("_id", "_text_hash").agg(F.collect_list(F.struct("_span", "_place")).alias("_spans"))  # no more than a document's stretches
    kind = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end", "words")]))
    schema = T.StructType([lists.schema["_id"], lists.schema["_text_hash"], T.StructField("_runs", kind)])

    def make():
        arrow = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "words")]))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(2)
            parts = lists.flatten()
            span, place = parts.field(0).to_numpy(), parts.field(1).to_numpy()
            doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            order, begins, words = _joined_up(doc, place >> 32, (place & 0xFFFFFFFF) >> 1)
            spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(lists))]
            if len(order):
                ends = np.maximum.reduceat((span & 0xFFFFFFFF)[order], begins)
                for k, *one in zip(doc[order][begins].tolist(), (span >> 32)[order][begins].tolist(), ends.tolist(), words.tolist()):
                    spans[k].append(tuple(one))
            runs = [_runs(x) for x in spans]
            made = pa.array([[dict(zip(("start", "end", "words"), r)) for r in x] for x in runs], arrow)
            kept = pa.array([k for k, x in enumerate(runs) if x], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), made.take(kept)], names=schema.names)

        return step

    return map_rows(lists, ["_id", "_text_hash", "_spans"], make, schema)


def _joined(df: DataFrame, found: DataFrame, id_col: str, text_hash: Column) -> DataFrame:
    """df with a column RUNS (null where nothing is repeated); its text is known by text_hash."""
    found = materialize(found).select(F.col("_id").alias("_corpusloom_id"), F.col("_text_hash").alias("_corpusloom_hash"), F.col("_runs").alias(RUNS))
    length = F.coalesce(F.octet_length(F.col("_corpusloom_id").cast("string")), F.lit(0)) + F.size(RUNS) * _RUN_BYTES + _DOC_BYTES
    docs, size = found.agg(F.count("*"), F.sum(length)).first()
    if docs <= _BROADCAST and (size or 0) <= _BROADCAST_BYTES:
        found = F.broadcast(found)
    match = F.col(id_col).eqNullSafe(F.col("_corpusloom_id")) & (text_hash == F.col("_corpusloom_hash"))
    return df.join(found, match, "left").drop("_corpusloom_id", "_corpusloom_hash")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, the number of its repeated runs, their words and characters, and the runs as start:end (code points)."""
    hashed = df.select(id_col, F.xxhash64(text_col).alias("_corpusloom_text"))  # no text travels if the join is shuffled
    own = _joined(hashed, _repeats(df, id_col, text_col), id_col, F.col("_corpusloom_text"))
    total = lambda f: F.coalesce(F.aggregate(RUNS, F.lit(0).cast("long"), lambda a, r: a + f(r)), F.lit(0).cast("long"))
    return own.select(
        id_col, F.coalesce(F.size(F.coalesce(RUNS, F.expr("array()"))), F.lit(0)).cast("long").alias("n_runs"), total(lambda r: r["words"]).alias("removed_words"), total(lambda r: r["end"] - r["start"]).alias("removed_chars"),
        F.coalesce(F.array_join(F.transform(RUNS, lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))), ","), F.lit("")).alias("runs"),
    )


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of df without the repeated runs; a row that has nothing left goes."""
    prepare(df.sparkSession)
    own = _joined(df, _repeats(df, id_col, text_col), id_col, F.xxhash64(text_col))

    # what stays of a text: the parts between its runs
    start = F.transform(RUNS, lambda r: r["start"])
    end = F.transform(RUNS, lambda r: r["end"])
    froms, tos = F.concat(F.array(F.lit(0)), end), F.concat(start, F.array(F.length(text_col)))
    parts = F.zip_with(froms, tos, lambda a, b: F.substring(F.col(text_col), a + 1, b - a))
    cleaned = F.when(F.col(RUNS).isNull(), F.col(text_col)).otherwise(F.array_join(parts, ""))
    own = own.withColumn(text_col, cleaned)
    return own.where(F.col(RUNS).isNull() | (F.trim(F.col(text_col)) != "")).drop(RUNS)
