"""Best-fit packing by a configuration linear program.

A configuration is a multiset of lengths that fits a sequence. The program covers
the histogram of lengths (at most `capacity` entries, whatever the corpus) with as
few configurations as it can: multiplicative weights hold a price for each length,
a knapsack dynamic program finds configurations of the highest price, and covered
lengths grow cheaper. The fractional solution is rounded down; what it leaves over
is packed best-fit, by whole patterns or piece by piece, whichever takes fewer. Where
best-fit decreasing of all pieces takes fewer still, that is the plan.

The histogram is all that reaches the driver. Pieces get their places from their
rank among the pieces of their length: a rank within the task that made them plus
the number of such pieces in earlier tasks, so no length gathers in one task. While
these numbers are few they are broadcast and the pieces stay where they are.

Rows: a null or empty text is one piece that holds only the separator; repeated
rows are packed each; a table without rows gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from ._common import map_rows, materialize, small_or_shuffled

#: Rounds of multiplicative weights, and how fast prices fall.
ROUNDS, RATE = 60, 0.5
#: Configurations taken from one dynamic program, all of nearly the highest price.
COLUMNS, NEAR = 48, 0.97


def _knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best total price within 0..capacity (lengths may repeat), and the length taken last (0: none)."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    flipped = price[::-1]
    for c in range(1, capacity + 1):
        v = best[:c] + flipped[capacity - c : capacity]
        k = int(v.argmax())
        if v[k] > best[c - 1]:
            best[c], last[c] = v[k], c - k
        else:
            best[c] = best[c - 1]
    return best, last


def _take(last: np.ndarray, space: int) -> list[int]:
    found = []
    while space > 0:
        if last[space]:
            found.append(int(last[space]))
            space -= found[-1]
        else:
            space -= 1
    return found


Plan = list[tuple[list[int], int]]


def _bins(planned: Plan) -> int:
    return sum(n for _, n in planned)


def plan(histogram: np.ndarray, capacity: int) -> Plan:
    """(lengths of a sequence, how many such sequences) that hold exactly the histogram (index: length); the fewer of the program's and of best-fit decreasing alone."""
    return min(_by_prices(histogram, capacity), best_fit(histogram, capacity), key=_bins)


def best_fit(histogram: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing, for all equal sequences at a time."""
    held: list[Plan] = [[] for _ in range(capacity + 1)]  # by the space that is left
    for size in (np.flatnonzero(histogram[1:]) + 1)[::-1].tolist():
        n = int(histogram[size])
        while n:
            space = next((k for k in range(size, capacity) if held[k]), capacity)
            config, bins = held[space].pop() if space < capacity else ([], n)
            each = min(space // size, n)
            full = min(bins, n // each)
            held[space - each * size].append((config + [size] * each, full))
            if full < bins and space < capacity:
                held[space].append((config, bins - full))
            n -= full * each
    return [x for own in held for x in own]


def _by_prices(histogram: np.ndarray, capacity: int) -> Plan:
    """The plan of the linear program, rounded down and filled up."""
    left = histogram.astype(np.int64).copy()
    lengths = np.flatnonzero(left)
    lengths = lengths[lengths > 0]
    out: Plan = []
    if not len(lengths):
        return out
    need = left.astype(float)
    covered = np.zeros(capacity + 1)
    use: dict[tuple[int, ...], float] = defaultdict(float)
    for _ in range(ROUNDS):
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(need > 0, covered / need, 0)
        low = share[lengths].min()
        if low >= 1:
            break
        price = np.zeros(capacity + 1)
        price[lengths] = lengths * np.exp(-(share[lengths] - low) / RATE * 8)
        best, last = _knapsack(price[1:], capacity)
        forced = price[lengths] + best[capacity - lengths]
        order = lengths[np.argsort(-forced, kind="stable")]
        top = forced.max()
        taken, done = np.zeros(capacity + 1, bool), 0
        for item in order.tolist():
            if done == COLUMNS or price[item] + best[capacity - item] < NEAR * top:
                break
            if taken[item]:
                continue
            config = tuple(sorted([item, *_take(last, capacity - item)], reverse=True))
            kinds, times = np.unique(config, return_counts=True)
            if (times > left[kinds]).any():
                config = _fit(item, left, capacity)
                kinds, times = np.unique(config, return_counts=True)
            step = float((np.maximum(need[kinds] - covered[kinds], 0.1 * need[kinds]) / times).min())
            use[config] += step
            covered[kinds] += step * times
            taken[kinds] = True
            done += 1
    for config, x in sorted(use.items(), key=lambda y: (-y[1], y[0])):
        kinds, times = np.unique(config, return_counts=True)
        n = int(min(np.floor(x), (left[kinds] // times).min()))
        if n > 0:
            out.append((list(config), n))
            left[kinds] -= n * times
    return out + min(_patterns(left, capacity), best_fit(left, capacity), key=_bins)


def _patterns(left: np.ndarray, capacity: int) -> Plan:
    """The longest piece left with the longest that still fit, each such pattern as often as the histogram allows."""
    left, out = left.copy(), []
    while (rest := np.flatnonzero(left)).size:
        config = _fit(int(rest[-1]), left, capacity)
        kinds, times = np.unique(config, return_counts=True)
        n = max(1, int((left[kinds] // times).min()))
        out.append((list(config), n))
        left[kinds] -= n * times
    return out


def _fit(item: int, left: np.ndarray, capacity: int) -> tuple[int, ...]:
    """item and then, again and again, the largest length left over that still fits."""
    config, space, spent = [item], capacity - item, defaultdict(int)
    spent[item] = 1
    here = np.flatnonzero(left)
    k = len(here)
    while space > 0:
        k = int(np.searchsorted(here[:k], space, "right"))
        while k > 0 and left[here[k - 1]] <= spent[here[k - 1]]:
            k -= 1
        if not k:
            break
        n = int(here[k - 1])
        many = min(space // n, int(left[n]) - spent[n])
        config += [n] * many
        spent[n] += many
        space -= n * many
    return tuple(config)


def layout(planned: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each length its runs of places: key (length * 2**40 + first rank), first sequence, offset."""
    seen: dict[int, int] = defaultdict(int)
    runs, base = [], 0
    for config, n in planned:
        offset = 0
        for size in config:
            runs.append((size, seen[size], base, offset))
            seen[size] += n
            offset += size
        base += n
    a = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return {"key": (a[:, 0] << 40) + a[:, 1], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def pieces(df: DataFrame, path: str, capacity: int, separator: int, id_col: str, text_col: str) -> DataFrame:
    """Token pieces of every document, with the task that made them and their rank among its pieces of that length."""
    names = ["_part", "_rank", "_doc", "piece", "start", "length", "ids_crc32"]
    kinds = [T.IntegerType(), T.LongType(), df.schema[id_col].dataType, T.IntegerType(), T.LongType(), T.LongType(), T.LongType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    end = np.array([separator], "<u4").tobytes()

    def make():
        own, part, ranks = bpe.encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            doc, piece, start, size, crc, rank = [], [], [], [], [], []
            for k, ids in enumerate(own.encode_all(batch.column(1))):
                ids += end
                for j, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part_ids = ids[at : at + 4 * capacity]
                    n = len(part_ids) // 4
                    doc.append(k), piece.append(j), start.append(at // 4), size.append(n), crc.append(zlib.crc32(part_ids)), rank.append(int(ranks[n]))
                    ranks[n] += 1
            i64 = pa.int64()
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(doc), part, np.int32)), pa.array(rank, i64), batch.column(0).take(pa.array(doc, i64)), pa.array(piece, pa.int32()), pa.array(start, i64), pa.array(size, i64), pa.array(crc, i64)], names=names
            )

        return step

    return map_rows(df, [id_col, text_col], make, schema, keeps="bpe", gather=(bpe.GATHER_ROWS, bpe.GATHER_BYTES))


def pack(df: DataFrame, path: str, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each piece of each document with its sequence and place: id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = materialize(pieces(df, path, capacity, separator, id_col, text_col))
    by_task = made.groupBy("_part", "length").count()
    earlier = F.sum("count").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = by_task.select("_part", "length", F.coalesce(earlier, F.lit(0)).alias("_base"))
    histogram, n_base = np.zeros(capacity + 1, np.int64), 0
    for row in by_task.groupBy("length").agg(F.sum("count").alias("pieces"), F.count("*").alias("tasks")).collect():  # at most `capacity` rows
        histogram[row["length"]] = row["pieces"]
        n_base += row["tasks"]
    runs = layout(plan(histogram, capacity))
    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(n, made.schema[c].dataType) for n, c in zip(names[:5], ["_doc", *names[1:5]])] + [T.StructField(n, T.LongType()) for n in names[5:]])
    held = df.sparkSession.sparkContext.broadcast(runs)  # as large as the patterns, which lengths bound

    def make():
        r = held.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            size, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(r["key"], (size << 40) + rank, "right") - 1
            return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(r["sequence"][at] + rank - r["rank"][at]), pa.array(r["offset"][at])], names=names)

        return step

    placed = made.join(small_or_shuffled(base, n_base), ["_part", "length"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    return map_rows(placed, ["_doc", "piece", "start", "length", "ids_crc32", "_rank"], make, schema)
