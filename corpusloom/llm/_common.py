"""Helpers shared by the training-data operators.

Every operator reads the columns it needs under private names, so extra input
columns, whatever they are called, never clash with its own.
"""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch sent to Python; a batch is cut again by characters below.
BATCH_ROWS = 256
#: Characters that the vectorised code holds at a time (a longer text goes alone).
BLOCK_CHARS = 600_000
#: A side of a join is broadcast only if it has at most this many narrow rows.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a temporary one in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), f"corpusloom-{os.getpid()}")
    return path.rstrip("/")


def materialize(df: DataFrame, files: int = 0) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors.

    files: deal the rows evenly over so many (0: a file for each task), for a narrow
    table that many tasks make. A local folder costs about two processes a file.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    (df.repartition(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if its counted rows are few, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def prepare(spark: SparkSession) -> None:
    """What Python stages need: the package on the workers, and batches that stay small with long texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, so that they can import it anywhere."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="corpusloom-")) / "corpusloom.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


#: What this Python worker keeps from task to task, by the name of its stage: memories that can be cleared.
KEPT: dict[str, dict] = {}


def release(but: str = "") -> None:
    """Clear what other stages left in this worker, as Python workers are used again, and give the memory back."""
    left = [held for name, held in KEPT.items() if name != but and held]
    for held in left:
        held.clear()
    if left:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined while they hold at most so many rows and bytes together."""
    held: list[pa.RecordBatch] = []
    n = b = 0
    for batch in batches:
        if held and (n + len(batch) > rows or b + batch.nbytes > size):
            yield pa.concat_batches(held)
            held, n, b = [], 0, 0
        held.append(batch)
        n, b = n + len(batch), b + batch.nbytes
    if held:
        yield pa.concat_batches(held)


def map_rows(
    df: DataFrame,
    columns: list[str],
    make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None]],
    schema: T.StructType,
    keeps: str = "",
    gather: tuple[int, int] | None = None,
) -> DataFrame:
    """mapInArrow over the named columns; make() runs once in each task and returns the batch function.

    The batch function may have a finish() attribute, whose batches close the task.
    keeps: the name under which the stage keeps a memory in KEPT. gather: rows and bytes
    up to which batches are joined before they are handed on.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keeps)
        step = make()
        for batch in batches if gather is None else _gathered(batches, *gather):
            out = step(batch)
            if out is not None:
                yield from [out] if isinstance(out, pa.RecordBatch) else out
        finish = getattr(step, "finish", None)
        if finish:
            yield from finish()
        release(keeps)  # an idle worker holds nothing of a stage that keeps no memory

    return df.select(*columns).mapInArrow(run, schema)


def blocks(texts: list[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Consecutive runs of whole texts (null: empty) of about limit characters: (first index, texts)."""
    at, held, size = 0, [], 0
    for k, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > limit:
            yield at, held
            at, held, size = k, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield at, held


U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64."""
    out = np.empty(max(n, 1), U64)
    out[0] = 1
    k = 1
    with np.errstate(over="ignore"):
        step = U64(base)
        while k < n:
            take = min(k, n - k)
            out[k : k + take] = out[:take] * step
            step = step * step
            k += take
    return out[:n]


_tables: dict[str, np.ndarray] = {}


def table(name: str) -> np.ndarray:
    """Per code point: 'alnum' and 'space' (ASCII white space) as booleans, 'lower' as the simple lower case."""
    if name not in _tables:
        size = 0x110000
        if name == "alnum":
            _tables[name] = np.fromiter((chr(c).isalnum() for c in range(size)), bool, size)
        elif name == "space":
            out = np.zeros(size, bool)
            out[[9, 10, 11, 12, 13, 32]] = True
            _tables[name] = out
        else:
            _tables[name] = np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(size)), np.uint32, size)
    return _tables[name]


class Words:
    """Words of several texts, found and hashed without a loop over words.

    start, end: places in codes; doc: index of the text; hash: 64 bits; first: for
    each text the index of its first word (and one more entry, the number of words);
    at: for each text its first place in codes. A line feed parts texts.
    """

    def __init__(self, texts: list[str], kind: str = "alnum", lower: bool = True, seed: int = 0):
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.codes, self.lengths = codes, lengths
        self.at = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
        word = table("alnum")[codes] if kind == "alnum" else ~table("space")[codes]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.doc = np.searchsorted(self.at, self.start, "right") - 1
        self.first = np.searchsorted(self.start, np.concatenate((self.at, [len(codes) + 1])))
        shown = table("lower")[codes] if lower else codes
        n = len(self.start)
        if not n:
            self.hash = np.zeros(0, U64)
            return
        size = self.end - self.start
        with np.errstate(over="ignore"):
            first = np.cumsum(size) - size
            within = np.arange(int(size.sum())) - np.repeat(first, size)
            term = (shown[word].astype(U64) + U64(seed * 2 + 1)) * powers(int(size.max()), 0x9E3779B97F4A7C15)[within]
            self.hash = mix64(np.add.reduceat(term, first) + size.astype(U64) * U64(0xD6E8FEB86659FD93))


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row within one text, and the index of each window's first word."""
    count = len(words.hash)
    if count < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        p = powers(n, 0xC2B2AE3D27D4EB4F)
        total = words.hash[: count - n + 1] * p[n - 1]
        for k in range(1, n):
            total = total + words.hash[k : count - n + 1 + k] * p[n - 1 - k]
    inside = words.doc[: count - n + 1] == words.doc[n - 1 :]
    return mix64(total[inside]), np.flatnonzero(inside)
