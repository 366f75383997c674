"""Layers from a stream: each micro-batch of new documents becomes a layer, within the drift limit; windows over events.

A pack below a path has tables records/generation=g/depth=d, refused/batch=b and heads,
which gets its row last: a batch that heads names is done, whatever else was left. One
stream writes a pack. At PRODUCER_DEPTH layers the chain is compacted into the base of
the next generation.

Rows: an empty batch makes no layer; repeated rows stay; no row is ever dropped: a
refused batch stops the stream before its offsets are committed, or is kept as a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import layers

HEADS = "batch long, generation long, depth long, n_records long, base long, appended long, state string"


class DriftExceeded(RuntimeError):
    """A batch would pass the drift limit; nothing of it was committed."""


def heads(spark: SparkSession, path: str) -> DataFrame:
    """The batches that are done, with the state each left: base records, records appended since, generation and depth."""
    try:
        return spark.read.schema(HEADS).parquet(f"{path}/heads")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], HEADS)


def records(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the current generation with their depth."""
    last = heads(spark, path).where("state <> 'refused'").agg(F.max("generation")).first()[0]
    return spark.read.parquet(f"{path}/records/generation={last or 0}")


def _done(spark: SparkSession, path: str, *row) -> None:
    spark.createDataFrame([row], HEADS).coalesce(1).write.mode("append").parquet(f"{path}/heads")


def append_batch(batch: DataFrame, batch_id: int, path: str, base_records: int, limit: float = layers.DRIFT_LIMIT, on_refusal: Callable[[int, float], None] | None = None) -> str:
    """Write one batch as the next layer: appended, empty, refused or again (it was done before)."""
    spark = batch.sparkSession
    known = heads(spark, path)
    if not known.where(F.col("batch") == batch_id).isEmpty():
        return "again"
    n = batch.count()
    if not n:
        return "empty"
    last = known.where("state <> 'refused'").orderBy(F.desc("generation"), F.desc("depth")).first()
    generation, depth, base, appended = (last["generation"], last["depth"], last["base"], last["appended"]) if last else (0, 0, base_records, 0)
    drift = (appended + n) / max(1, base)
    if drift > limit:
        if on_refusal is None:
            raise DriftExceeded(f"batch {batch_id} would bring the drift to {drift:.3f}, beyond {limit}; build a new base")
        batch.write.mode("overwrite").parquet(f"{path}/refused/batch={batch_id}")
        _done(spark, path, batch_id, generation, depth, n, base, appended, "refused")
        on_refusal(batch_id, drift)
        return "refused"
    if depth >= layers.PRODUCER_DEPTH:
        old = spark.read.parquet(f"{path}/records/generation={generation}").drop("depth")
        generation, depth, base, appended = generation + 1, 0, base + appended, 0
        old.write.mode("overwrite").parquet(f"{path}/records/generation={generation}/depth=0")
        _done(spark, path, -generation, generation, 0, 0, base, 0, "compacted")
    depth += 1
    batch.drop("depth", "generation").write.mode("overwrite").parquet(f"{path}/records/generation={generation}/depth={depth}")
    _done(spark, path, batch_id, generation, depth, n, base, appended + n, "appended")
    return "appended"


def append_stream(stream: DataFrame, path: str, checkpoint: str, base_records: int, limit: float = layers.DRIFT_LIMIT, on_refusal: Callable[[int, float], None] | None = None) -> StreamingQuery:
    """Write each batch as a layer of path. A batch beyond the drift limit stops the stream (DriftExceeded); with on_refusal it is kept in path/refused and the stream goes on."""

    def write(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, batch_id, path, base_records, limit, on_refusal)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_note(notes: DataFrame, batch_id: int, path: str) -> DataFrame:
    """Append the sound notes of a batch to a journal as one layer, ungated by drift; returns the unsound ones with their reason."""
    from ..operators import chain

    shaped = chain.shaped_notes(notes)
    append_batch(shaped.where("reason is null").drop("reason"), batch_id, path, 1, limit=float("inf"))
    return shaped.where("reason is not null")


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time_col: str = "ts", kind_col: str = "event_type") -> DataFrame:
    """(window_start, kind, n) in tumbling windows behind a watermark; batch or stream."""
    at = F.col(time_col).cast("timestamp")
    own = events.select(at.alias("_at"), F.col(kind_col)).withWatermark("_at", late)
    return own.groupBy(F.window("_at", width).alias("_w"), kind_col).agg(F.count("*").alias("n")).select(F.col("_w.start").alias("window_start"), kind_col, "n")
