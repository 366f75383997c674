"""A versioned corpus: layers that append, delete and supersede records of a base.

Tables: layers (depth, identity, parent, n_records); tombstones (depth, record_id);
supersessions (depth, old_id, new_id). Ids are dense over all layers; a layer owns
[row_base, row_end). The table of layers is small by rule (at most MAX_DEPTH + 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_DEPTH, PRODUCER_DEPTH, DRIFT_LIMIT, MAX_HOPS = 16, 8, 0.20, 64


def intervals(layers: DataFrame) -> DataFrame:
    """layers with row_base and row_end."""
    order = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)  # at most MAX_DEPTH + 1 rows
    return layers.withColumn("row_end", F.sum("n_records").over(order).cast("long")).withColumn("row_base", F.col("row_end") - F.col("n_records"))


def owners(ids: DataFrame, layers: DataFrame, id_col: str = "record_id") -> DataFrame:
    """ids with the depth and the local id of the layer that owns each; ids beyond all layers go."""
    own = F.broadcast(intervals(layers).select("depth", "row_base", "row_end"))
    return ids.join(own, (F.col(id_col) >= F.col("row_base")) & (F.col(id_col) < F.col("row_end"))).select(*ids.columns, "depth", (F.col(id_col) - F.col("row_base")).alias("local_id"))


def live(records: DataFrame, tombstones: DataFrame, head: int | None = None) -> DataFrame:
    """Records not deleted by any layer up to head."""
    dead = tombstones if head is None else tombstones.where(F.col("depth") <= head)
    return records.join(dead.select("record_id").distinct(), "record_id", "left_anti")


def tombstone_delta(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Deletions (record_id) that child adds to parent."""
    return child.select("record_id").distinct().join(parent, "record_id", "left_anti")


def superset_violations(child: DataFrame, parent: DataFrame, row_base: int) -> DataFrame:
    """Deletions of the parent that the child has lost, and own ones at or beyond its row base."""
    lost = parent.select("record_id").distinct().join(child, "record_id", "left_anti").withColumn("reason", F.lit("lost"))
    beyond = child.where(F.col("record_id") >= row_base).select("record_id").distinct().withColumn("reason", F.lit("beyond"))
    return lost.union(beyond)


def successors(edges: DataFrame) -> DataFrame:
    """(old_id, immediate, successors, current, hops, cyclic): where each superseded id leads.

    immediate is the edge of the least depth, successors are all by depth. The walk to
    the current id takes the edge of the greatest depth of every id, by pointer
    doubling, so log2(MAX_HOPS) joins reach MAX_HOPS hops; what still moves then runs in
    a circle and has no current id.
    """
    by = F.struct("depth", "new_id")
    listed = F.transform(F.array_sort(F.collect_set(by)), lambda x: x["new_id"])  # at most an edge for each layer
    step = edges.groupBy("old_id").agg(F.max_by("new_id", by).alias("new_id"), F.min_by("new_id", by).alias("immediate"), listed.alias("successors"))
    views = step.select("old_id", "immediate", "successors")
    walk = step.select("old_id", F.col("new_id").alias("at"), F.lit(1).cast("long").alias("hops"))
    for _ in range(MAX_HOPS.bit_length() - 1):
        ahead = walk.select(F.col("old_id").alias("at"), F.col("at").alias("next"), F.col("hops").alias("more"))
        walk = walk.join(ahead, "at", "left").select("old_id", F.coalesce("next", "at").alias("at"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))
    ends = walk.join(step.select(F.col("old_id").alias("at"), F.lit(True).alias("_on")), "at", "left")
    cyclic = F.col("_on").isNotNull()
    return ends.join(views, "old_id").select("old_id", "immediate", "successors", F.when(~cyclic, F.col("at")).alias("current"), F.when(~cyclic, F.col("hops")).alias("hops"), cyclic.alias("cyclic"))


def record_status(records: DataFrame, layers: DataFrame, tombstones: DataFrame, edges: DataFrame) -> DataFrame:
    """(record_id, depth, tombstoned, superseded_by, successors, current_successor)."""
    dead = tombstones.groupBy("record_id").agg(F.lit(True).alias("_dead"))
    after = successors(edges).select(F.col("old_id").alias("record_id"), F.col("immediate").alias("superseded_by"), "successors", F.col("current").alias("current_successor"))
    out = owners(records.select("record_id"), layers).join(dead, "record_id", "left").join(after, "record_id", "left")
    return out.select("record_id", "depth", F.coalesce("_dead", F.lit(False)).alias("tombstoned"), "superseded_by", "successors", "current_successor")


def compaction_ids(records: DataFrame, tombstones: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(record_id, new_id): dense ids of live records in the order of their ids.

    Ids fall into blocks; ranks within a block and the counts of the blocks before it
    make the new ids, so no task sorts all records.
    """
    own = live(records.select("record_id"), tombstones).withColumn("_block", F.floor(F.col("record_id") / block))
    counts = own.groupBy("_block").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each block
    base = counts.select("_block", before.alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_block").orderBy("record_id"))
    return own.withColumn("_rank", rank).join(base, "_block").select("record_id", (F.col("_base") + F.col("_rank") - 1).cast("long").alias("new_id"))


def citations(cited: DataFrame, layers: DataFrame, tombstones: DataFrame) -> DataFrame:
    """cited (identity, record_id) with status: unknown-history, out-of-range, deleted or valid."""
    heads = F.broadcast(intervals(layers).select("identity", "depth", "row_end"))
    dead = tombstones.groupBy("record_id").agg(F.lit(True).alias("_dead"))
    status = F.when(F.col("row_end").isNull(), "unknown-history").when((F.col("record_id") < 0) | (F.col("record_id") >= F.col("row_end")), "out-of-range").when(F.col("_dead"), "deleted").otherwise("valid")
    return cited.join(heads, "identity", "left").join(dead, "record_id", "left").select("identity", "record_id", status.alias("status"))


def translated(cited: DataFrame, ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Citations (record_id) across a compaction: new_id directly, else that of the current successor; reason live, superseded or deleted."""
    after = successors(edges).select(F.col("old_id").alias("record_id"), "current")
    direct = ids.select("record_id", "new_id")
    later = ids.select(F.col("record_id").alias("current"), F.col("new_id").alias("_later"))
    out = cited.join(direct, "record_id", "left").join(after, "record_id", "left").join(later, "current", "left")
    reason = F.when(F.col("new_id").isNotNull(), "live").when(F.col("_later").isNotNull(), "superseded").otherwise("deleted")
    return out.select("record_id", F.coalesce("new_id", "_later").alias("new_id"), reason.alias("reason"))


def drift(layers: DataFrame, tombstones: DataFrame, limit: float = DRIFT_LIMIT) -> DataFrame:
    """(depth, drift, status): the records appended up to each layer and those deleted in its mask, over the base's.

    A layer's mask holds every id that it or a layer below has deleted, each once,
    whether the table repeats the deletions of the layers below or not.
    """
    gone = tombstones.groupBy("record_id").agg(F.min("depth").alias("depth")).groupBy("depth").agg(F.count("*").alias("_gone"))
    order = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    own = layers.join(F.broadcast(gone), "depth", "left").withColumn("_added", F.when(F.col("depth") > 0, F.col("n_records")).otherwise(0))
    base = F.first("n_records").over(order)
    out = own.withColumn("drift", (F.sum("_added").over(order) + F.sum(F.coalesce("_gone", F.lit(0))).over(order)) / base)
    return out.select("depth", F.round("drift", 6).alias("drift"), F.when(F.col("drift") > limit, "drift-exceeded").otherwise("inherited").alias("status"))


def calibration_status(drifts: DataFrame, envelope: float | None = None, reader_limit: float = DRIFT_LIMIT, base_has_fit: bool = True, blooms: DataFrame | None = None) -> DataFrame:
    """(depth, drift, effective_limit, status): none without a fit, else inherited up to the stricter of the producer's and the reader's limit and while every layer ships a bloom, else drift-exceeded.

    blooms (depth): the layers with records that ship one; not given: all do.
    """
    limit = min(envelope, reader_limit) if envelope is not None and envelope == envelope else reader_limit
    if not limit < float("inf"):
        raise ValueError("the reader's limit is finite")
    order = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)  # at most MAX_DEPTH + 1 rows
    out = drifts.withColumn("_ships", F.lit(True)) if blooms is None else drifts.join(blooms.select("depth", F.lit(True).alias("_b")).distinct(), "depth", "left").withColumn("_ships", F.col("_b").isNotNull() | (F.col("depth") == 0))
    good = (F.col("drift") <= limit) & F.min("_ships").over(order)
    status = F.when(good, "inherited").otherwise("drift-exceeded") if base_has_fit else F.lit("none")
    return out.select("depth", "drift", F.lit(float(limit)).alias("effective_limit"), status.alias("status"))


def violations(layers: DataFrame, tombstones: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, n) of broken rules: gaps in depth, parents that don't match, deletions beyond the rows of their time, edges beyond their layer, several edges of an id in a layer."""
    spans = intervals(layers)
    order = Window.orderBy("depth")
    chain = spans.withColumn("_d", F.lag("depth").over(order)).withColumn("_p", F.lag("identity").over(order))
    ends = F.broadcast(spans.select("depth", "row_base", "row_end"))
    found = [
        ("depth-gap", chain.where(F.col("_d").isNotNull() & (F.col("depth") != F.col("_d") + 1))),
        ("parent-mismatch", chain.where(F.col("_p").isNotNull() & ~F.col("parent").eqNullSafe(F.col("_p")))),
        ("tombstone-beyond", tombstones.join(ends, "depth").where(F.col("record_id") >= F.col("row_base"))),
        ("edge-beyond", edges.join(ends, "depth").where(~F.col("new_id").between(F.col("row_base"), F.col("row_end") - 1))),
        ("edge-twice", edges.groupBy("depth", "old_id").count().where("count > 1")),
    ]
    out = None
    for rule, rows in found:
        one = rows.agg(F.lit(rule).alias("rule"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


def fork_depth(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row (fork_depth): the last depth up to which two histories (depth, identity) agree, -1 for none."""
    both = old.select("depth", F.col("identity").alias("_a")).join(new.select("depth", F.col("identity").alias("_b")), "depth", "full")
    broken = F.min(F.when(~F.col("_a").eqNullSafe(F.col("_b")), F.col("depth")))
    return both.agg((F.coalesce(broken, F.max("depth") + 1) - 1).cast("long").alias("fork_depth"))


def rebase_plan(delta: DataFrame, head_tombstones: DataFrame, fork_base: int) -> DataFrame:
    """(record_id, action) of a layer's deletions on another head: foreign beyond the fork, conflict if the head has deleted it too, else keep."""
    dead = head_tombstones.groupBy("record_id").agg(F.lit(True).alias("_dead"))
    action = F.when(F.col("record_id") >= fork_base, "foreign").when(F.col("_dead"), "conflict").otherwise("keep")
    return delta.select("record_id").distinct().join(dead, "record_id", "left").select("record_id", action.alias("action"))


def latest_notes(notes: DataFrame, tombstones: DataFrame, kind: str | None = None, tag: str | None = None, limit: int = 10) -> DataFrame:
    """The newest notes (record_id, kind, tags, ...) that are live, of a kind and with a tag."""
    keep: Column = F.lit(True)
    if kind is not None:
        keep = keep & (F.col("kind") == kind)
    if tag is not None:
        keep = keep & F.array_contains("tags", tag.lower())
    return live(notes.where(keep), tombstones).orderBy(F.desc("record_id")).limit(limit)


def append(path: str, records: DataFrame, depth: int, tombstones: DataFrame | None = None, edges: DataFrame | None = None) -> None:
    """Write a layer's tables as the partition depth=n of path/records, path/tombstones and path/supersessions."""
    if depth > PRODUCER_DEPTH:
        raise ValueError(f"a chain has at most {PRODUCER_DEPTH} layers; compact it first")
    for name, df in (("records", records), ("tombstones", tombstones), ("supersessions", edges)):
        if df is not None:
            df.drop("depth").write.mode("overwrite").parquet(f"{path}/{name}/depth={depth}")
