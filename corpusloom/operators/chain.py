"""Work on a chain of layers: search over live rows, hydration, compaction and rebase with data, walks, notes, shelves.

Tables as in layers. A search masks deleted records before every cut; statistics count
them. Rows: null ids own no layer and are left out; repeated edges and deletions count
once; without layers there is no result; ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import layers, ranking

#: Columns of a hit that a record's own columns never replace.
RESERVED = ("query_id", "row_id", "layer", "distance", "vec_rank", "lexical_rank", "fused_rank")
# Kinds of notes and the limits of their parts.
NOTE_KINDS = ["handoff", "decision", "dead-end", "measurement", "summary", "todo", "preference"]
TITLE_CHARS, TEXT_BYTES, MOST_TAGS, TAG_CHARS = 200, 16 * 1024, 20, 40


def search(records: DataFrame, chain: DataFrame, tombstones: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, mode: str = "hybrid", head: int | None = None) -> DataFrame:
    """The best k live rows of each query with the layer that owns each: every layer gives its nearest rows, they are merged by distance and fused once, without a pin.

    records (doc_id, text), vectors (row_id, ...), ids over the whole chain; head: the
    deletions up to this layer count.
    """
    dead = (tombstones if head is None else tombstones.where(F.col("depth") <= head)).select(F.col("record_id").alias("row_id")).distinct()
    tiers = layers.owners(vectors.select("row_id"), chain, "row_id").select("row_id", "depth")
    found = ranking.search(records, vectors, queries, k, mode, exclude=dead, tiers=tiers, pin=False)
    return found.join(tiers.withColumnRenamed("depth", "layer"), "row_id").select(*RESERVED)


def best_rows(hits: DataFrame, owner: DataFrame) -> DataFrame:
    """(query_id, record_id, row_id, distance, record_rank): of hits (query_id, row_id, distance) the nearest row of each record; owner (row_id, record_id)."""
    own = hits.join(owner.select("row_id", "record_id"), "row_id").groupBy("query_id", "record_id").agg(F.min(F.struct("distance", "row_id")).alias("_b"))
    out = own.select("query_id", "record_id", F.col("_b.row_id").alias("row_id"), F.col("_b.distance").alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "record_id")
    return out.withColumn("record_rank", F.row_number().over(order).cast("long"))


def hydrated(hits: DataFrame, records: DataFrame, id_col: str = "doc_id", key: str = "row_id") -> DataFrame:
    """hits with the columns of their records; a hit's own columns win over a record's of the same name."""
    taken = {c.lower() for c in (*hits.columns, *RESERVED)}
    own = [c for c in records.columns if c.lower() not in taken and c != id_col]
    return hits.join(records.select(F.col(id_col).alias("_corpusloom_id"), *own), F.col(key) == F.col("_corpusloom_id")).drop("_corpusloom_id")


def public(hits: DataFrame, pack: str, identity: str) -> DataFrame:
    """The columns that leave the engine, in their order: pack, pack_identity, id, title, heading_path, anchor, source, distance, text, and layer, tombstoned, superseded_by and current_successor where there are such."""
    has = lambda *names: next((F.col(n) for n in names if n in hits.columns), None)
    either = lambda *names: F.coalesce(*(F.col(n) for n in names if n in hits.columns), F.lit(None).cast("string"))
    path = has("heading_path")
    out: list[Column] = [
        F.lit(pack).alias("pack"), F.lit(identity).alias("pack_identity"), has("row_id", "record_id", "doc_id").alias("id"), either("title").alias("title"),
        (F.coalesce(path, F.array().cast("array<string>")) if path is not None else F.array().cast("array<string>")).alias("heading_path"),
        either("anchor").alias("anchor"), either("url", "source_path").alias("source"), (has("distance") if "distance" in hits.columns else F.lit(None).cast("double")).alias("distance"), either("text", "preview").alias("text"),
    ]
    return hits.select(*out, *(c for c in ("layer", "tombstoned", "superseded_by", "current_successor") if c in hits.columns))


def compacted(records: DataFrame, tombstones: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The live records under dense new ids (record_id, old_id, their columns), and the lineage (record_id, new_id, reason) of every old id."""
    ids = layers.compaction_ids(records, tombstones)
    rest = [c for c in records.columns if c not in ("record_id", "old_id", "new_id", "depth")]
    live = records.join(ids, "record_id").select(F.col("new_id").alias("record_id"), F.col("record_id").alias("old_id"), *rest)
    return live, layers.translated(records.select("record_id"), ids, edges)


def rebase(
    deletions: DataFrame, parent_deletions: DataFrame, edges: DataFrame, old_base: int, n_records: int, new_base: int, head_deletions: DataFrame, head_edges: DataFrame, fork_base: int, on_foreign: str = "refuse", on_conflict: str = "refuse"
) -> DataFrame:
    """(kind, old_id, new_id, action): a layer's deletions beyond its parent's and its edges, replayed on another head.

    Ids that the layer owns move with it; ids that it refers to hold below the fork
    alone. Deletions are `set`, `no-op` where the head has them, or `drop`; edges are
    `record`, `skip` or `keep-both` where the head names another successor, or `drop`.
    Foreign ids and conflicts are refused (ValueError) unless the modes allow them.
    """
    if on_foreign not in ("refuse", "drop") or on_conflict not in ("refuse", "skip", "keep-both"):
        raise ValueError("on_foreign is refuse or drop, on_conflict is refuse, skip or keep-both")
    delta = layers.tombstone_delta(deletions, parent_deletions).where(F.col("record_id") < old_base)
    moved = edges.select("old_id", (F.col("new_id") - old_base + new_base).alias("new_id")).distinct()
    latest = head_edges.groupBy("old_id").agg(F.max_by("new_id", F.struct("depth", "new_id")).alias("_head"))
    dead = head_deletions.select(F.col("record_id").alias("old_id"), F.lit(True).alias("_dead")).distinct()
    foreign = F.col("old_id") >= fork_base
    first = delta.select(F.lit("deletion").alias("kind"), F.col("record_id").alias("old_id"), F.lit(None).cast("long").alias("new_id")).join(dead, "old_id", "left")
    first = first.select("kind", "old_id", "new_id", F.when(foreign, "drop").when(F.col("_dead"), "no-op").otherwise("set").alias("action"))
    other = F.col("_head").isNotNull() & (F.col("_head") != F.col("new_id"))
    second = moved.join(latest, "old_id", "left").select(F.lit("edge").alias("kind"), "old_id", "new_id", F.when(foreign, "drop").when(other, on_conflict).otherwise("record").alias("action"))
    plan = first.union(second)
    counts = plan.agg(F.count_if(F.col("action") == "drop").alias("foreign"), F.count_if(F.col("action") == "refuse").alias("conflict"), F.count_if(F.col("action").isin("record", "keep-both") & ~F.col("new_id").between(new_base, new_base + n_records - 1)).alias("outside")).first()
    if counts["foreign"] and on_foreign == "refuse":
        raise ValueError(f"{counts['foreign']} ids at or above the fork name other records in the two histories")
    if counts["outside"]:
        raise ValueError(f"{counts['outside']} edges lead out of the layer's own range")
    if counts["conflict"]:
        raise ValueError(f"the head names another successor for {counts['conflict']} ids")
    return plan


def emits(plan: DataFrame, head_deletions: DataFrame, n_records: int) -> bool:
    """Whether a rebased layer changes anything: it owns records, or deletes what the head has not."""
    gone = plan.where(F.col("action").isin("set", "record", "keep-both")).select(F.col("old_id").alias("record_id")).distinct()
    return n_records > 0 or not gone.join(head_deletions, "record_id", "left_anti").isEmpty()


def citable_since(ids: DataFrame, chain: DataFrame) -> DataFrame:
    """(record_id, since): the least depth whose head could cite each id; ids beyond the chain go."""
    ends = F.broadcast(layers.intervals(chain).select("depth", "row_end"))  # at most MAX_DEPTH + 1 rows
    return ids.join(ends, (F.col("record_id") >= 0) & (F.col("record_id") < F.col("row_end"))).groupBy("record_id").agg(F.min("depth").alias("since"))


def walk_to_base(chain: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, hop, identity, depth): the layers from each head (identity) down through their parents, MAX_DEPTH hops at most; a parent that is missing ends the walk."""
    way = chain.select(F.col("identity").alias("head"), F.lit(0).cast("long").alias("hop"), "identity")
    jump, span = chain.where("parent is not null").select("identity", F.col("parent").alias("_to")), 1
    while span <= layers.MAX_DEPTH:
        further = way.join(jump, "identity").select("head", (F.col("hop") + span).alias("hop"), F.col("_to").alias("identity"))
        way = way.union(further)
        jump = jump.join(jump.select(F.col("identity").alias("_to"), F.col("_to").alias("_next")), "_to").select("identity", F.col("_next").alias("_to"))
        span *= 2
    out = way.where(F.col("hop") <= layers.MAX_DEPTH).join(heads.select(F.col("identity").alias("head")).distinct(), "head")
    return out.join(chain.select("identity", "depth"), "identity").select("head", "hop", "identity", "depth").distinct()


def supersede_targets(asked: DataFrame, records: DataFrame) -> DataFrame:
    """(path, old_id, new_id, n, status): the new record (record_id, path) that replaces old_id; a path must name exactly one, else it is missing or ambiguous."""
    named = records.groupBy("path").agg(F.count("*").alias("n"), F.min("record_id").alias("_id"))
    out = asked.join(named, "path", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return out.select("path", "old_id", F.when(F.col("n") == 1, F.col("_id")).alias("new_id"), "n", status.alias("status"))


def shaped_notes(notes: DataFrame) -> DataFrame:
    """notes (kind, title, text, tags, ...) with reason (null: sound), title and text trimmed and tags in lower case, each once."""
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    title, text = trimmed(F.col("title")), F.col("text")
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    blank = lambda c: c.isNull() | (trimmed(c) == "")
    reason = (
        F.when(F.col("kind").isNull() | ~F.col("kind").isin(NOTE_KINDS), "kind")
        .when(blank(F.col("title")) | (F.length(F.col("title")) > TITLE_CHARS) | title.contains("\n"), "title")
        .when(blank(text) | (F.octet_length(text) > TEXT_BYTES), "text")
        .when((F.size(tags) > MOST_TAGS) | F.exists(tags, lambda t: blank(t) | (F.length(t) > TAG_CHARS)), "tags")
    )
    out = notes.withColumn("reason", reason)
    return out.withColumns({"title": title, "text": trimmed(text), "tags": F.array_distinct(F.transform(tags, lambda t: F.lower(trimmed(t))))})


def shelf(spark: SparkSession, packs: dict[str, str]) -> DataFrame:
    """(pack, path, status, reason, records, depth) of the packs by name; one that can't be read is reported and the others still serve."""
    rows = []
    for name, path in sorted(packs.items()):
        try:
            one = spark.read.parquet(f"{path}/records")
            depth = F.max("depth") if "depth" in one.columns else F.lit(0)
            n, deep = one.agg(F.count("*"), depth).first()
            rows.append((name, path, "mounted", None, n, int(deep or 0)))
        except Exception as e:  # noqa: BLE001
            rows.append((name, path, "failed", str(e).splitlines()[0][:200], None, None))
    return spark.createDataFrame(rows, "pack string, path string, status string, reason string, records long, depth int")
