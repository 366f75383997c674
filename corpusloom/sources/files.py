"""Files: folders of documents, raw vectors, Git logs, session transcripts and branches of conversations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.tables import written

MOST_BYTES, MOST_FILES = 16 << 20, 40
PATTERN = "*.{md,mdx,html,txt}"


def folder(spark: SparkSession, root: str, pattern: str = PATTERN, most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(path, text) of the files below root, and (path, reason) of those left out as too large."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    large = F.col("length") > most
    return files.where(~large).select("path", F.decode("content", "UTF-8").alias("text")), files.where(large).select("path", F.lit("too large").alias("reason"))


def routed(path: Column, base: str, prefix: str = "", anchor: Column | None = None) -> Column:
    """The address of a source file: base, prefix, path without index.html or suffix, and the anchor."""
    page = F.regexp_replace(F.regexp_replace(path, r"(^|/)index\.html$", "$1"), r"\.(html|mdx?|txt)$", "")
    url = F.concat(F.lit(base.rstrip("/") + "/" + prefix.strip("/") + ("/" if prefix.strip("/") else "")), page)
    return url if anchor is None else F.when(F.coalesce(anchor, F.lit("")) == "", url).otherwise(F.concat(url, F.lit("#"), anchor))


def vectors_f32(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """(path, row, vector) of raw little-endian 32-bit float files; a file of another size than whole rows fails."""
    import numpy as np

    @F.pandas_udf("array<array<float>>")
    def read(content: pd.Series) -> pd.Series:
        def one(data: bytes):
            if len(data) % (4 * dims):
                raise ValueError(f"{len(data)} bytes are no whole rows of {dims} floats")
            return np.frombuffer(data, "<f4").reshape(-1, dims).tolist()

        return pd.Series([one(c) for c in content])

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.posexplode(read("content")).alias("row", "vector"))


def vectors_json(spark: SparkSession, path: str, vector_key: str = "vector", id_key: str = "id") -> DataFrame:
    """(id, vector) of JSON lines."""
    rows = spark.read.json(path)
    return rows.select((F.col(id_key) if id_key in rows.columns else F.lit(None)).alias("id"), F.col(vector_key).cast("array<float>").alias("vector"))


def git_log(lines: DataFrame, remote: str = "", most: int = MOST_FILES) -> DataFrame:
    """Commits (sha, date, author, subject, body, files, url, text) of log (log STRING).

    Records are parted by 0x1e, fields by 0x1f: sha, ISO date, author, subject, body,
    files (a line each; the first `most` are named). Credentials in the remote are
    dropped; only a github.com remote gives addresses.
    """
    import re

    m = re.search(r"github\.com[:/]([\w.-]+)/([\w.-]+?)(?:\.git)?/?$", remote)
    parts = lines.select(F.explode(F.split("log", "\x1e")).alias("_r")).where("trim(_r) <> ''").select(F.split("_r", "\x1f").alias("_f")).where(F.size("_f") >= 5)
    at = lambda k: F.trim(F.coalesce(F.get("_f", F.lit(k)), F.lit("")))
    files = F.filter(F.split(at(5), "\n"), lambda x: F.trim(x) != "")
    out = parts.select(at(0).alias("sha"), at(1).alias("date"), at(2).alias("author"), at(3).alias("subject"), at(4).alias("body"), F.slice(files, 1, most).alias("files"), F.size(files).alias("n_files"))
    url = F.concat(F.lit(f"https://github.com/{m[1]}/{m[2]}/commit/"), "sha") if m else F.lit(None).cast("string")
    named = F.concat(F.array_join("files", "\n"), F.when(F.col("n_files") > most, F.concat(F.lit("\n… and "), (F.col("n_files") - most).cast("string"), F.lit(" more"))).otherwise(""))
    return out.withColumn("url", url).withColumn("text", F.concat_ws("\n\n", "subject", F.nullif("body", F.lit("")), F.nullif(named, F.lit("")))).orderBy("date", "sha")


SESSION = "type string, sessionId string, timestamp string, isMeta boolean, isSidechain boolean, isCompactSummary boolean, isApiErrorMessage boolean, summary string, customTitle string, message struct<role:string,content:string>"


def session_turns(lines: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, date, title) of transcript lines (path, line number n, value).

    Torn lines, side chains, meta, compaction and API-error events, interruptions and
    results of tools are dropped; the title is a custom one, a summary or the first prompt.
    """
    event = lines.select("path", "n", F.from_json("value", SESSION).alias("e")).select("path", "n", "e.*").where("type is not null")
    blocks = F.from_json(F.col("message.content"), "array<struct<type:string,text:string>>")
    said = F.when(F.col("message.content").startswith("["), F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: fx.cleaned(b["text"])), "\n\n")).otherwise(fx.cleaned(F.col("message.content")))
    flags = F.lit(False)
    for name in ("isMeta", "isSidechain", "isCompactSummary", "isApiErrorMessage"):
        flags = flags | F.coalesce(F.col(name), F.lit(False))
    turns = event.where(F.col("type").isin("user", "assistant") & ~flags).withColumn("text", said).where("text <> '' and text not like '[Request interrupted%'")
    own = event.groupBy("path").agg(F.max("customTitle").alias("_c"), F.max("summary").alias("_s"))
    first = turns.where("type = 'user'").groupBy("path").agg(F.min_by("text", "n").alias("_p"))
    titled = turns.join(own, "path").join(first, "path", "left")
    return titled.select(F.col("path").alias("conv_id"), F.col("n").alias("turn"), F.col("type").alias("role"), "text", F.left("timestamp", F.lit(10)).alias("date"), F.coalesce("_c", "_s", fx.short_title(F.col("_p"))).alias("title"))


def branch(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """(conv_id, turn, node_id) of the way from each head (conv_id, node_id) up to its root, the root first.

    nodes (conv_id, node_id, parent); ancestors are found by pointer doubling, until a
    round meets no further node. A way that comes back to a node ends before it.
    """
    keys = ["conv_id", "node_id"]
    found = written(heads.select(*keys, F.lit(0).cast("long").alias("_up")))
    jump, span = written(nodes.select(*keys, "parent").where("parent is not null")), 1
    while True:
        up = found.join(jump, keys).select("conv_id", F.col("parent").alias("node_id"), (F.col("_up") + span).alias("_up"))
        fresh = written(up.join(found, keys, "left_anti").groupBy(*keys).agg(F.min("_up").alias("_up")))
        if fresh.isEmpty():
            break
        found = found.union(fresh)
        twice = jump.select("conv_id", F.col("node_id").alias("parent"), F.col("parent").alias("_next"))
        jump, span = written(jump.join(twice, ["conv_id", "parent"]).select(*keys, F.col("_next").alias("parent"))), span * 2
    return found.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("_up"))).cast("long").alias("turn"), "node_id")
