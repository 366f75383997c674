"""Chunks of texts: flat token windows, sentence windows, exact dedupe, digests, embedding of words.

Rows: a null or blank text has no window; repeated ids give windows each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx

TARGET, OVERLAP, LEAST = 256, 15, 25


def flat_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(id, window, start, n_tokens, text): windows of target tokens, each overlap % into the last; texts of fewer than `least` tokens have none."""
    step = target - target * overlap // 100
    words = F.split(F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[ \t\n\x0B\f\r]+", " ")), " ")
    own = df.select(F.col(id_col), words.alias("_w")).where(F.size("_w") >= least)
    last = F.greatest(F.lit(0), F.ceil((F.size("_w") - target) / step)).cast("int")
    # the windows are cut before they are exploded, so that no row carries a whole text's words
    part = lambda i: F.slice("_w", i * step + 1, target)
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.cast("long").alias("window"), (i * step).cast("long").alias("start"), F.size(part(i)).cast("long").alias("n_tokens"), F.array_join(part(i), " ").alias("text")))
    return own.select(id_col, F.inline(cut))


def sentence_windows(df: DataFrame, n: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, window, text): every run of n sentences in a row (1 to 8); a shorter text is one window."""
    if not 1 <= n <= 8:
        raise ValueError("n is 1 to 8")
    own = df.select(F.col(id_col), fx.sentences(F.col(text_col)).alias("_s")).where(F.size("_s") > 0)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_s") - n)), lambda i: F.array_join(F.slice("_s", i + 1, n), " "))
    return own.select(id_col, F.posexplode(runs).alias("window", "text")).withColumn("window", F.col("window").cast("long"))


def exact_dedupe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_copies): the least id of each distinct text."""
    return df.groupBy(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("_digest")).agg(F.min(id_col).alias(id_col), F.count("*").alias("n_copies")).drop("_digest")


def row_map(windows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_rows): index rows of each record."""
    return windows.groupBy(id_col).agg(F.count("*").alias("n_rows"))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", page: int = 64) -> tuple[DataFrame, DataFrame]:
    """(id, page, digest) of every record, and (page, n_records, digest) of pages of `page` ids: the digest of their digests in order."""
    own = df.select(F.col(id_col), F.floor(F.col(id_col) / page).alias("page"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("i"), F.col("digest").alias("d")))), lambda x: x["d"]), "")  # at most the records of a page
    return own, own.groupBy("page").agg(F.count("*").alias("n_records"), F.sha2(joined, 256).alias("digest"))


def sampled(df: DataFrame, most: int, id_col: str) -> DataFrame:
    """`most` rows evenly spaced over the order of ids (all, if there are fewer)."""
    n = df.count()
    if n <= most:
        return df
    from .layers import compaction_ids

    none = df.select(F.col(id_col).alias("record_id")).limit(0)
    ranks = compaction_ids(df.select(F.col(id_col).alias("record_id")), none)
    wanted = [(i * n) // most for i in range(most)]
    return df.join(F.broadcast(ranks.where(F.col("new_id").isin(wanted)).select(F.col("record_id").alias(id_col))), id_col)


def exchanges(turns: DataFrame) -> DataFrame:
    """(conv_id, exchange, n_exchanges, user, assistant): a prompt, in parts or whole, and the replies to it.

    turns (conv_id, turn, role, text). System turns and blank texts are skipped, replies
    before any prompt and prompts without a reply are dropped.
    """
    own = turns.where(F.col("role") != "system").withColumn("_text", fx.cleaned(F.col("text"))).where("_text <> ''").withColumn("_user", F.col("role") == "user")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "_text")
    starts = own.withColumn("_new", (F.col("_user") & ~F.coalesce(F.lag("_user").over(order), F.lit(False))).cast("int"))
    grouped = starts.withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_group > 0")
    side = lambda user: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_user") == user, F.struct("turn", "_text")))), lambda x: x["_text"]), "\n\n")
    whole = grouped.groupBy("conv_id", "_group").agg(side(True).alias("user"), side(False).alias("assistant")).where("assistant <> ''")
    by = Window.partitionBy("conv_id")
    return whole.select("conv_id", F.row_number().over(by.orderBy("_group")).cast("long").alias("exchange"), F.count("*").over(by).alias("n_exchanges"), "user", "assistant")


def exchange_records(found: DataFrame) -> DataFrame:
    """(conv_id, exchange, title, text): exchanges as records, with secrets replaced and a line on where they stand."""
    text = F.concat(F.lit("User: "), "user", F.lit("\n\nAssistant: "), "assistant", F.lit("\n\nExchange "), F.col("exchange").cast("string"), F.lit(" of "), F.col("n_exchanges").cast("string"))
    return found.select("conv_id", "exchange", fx.short_title(F.col("user")).alias("title"), fx.redacted(text)[0].alias("text"))
