"""Exports of chats: lists of messages, and trees of messages of which one branch counts.

Input is a table (path, value) with the text of each file. Rows: a file that is no
JSON array of such conversations gives none; null and empty texts, hidden messages,
messages to tools and other roles than user and assistant have no turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from .files import branch

LISTED = "array<struct<uuid:string,name:string,chat_messages:array<struct<sender:string,created_at:string,text:string,content:string>>>>"
MESSAGE = "struct<author:struct<role:string>,recipient:string,create_time:double,metadata:struct<is_visually_hidden_from_conversation:boolean>,content:struct<content_type:string,parts:string>>"
TREES = f"array<struct<id:string,conversation_id:string,title:string,current_node:string,mapping:map<string,struct<parent:string,message:{MESSAGE}>>>>"
TURN = ("conv_id", "turn", "role", "text", "date", "title")


def said(content: Column, text: Column) -> Column:
    """The text blocks of a message's content, else its flat text, without harness tags."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    kept = F.filter(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: fx.cleaned(b["text"])), lambda t: t != "")
    return F.when(F.size(blocks) > 0, F.array_join(kept, "\n\n")).otherwise(fx.cleaned(text))


def _titled(turns: DataFrame) -> DataFrame:
    """TURN with the title, else the first prompt's first line, else a fixed one."""
    first = turns.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("_p"))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(fx.short_title(F.col("_p")), F.lit("")), F.lit("Untitled conversation"))
    return turns.join(first, "conv_id", "left").withColumn("title", title).select(*TURN)


def listed_turns(files: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, date, title) of exports that list each conversation's messages."""
    chat = files.select(F.explode(F.from_json("value", LISTED)).alias("c")).where("c.chat_messages is not null")
    turns = chat.select(F.col("c.uuid").alias("conv_id"), F.col("c.name").alias("title"), F.posexplode("c.chat_messages").alias("turn", "m"))
    role = F.when(F.col("m.sender") == "human", "user").when(F.col("m.sender") == "assistant", "assistant")
    out = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), said(F.col("m.content"), F.col("m.text")).alias("text"), F.left("m.created_at", F.lit(10)).alias("date"), "title")
    return _titled(out.where("role is not null and text <> ''"))


def tree_turns(files: DataFrame) -> DataFrame:
    """The same of exports that hold each conversation as a tree: the branch that ends in its current node."""
    chat = files.select(F.explode(F.from_json("value", TREES)).alias("c")).where("c.mapping is not null")
    own = chat.select(F.coalesce("c.conversation_id", "c.id").alias("conv_id"), F.col("c.title").alias("title"), F.col("c.current_node").alias("node_id"), "c.mapping")
    nodes = own.select("conv_id", "title", F.explode("mapping").alias("node_id", "n")).select("conv_id", "title", "node_id", F.col("n.parent").alias("parent"), F.col("n.message").alias("m"))
    heads = own.select("conv_id", "node_id").join(nodes.select("conv_id", "node_id"), ["conv_id", "node_id"], "left_semi")
    way = branch(nodes.select("conv_id", "node_id", "parent"), heads)
    role = F.col("m.author.role")
    seen = role.isin("user", "assistant") & ~F.coalesce(F.col("m.metadata.is_visually_hidden_from_conversation"), F.lit(False))
    seen = seen & ~((role == "assistant") & (F.coalesce(F.col("m.recipient"), F.lit("all")) != "all")) & F.col("m.content.content_type").isin("text", "multimodal_text")
    texts = F.expr("transform(filter(from_json(m.content.parts, 'array<variant>'), x -> schema_of_variant(x) = 'STRING'), x -> cast(x as string))")
    turns = way.join(nodes, ["conv_id", "node_id"]).where(seen)
    date = F.date_format(F.timestamp_seconds("m.create_time"), "yyyy-MM-dd")
    out = turns.select("conv_id", "turn", role.alias("role"), fx.cleaned(F.array_join(texts, "\n\n")).alias("text"), date.alias("date"), "title")
    return _titled(out.where("text <> ''"))
