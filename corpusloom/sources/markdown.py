"""Markdown and MDX: sections with heading paths and anchors, chunks of sections, plain text.

Rows: a null or empty text has no sections; headings inside fences are text.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-{2,})[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_OWN = re.compile(r"[ \t]*\{#([^}\s]+)\}[ \t]*$")
#: Inline markup and what of it stays.
INLINE = [(re.compile(r"!\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"`([^`]*)`"), r"\1"), (re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1"), r"\2"), (re.compile(r"(?<!\w)([*_])(?=\S)(.+?)(?<=\S)\1(?!\w)"), r"\2"), (re.compile(r"</?[A-Za-z][^>]*>"), "")]
_MDX = re.compile(r"^(import|export)\s.*$|^\s*</?[A-Z][^>]*/?>\s*$")
TARGET, LEAST, WHOLE = 256, 25, 1.6
SECTION = T.ArrayType(T.StructType([T.StructField("heading_path", T.ArrayType(T.StringType())), T.StructField("anchor", T.StringType()), T.StructField("text", T.StringType())]))


class Slugs:
    """Anchors of one document; repeats get -1, -2 and so on."""

    def __init__(self):
        self.seen: dict[str, int] = {}

    def of(self, heading: str) -> str:
        base = "".join(c for c in heading.strip().lower() if c in "-_ " or unicodedata.category(c)[0] in "LNM").replace(" ", "-")
        out = base
        while out in self.seen:
            self.seen[base] += 1
            out = f"{base}-{self.seen[base]}"
        self.seen[out] = 0
        return out


def plain(text: str) -> str:
    """Without inline markup."""
    for pattern, stays in INLINE:
        text = pattern.sub(stays, text)
    return text


def read(text: str | None, mdx: bool = False) -> list[dict]:
    """Sections in order; what stands before the first heading has an empty path and anchor. A first heading of level 1 titles the page and is in no path."""
    lines = (text or "").split("\n")
    if lines and lines[0].strip() == "---" and "---" in (rest := [x.strip() for x in lines[1:]]):
        lines = lines[rest.index("---") + 2 :]
    slugs, out, path, anchor, body, fence, first = Slugs(), [], [], "", [], None, True

    def close():
        joined = plain("\n".join(body)).strip()
        if joined:
            out.append({"heading_path": [h for _, h in path], "anchor": anchor, "text": joined})
        body.clear()

    def head(level: int, name: str):
        nonlocal anchor, path, first
        close()
        own = _OWN.search(name)
        name = plain(_OWN.sub("", name)).strip()
        anchor = own[1] if own else slugs.of(name)
        path = [p for p in path if p[0] < level] + ([] if first and level == 1 else [(level, name)])
        if first and level == 1:
            anchor = ""
        first = False

    for line in lines:
        mark = _FENCE.match(line)
        if fence:
            body.append(line)
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
                fence = None
        elif mark:
            fence = mark[1]
            body.append(line)
        elif mdx and _MDX.match(line):
            continue
        elif m := _ATX.match(line):
            head(len(m[1]), m[2])
        elif body and body[-1].strip() and (m := _SETEXT.match(line)):
            name = body.pop()
            head(1 if m[1][0] == "=" else 2, name)
        else:
            body.append(line)
    close()
    return out


def sections(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mdx: bool = False) -> DataFrame:
    """(id, position, heading_path, anchor, text) of every section."""

    @F.pandas_udf(SECTION)
    def parsed(texts: pd.Series) -> pd.Series:
        return pd.Series([read(t, mdx) for t in texts])

    return df.select(F.col(id_col), F.posexplode(parsed(F.col(text_col))).alias("position", "_s")).select(id_col, "position", "_s.*")


def chunks_of(found: list[dict], target: int = TARGET, least: int = LEAST) -> list[dict]:
    """Chunks of a document's sections: whole up to WHOLE targets, else cut at paragraphs; short ones join the next and take the path they share."""
    out: list[dict] = []
    for s in found:
        words = len(s["text"].split())
        parts = [s["text"]]
        if words > WHOLE * target:
            parts, held, size = [], [], 0
            for p in re.split(r"\n\s*\n", s["text"]):
                n = len(p.split())
                if held and size + n > target:
                    parts.append("\n\n".join(held))
                    held, size = [], 0
                held.append(p)
                size += n
            parts.append("\n\n".join(held))
        for p in parts:
            own = {"heading_path": list(s["heading_path"]), "anchor": s["anchor"], "text": p}
            if out and min(len(p.split()), len(out[-1]["text"].split())) < least:
                last = out[-1]
                shared = [a for a, b in zip(last["heading_path"], own["heading_path"]) if a == b][: next((k for k, (a, b) in enumerate(zip(last["heading_path"], own["heading_path"])) if a != b), None)]
                if shared != last["heading_path"]:
                    last["anchor"] = ""
                last["heading_path"] = shared
                last["text"] += "\n\n" + p
            else:
                out.append(own)
    return out


def chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET, least: int = LEAST) -> DataFrame:
    """(id, position, heading_path, anchor, text) of every chunk; a row's document alone decides, so nothing is shuffled."""

    @F.pandas_udf(SECTION)
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([chunks_of(read(t), target, least) for t in texts])

    return df.select(F.col(id_col), F.posexplode(cut(F.col(text_col))).alias("position", "_s")).select(id_col, "position", "_s.*")
