"""Web pages: title, text, sections and links.

Rows: a null or empty page has no title (null), empty text, no sections and no
links; broken markup is read as far as it goes.
"""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .markdown import Slugs

SKIPPED = {"script", "style", "nav", "footer", "noscript", "template", "svg"}
BLOCKS = {"p", "div", "li", "ul", "ol", "br", "tr", "table", "section", "article", "pre", "blockquote", "main", "header"}
VOID = {"br", "img", "meta", "link", "input", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}
SECTION = T.StructType([T.StructField("heading_path", T.ArrayType(T.StringType())), T.StructField("anchor", T.StringType()), T.StructField("text", T.StringType())])
PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("sections", T.ArrayType(SECTION))])


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.sections, self.slugs = None, [], Slugs()
        self.path: list[tuple[int, str]] = []
        self.anchor, self.parts, self.heading, self.skip, self.in_title = "", [], None, [], False

    def close_section(self):
        text = "\n".join(x for line in "".join(self.parts).split("\n") if (x := " ".join(line.split())))
        if text:
            self.sections.append({"heading_path": [h for _, h in self.path], "anchor": self.anchor, "text": text})
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.append(tag)
            return
        if tag in SKIPPED:
            self.skip.append(tag)
        elif tag == "title" and self.title is None:
            self.in_title = True
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.close_section()
            self.heading = (int(tag[1]), dict(attrs).get("id"), [])
        elif tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if tag == "title":
            self.in_title = False
        elif self.heading and tag == f"h{self.heading[0]}":
            level, own, parts = self.heading
            name = " ".join("".join(parts).split())
            self.path = [*(p for p in self.path if p[0] < level), (level, name)]
            self.anchor, self.heading = own or self.slugs.of(name), None
        elif tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.skip:
            return
        if self.in_title:
            self.title = " ".join(((self.title or "") + data).split())
        elif self.heading:
            self.heading[2].append(data)
        else:
            self.parts.append(data)


def read_page(html: str | None) -> dict:
    reader = _Reader()
    if html:
        reader.feed(html)
        reader.close()
        reader.close_section()
    return {"title": reader.title, "sections": reader.sections}


def sections(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title, position, heading_path, anchor, text) of every section of every page."""

    @F.pandas_udf(PAGE)
    def read(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_page(x) for x in html], columns=["title", "sections"])

    own = pages.select(F.col(id_col), read(F.col(html_col)).alias("_p"))
    return own.select(id_col, F.col("_p.title").alias("title"), F.posexplode("_p.sections").alias("position", "_s")).select(id_col, "title", "position", "_s.*")


def title_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title, text) by patterns alone: without scripts, styles, navigation, footers, comments and tags; white space collapsed."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    body = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    for tag in ("script", "style", "nav", "footer", "title"):
        body = F.regexp_replace(body, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"[ \t\n\r\f\x0B]+", " "))
    title = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return pages.select(F.col(id_col), F.nullif(title, F.lit("")).alias("title"), text.alias("text"))


def hrefs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, href) of every anchor as written, quoted or not, each once for a page."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    found = F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\s\"'>]+)"), F.lit(1))
    return pages.select(F.col(id_col), F.explode(F.array_distinct(found)).alias("href"))


def links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, link): absolute links of the page's own origin, without fragments."""

    @F.pandas_udf(T.StringType())
    def absolute(base: pd.Series, href: pd.Series) -> pd.Series:
        def one(b, h):
            try:
                out = urldefrag(urljoin(b or "", h))[0]
                return out if urlsplit(out)[:2] == urlsplit(b or "")[:2] and urlsplit(out).scheme in ("http", "https") else None
            except ValueError:
                return None

        return pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)

    found = hrefs(pages, id_col, html_col).join(pages.select(F.col(id_col), F.col(url_col).alias("_base")), id_col)
    return found.select(id_col, absolute("_base", "href").alias("link")).where("link is not null").distinct()


def crawl(pages: DataFrame, seed: str, most: int = 500, include: str = "*", exclude: str | None = None) -> DataFrame:
    """(url, hop) of the pages (page_id, url, html) reached from seed over same-origin links, nearest first, `most` at most (the crawl's page limit)."""
    like = lambda g: "^" + "".join(".*" if c == "*" else "\\" + c if c in ".^$+?()[]{}|\\" else c for c in g) + "$"
    path = F.coalesce(F.expr("try_parse_url(url, 'PATH')"), F.lit("/"))
    good = path.rlike(like(include)) & ~path.endswith("/print.html")
    if exclude:
        good = good & ~path.rlike(like(exclude))
    known = pages.where(good).withColumn("url", F.substring_index("url", "#", 1))
    edges = links(known).join(known.select("page_id", "url"), "page_id").select("url", "link").distinct().cache()
    reached = known.where(F.col("url") == seed).select("url").distinct().withColumn("hop", F.lit(0))
    hop, before = 0, 0
    while before < (n := reached.count()) < most:
        before, hop = n, hop + 1
        ahead = edges.join(reached.where(F.col("hop") == hop - 1), "url").select(F.col("link").alias("url")).distinct()
        fresh = ahead.join(known.select("url").distinct(), "url", "left_semi").join(reached, "url", "left_anti").withColumn("hop", F.lit(hop))
        reached = reached.union(fresh).checkpoint() if known.sparkSession.sparkContext.getCheckpointDir() else reached.union(fresh)
    return reached.orderBy("hop", "url").limit(most)
