"""Rows that every operator has to stand."""

from pyspark.sql import types as T

PROSE = "the quick brown fox jumps over the lazy dog while seven small birds sing near an old stone bridge by the river"
LONG = " ".join(f"word{k % 997} and {k}" for k in range(60_000))

#: doc_id, text: nulls, blanks, ties, repeated rows, a very long text and characters of all kinds.
ROWS = [
    (1, PROSE),
    (1, PROSE),
    (2, PROSE + " indeed"),
    (3, None),
    (None, PROSE),
    (None, None),
    (4, ""),
    (5, " \n\t "),
    (6, "12 34 !! ??"),
    (7, LONG),
    (7, "another text with the same id as the long one"),
    (8, "naïve café \U0001f600 \U0001f469‍\U0001f4bb ﬁne Ångström 中文 текст \x00 ﻿ <|endoftext|> x"),
    (9, "a" * 5000),
    (10, "\n".join(["same line here again"] * 30)),
    (11, "x"),
]
#: Columns whose names the operators use inside, with nulls.
CLASH = ["_id", "_text", "_text_hash", "_n", "_row", "_runs", "_digest", "node", "class", "key", "count", "piece", "length", "_rank", "_part", "_label", "lang_pred", "score", "a", "b", "_doc", "kept", "spans"]


def frame(spark, rows=None, clash=True):
    extra = CLASH if clash else []
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in extra]
    )
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", None, None if t is None else len(t), *[None if k % 2 else "x"] * len(extra)) for k, (i, t) in enumerate(rows)], schema)


def ids(df, column="doc_id"):
    return sorted((r[column] is None, r[column] or 0) for r in df.select(column).collect())


def want_ids(rows=None):
    return sorted((i is None, i or 0) for i, _ in (ROWS if rows is None else rows))
