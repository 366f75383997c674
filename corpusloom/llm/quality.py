"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths (numpy, over all words of a block of
texts at once) mark the words that lie inside an n-gram found twice or more in
its text; the share of characters in marked words, and of characters in repeated
lines, decide. Words are runs without ASCII white space.

Rows: a null or empty text has no words, fails the base rules and is not kept;
repeated rows get the same result each; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import U64, Words, blocks, map_rows, mix64, windows

SYMBOLS = "#*$%&|<>"
#: Largest share of word characters inside n-grams found twice or more, by n.
COVERAGE = {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}
#: Largest share of characters inside repeated lines.
LINES = 0.30
MIN_WORDS, BASE_WINDOW, BASE_PERCENT = 10, 5, 20
_BLANK = " \t\n\v\f\r"


def repeated(words: Words, n: int) -> np.ndarray:
    """For each word, whether it lies in a window of n words that its text has twice or more."""
    value, at = windows(words, n)
    marked = np.zeros(len(words.start) + 1, np.int64)
    if len(value):
        key = value ^ mix64(words.doc[at].astype(U64) + U64(1))  # equal windows of two texts differ
        order = np.argsort(key)
        v = key[order]
        same = v[1:] == v[:-1]
        hit = at[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        np.add.at(marked, hit, 1)
        np.subtract.at(marked, hit + n, 1)
    return np.cumsum(marked)[:-1] > 0


def line_counts(text: str) -> tuple[int, int, int]:
    """Lines with a word that equal an earlier line, their characters, and the characters of all lines with a word."""
    seen, dup, dup_chars, chars = set(), 0, 0, 0
    for line in text.split("\n"):
        if line.strip(_BLANK):
            chars += len(line)
            if line in seen:
                dup += 1
                dup_chars += len(line)
            else:
                seen.add(line)
    return dup, dup_chars, chars


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base rules and the verdict for every text, with the coverage at each n and of lines."""
    names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_coverage", *(f"coverage_{n}" for n in COVERAGE)]
    kinds = [df.schema[id_col].dataType, *[T.LongType()] * 5, *[T.BooleanType()] * 2, *[T.DoubleType()] * (1 + len(COVERAGE))]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = []
            for _, texts in blocks(batch.column(1).to_pylist()):
                w = Words(texts, kind="space", lower=False)
                n_docs, size = len(texts), w.end - w.start
                per = lambda x: np.bincount(w.doc, x, n_docs)
                count, chars = np.bincount(w.doc, minlength=n_docs), per(size)
                marks = {n: repeated(w, n) for n in COVERAGE}
                hit = per(marks[BASE_WINDOW]).astype(np.int64)
                lines = np.array([line_counts(t) for t in texts], np.int64)
                symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
                cover = {n: per(size * m) / np.maximum(chars, 1) for n, m in marks.items()}
                line_cover = lines[:, 1] / np.maximum(lines[:, 2], 1)
                failed = (count < MIN_WORDS) | (100 * hit > BASE_PERCENT * count)
                kept = ~failed & (line_cover <= LINES)
                for n, most in COVERAGE.items():
                    kept &= cover[n] <= most
                parts.append([count, chars.astype(np.int64), symbols, lines[:, 0], hit, failed, kept, line_cover, *cover.values()])
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x)) for x in zip(*parts))], names=names)

        return step

    return map_rows(df, [id_col, text_col], make, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))
