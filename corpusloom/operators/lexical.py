"""The inverted index and BM25 over it.

Rows: a null or empty text has no tokens and length 0 but counts as a record;
ties go to the smaller id; without rows or query tokens nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.tables import written

K1, B = 1.2, 0.75
#: Candidates of a query, and the share of its best score that the others need.
CANDIDATES, CUTOFF = 24, 1 / 1.5
#: Query terms that are broadcast at most; beyond, they are joined by shuffle.
BROADCAST_TERMS = 200_000
#: Texts that are counted before their counts leave a task.
TEXTS = 500
#: Bits of a bloom that are broadcast at most.
BROADCAST_BITS = 500_000


def token_lists(records: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(record_id, tokens, dl)."""
    tokens = fx.index_tokens(F.col(text_col))
    return records.select(F.col(id_col).alias("record_id"), tokens.alias("tokens")).withColumn("dl", F.size("tokens").cast("long"))


def postings(records: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, record_id, tf)."""
    terms = token_lists(records, id_col, text_col).select("record_id", F.explode("tokens").alias("term"))
    return terms.groupBy("term", "record_id").agg(F.count("*").alias("tf"))


def corpus_stats(records: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: n_records, n_tokens, avgdl (1 at least)."""
    own = token_lists(records, id_col, text_col)
    return _with_mean(own.agg(F.count("*").alias("n_records"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("n_tokens")))


def _with_mean(sums: DataFrame) -> DataFrame:
    return sums.withColumn("avgdl", F.greatest(F.lit(1.0), F.coalesce(F.col("n_tokens") / F.nullif(F.col("n_records"), F.lit(0)), F.lit(1.0))))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, term), each term once for a query."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(fx.query_tokens(F.col(text_col))).alias("term"))


def term_counts(records: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: frozenset[str] | None = None) -> DataFrame:
    """(record_id, dl, term, tf): the counts of a record's index tokens, of those in keep if given, and 1 for an empty term.

    Lower-case texts are cut as bytes: other bytes than those of tokens become blanks.
    """
    own = records.select(F.col(id_col).alias("record_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary").alias("text"))
    blanks = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789'" else 32 for c in range(256))
    # 0: other words, 1: words that are no index tokens, from 2 on: words that leave the task
    fixed = dict.fromkeys([w.encode() for w in fx.STOPWORDS] + [bytes([c]) for c in set(blanks) - {32}], 1)
    fixed |= {w: n for n, w in enumerate(sorted(w.encode() for w in keep or () if w.encode() not in fixed), 2)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([b"", b"", *list(fixed)[sum(n == 1 for n in fixed.values()) :]], pa.binary()).cast(pa.string())
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.slice(at, TEXTS)
                lists = [text.translate(blanks).split() for text in part.column(1).to_pylist()]
                lists = [[w for w in words if len(w) <= 32] if max(map(len, words), default=0) > 32 else words for words in lists]
                place, terms = fixed, names
                if keep is None:
                    more = sorted({w for words in lists for w in words if w not in fixed})
                    place, terms = fixed | {w: n for n, w in enumerate(more, 2)}, pa.array([b"", b"", *more], pa.binary()).cast(pa.string())
                sizes = np.array([len(words) for words in lists], np.int64)
                kinds = np.fromiter(map(place.get, chain.from_iterable(lists), repeat(0)), np.int64, int(sizes.sum()))
                who = np.repeat(np.arange(len(lists)), sizes)
                length = sizes - np.bincount(who[kinds == 1], minlength=len(lists))
                held, tf = np.unique((who * len(terms) + kinds)[kinds > 1], return_counts=True)
                who, kinds = np.concatenate([np.arange(len(lists)), held // len(terms)]), np.concatenate([np.zeros(len(lists), np.int64), held % len(terms)])
                columns = [part.column(0).take(pa.array(who)), pa.array(length[who]), terms.take(pa.array(kinds)), pa.array(np.concatenate([np.ones(len(lists), np.int64), tf]))]
                yield pa.RecordBatch.from_arrays(columns, names=["record_id", "dl", "term", "tf"])

    return own.mapInArrow(run, f"record_id {own.schema['record_id'].dataType.simpleString()}, dl long, term string, tf long")


def bm25(records: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", exclude: DataFrame | None = None) -> DataFrame:
    """(query_id, record_id, score) of every record that has a query's term.

    Texts are tokenized once: only the terms of queries, and an empty term for each
    record, leave the scan and are written as a table that gives frequencies, statistics
    and hits. Hits are dealt by record before they meet the queries, so no pair of a
    query and a record is shuffled. exclude (record_id) masks hits; statistics count
    masked records too.
    """
    terms = query_terms(queries, query_id, query_text)
    distinct = terms.select("term").distinct()
    few = distinct.limit(BROADCAST_TERMS + 1).collect()
    if len(few) <= BROADCAST_TERMS:
        found = term_counts(records, id_col, text_col, frozenset(r["term"] for r in few))
    else:
        found = term_counts(records, id_col, text_col).join(distinct.union(terms.sparkSession.createDataFrame([("",)], "term string")), "term")
    every = written(found.groupBy("record_id", "dl", "term").agg(F.sum("tf").alias("tf")))
    counted = every.where("term <> ''")
    df = counted.groupBy("term").agg(F.count("*").alias("df"))
    own = every.where("term = ''")
    stats = _with_mean(own.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_records"), F.coalesce(F.sum(F.col("tf") * F.col("dl")), F.lit(0)).cast("long").alias("n_tokens")))
    idf = F.log(1 + (F.col("n_records") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = written(terms.join(df, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", "avgdl", idf.alias("idf")))
    small = weighted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    hits = counted if exclude is None else counted.join(exclude.select("record_id").distinct(), "record_id", "left_anti")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    both = hits.repartition("record_id").join(F.broadcast(weighted), "term") if small else hits.join(weighted, "term")
    return both.groupBy("query_id", "record_id").agg(F.sum(part).alias("score"))


def topk(scored: DataFrame, k: int = CANDIDATES, cutoff: float | None = None) -> DataFrame:
    """The best k of each query by (score descending, id), with lexical_rank from 1; cutoff: the least share of the best score."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "record_id")
    out = scored.withColumn("lexical_rank", F.row_number().over(order).cast("long")).where(F.col("lexical_rank") <= k)
    if cutoff is not None:
        best = F.max("score").over(Window.partitionBy("query_id"))
        out = out.withColumn("_best", best).where(F.col("score") >= F.col("_best") * cutoff).drop("_best")
    return out


def bloom_bits(words: DataFrame, bits: int) -> DataFrame:
    """(bit): the set bits of a bloom filter over words (word), two hashes each."""
    two = F.array(*(F.pmod(fx.fnv1a(F.col("word"), s), F.lit(bits)) for s in fx.SEEDS))
    return words.select(F.explode(two).alias("bit")).distinct()


def vocabulary(records: DataFrame, text_col: str = "text", floor: int | None = None) -> DataFrame:
    """(word, n) of all words found floor times (3 from 200 records on, else 1)."""
    floor = floor or (3 if records.limit(200).count() >= 200 else 1)
    return records.select(F.explode(fx.raw_tokens(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= floor)


def bloom_size(kept: int, low: int = 14, high: int = 21) -> int:
    """Bits: the power of two from 32 a word, between 2**low and 2**high."""
    return 1 << min(high, max(low, (32 * max(kept, 1) - 1).bit_length()))


def layer_blooms(records: DataFrame, bits: int, depth_col: str = "depth", text_col: str = "text", floor: int = 1) -> DataFrame:
    """(depth, bit): each layer's bloom at the geometry of the base, over its words found floor times."""
    words = records.select(F.col(depth_col).alias("depth"), F.explode(fx.raw_tokens(F.col(text_col))).alias("word")).groupBy("depth", "word").agg(F.count("*").alias("n")).where(F.col("n") >= floor)
    two = F.array(*(F.pmod(fx.fnv1a(F.col("word"), s), F.lit(bits)) for s in fx.SEEDS))
    return words.select("depth", F.explode(two).alias("bit")).distinct()


def union_bloom(blooms: DataFrame) -> DataFrame:
    """(bit, n_layers): the bits of a chain's bloom, set where any layer's is."""
    return blooms.groupBy("bit").agg(F.count_distinct("depth").alias("n_layers"))


def known_fraction(queries: DataFrame, bits: DataFrame, n_bits: int, id_col: str, text_col: str) -> DataFrame:
    """(query_id, known_frac): share of a query's tokens, repeats included, whose bits are all set; bits has n_bits rows at most."""
    tokens = queries.select(F.col(id_col).alias("query_id"), F.explode(fx.raw_tokens(F.col(text_col))).alias("word"))
    hashed = tokens.select("query_id", *(F.pmod(fx.fnv1a(F.col("word"), s), F.lit(n_bits)).alias(f"bit{k}") for k, s in enumerate(fx.SEEDS)))
    bits = written(bits.select("bit"))  # 2**21 rows at most
    small = bits.count() <= BROADCAST_BITS
    for k in (0, 1):
        side = bits.select(F.col("bit").alias(f"bit{k}"), F.lit(1).alias(f"set{k}"))
        hashed = hashed.join(F.broadcast(side) if small else side, f"bit{k}", "left")
    return hashed.groupBy("query_id").agg(F.avg(F.when(F.col("set0").isNotNull() & F.col("set1").isNotNull(), 1.0).otherwise(0.0)).alias("known_frac"))


def common_words(records: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, df) of words of 3 letters and more that stand in more than 5 % of records (and in more than 4), the stop words of coverage left out."""
    words = records.select(F.explode(F.array_distinct(fx.raw_tokens(F.col(text_col)))).alias("word")).where((F.length("word") >= 3) & ~F.col("word").isin(fx.COVERAGE_STOPWORDS))
    n = records.agg(F.greatest(F.lit(4.0), F.floor(F.count("*") * 0.05 + 0.5)).alias("_least"))
    return words.groupBy("word").agg(F.count("*").alias("df")).join(F.broadcast(n), F.col("df") > F.col("_least")).select("word", "df")


def entities(records: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, df) in lower case: words of 3 letters and more that stand with a capital and never without one, no stop words and no Roman numerals, in at most max(2, 40 %) records."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    word = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z'])[A-Za-z']{3,}"), F.lit(0))
    seen = records.select(F.explode(F.array_distinct(word)).alias("w")).select(F.lower("w").alias("entity"), F.col("w").rlike("^[A-Z]").alias("_capital"))
    # forms of a word in one record differ in case alone
    limit = records.agg(F.greatest(F.lit(2.0), F.ceil(F.count("*") * 0.4)).alias("_most"))
    small = seen.where(~F.col("_capital")).select("entity").distinct()
    one = F.array_distinct(F.transform(F.filter(word, lambda w: w.rlike("^[A-Z]")), lambda w: F.lower(w)))
    counted = records.select(F.explode(one).alias("entity")).where(~F.col("entity").isin(fx.PROBE_STOPWORDS) & ~F.col("entity").rlike("^[ivxlcdm]+$")).groupBy("entity").agg(F.count("*").alias("df"))
    return counted.join(small, "entity", "left_anti").join(F.broadcast(limit), F.col("df") <= F.col("_most")).select("entity", "df")
