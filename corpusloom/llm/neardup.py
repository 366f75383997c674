"""Near-duplicate detection by BagMinHash.

A document is the multiset of its word 5-grams (letters and digits, lower case; a
text of fewer words is one shingle). Each shingle drives Poisson processes over its
weight, split hierarchically: one block for [0, 1), one for each [2**k, 2**(k+1)).
A point of a block has a time and a component of the signature, and in the last,
partly filled block counts only if it lies below the weight. A component keeps its
earliest point, so two signatures agree there with the probability of their
weighted Jaccard similarity. Points are drawn in order of time until no process can
still improve its document, for all documents of a block at once in numpy.

Bands of the signature are buckets. A bucket's members are compared with two leaders,
exactly, by the overlap of the multisets: its least member, and the one that meets
most others over all its buckets. Members of a bucket that these links leave in
different components are compared too, unless a bound rules them out. The bound is
that of prefix filters: shingles that occur in one component only cannot be shared
across components; the others are ordered from rare to common, and two multisets that
overlap enough have their first shared shingle where enough of either is still left.
So the classes are those of all pairs that share a bucket, and what is compared grows
with the alike and not with the square of a bucket. Equal multisets are one node from
the start, so copies cost nothing. Components of the links are the classes.

Rows: texts without a word (and null) are each a class of their own; a null id takes
part, the class id is the least id of its class that is not null; repeated rows
belong to one class; an empty table gives an empty table. A text is read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import U64, Words, blocks, map_rows, materialize, mix64, small_or_shuffled, windows
from ._components import components, leaders

SHINGLE, THRESHOLD = 5, 0.8
#: At similarity 0.8 a pair shares a bucket with probability 1 - (1 - 0.8**5)**24 = 0.99993, at 0.85 with 0.9999995.
BANDS, BAND_ROWS = 24, 5
_BLOCK = 300_000
#: Rows of the input for which a narrow table gets a file; members of buckets and prefixes, of which a row can have many, get more.
_FILE_ROWS, _MORE_FILES = 300_000, 3


def multisets(texts: list[str], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, shingle and count of each distinct shingle, by document and then shingle."""
    words = Words(texts)
    value, at = windows(words, n)
    doc = words.doc[at]
    count = np.bincount(words.doc, minlength=len(texts))
    for k in range(1, n):  # texts of k < n words
        v, first = windows(words, k)
        few = count[words.doc[first]] == k
        value, doc = np.concatenate((value, v[few])), np.concatenate((doc, words.doc[first[few]]))
    order = np.argsort(value)
    order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
    value, doc = value[order], doc[order]
    new = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])))) if len(value) else np.zeros(0, np.int64)
    return doc[new], value[new], np.diff(np.concatenate((new, [len(value)])))


def signatures(doc: np.ndarray, value: np.ndarray, count: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """n_docs x size identities of the earliest points (0 in documents without shingles)."""
    parts = [(doc, value, np.ones(len(doc)), np.zeros(len(doc)), count)]
    k = 0
    while (over := count > 2**k).any():  # block [2**k, 2**(k+1)) for weights beyond its start
        parts.append((doc[over], value[over] + U64(k + 1) * U64(0xA0761D6478BD642F), np.full(int(over.sum()), 2.0**k), np.full(int(over.sum()), 2.0**k), count[over]))
        k += 1
    who_doc, seed, rate, low, weight = (np.concatenate(x) for x in zip(*parts))
    seed = mix64(seed)
    time, latest = np.zeros(len(seed)), np.full(n_docs, np.inf)
    best, winner = np.full(n_docs * size, np.inf), np.zeros(n_docs * size, U64)
    step = 0
    while len(seed):
        step += 1
        u = mix64(seed + U64(step) * U64(0x9E3779B97F4A7C15))
        time = time - np.log(((u >> U64(11)).astype(np.float64) + 1) * 2.0**-53) / rate
        v = mix64(u + U64(0xE7037ED1A0B428DB))
        slot = who_doc * size + ((v >> U64(32)) % U64(size)).astype(np.int64)
        inside = low + (v & U64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate < weight
        hit = np.flatnonzero((inside | (low + rate <= weight)) & (time < best[slot]))
        at = slot[hit]
        np.minimum.at(best, at, time[hit])
        won = hit[best[at] == time[hit]]
        winner[slot[won]] = u[won]
        if len(won):
            moved = np.unique(who_doc[won])
            latest[moved] = best.reshape(n_docs, size)[moved].max(1)
        alive = time < latest[who_doc]
        who_doc, seed, rate, low, weight, time = (x[alive] for x in (who_doc, seed, rate, low, weight, time))
    return winner.reshape(n_docs, size)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band."""
    parts = signature.reshape(len(signature), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), parts.shape[:2]).copy()
    for k in range(rows):
        out = mix64(out * U64(0x9FB21C651E98DF25) + parts[:, :, k])
    return out


def nodes_of(doc: np.ndarray, value: np.ndarray, count: np.ndarray, n_docs: int) -> np.ndarray:
    """A 64-bit digest of each document's multiset."""
    edge = np.searchsorted(doc, np.arange(n_docs))
    term = mix64(value * U64(0xD1B54A32D192ED03) + count.astype(U64))
    total = np.concatenate((np.zeros(1, U64), np.cumsum(term, dtype=U64)))
    return mix64(total[np.concatenate((edge[1:], [len(doc)]))] - total[edge])


def _sketch(df: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """(_id, _text_hash, node, weight, bands) of every row; node is null for texts without a word."""
    source = df.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text_hash"), F.col(text_col).alias("_text"))
    schema = T.StructType([T.StructField("_id", df.schema[id_col].dataType), T.StructField("_text_hash", T.LongType()), T.StructField("node", T.LongType()), T.StructField("weight", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def make():
        @np.errstate(over="ignore")
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, keys, none, weight = [], [], [], []
            for _, texts in blocks(batch.column(2).to_pylist(), _BLOCK):
                d, v, c = multisets(texts)
                nodes.append(nodes_of(d, v, c, len(texts)))
                weight.append(np.bincount(d, c, len(texts)).astype(np.int64))
                none.append(weight[-1] == 0)
                keys.append(band_keys(signatures(d, v, c, len(texts), bands * rows), bands, rows))
            mask, flat = np.concatenate(none), np.concatenate(keys).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, bands, dtype=np.int32)), pa.array(flat.ravel()))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(nodes).view(np.int64), mask=mask), pa.array(np.concatenate(weight)), lists], names=schema.names)

        return step

    return map_rows(source, ["_id", "_text_hash", "_text"], make, schema)


def _shingles(df: DataFrame, text_col: str, wanted: DataFrame, rows: int) -> DataFrame:
    """(node, keys, counts) of the wanted (node, _text_hash): its shingles, and their counts where one is above 1 (else none)."""
    source = df.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text_hash"), F.col(text_col).alias("_text")).join(small_or_shuffled(wanted, rows), "_text_hash")
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])

    def make():
        sent: set[int] = set()

        @np.errstate(over="ignore")
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, keys, counts = [], [], []
            fresh = []
            for k, node in enumerate(batch.column(0).to_pylist()):
                if node not in sent:  # copies within a task go out once
                    if len(sent) > 200_000:
                        sent.clear()
                    sent.add(node)
                    fresh.append(k)
            node_of, all_texts = batch.column(0).to_numpy()[fresh] if fresh else [], batch.column(1).take(pa.array(fresh, pa.int64())).to_pylist()
            for first, texts in blocks(all_texts, _BLOCK):
                d, v, c = multisets(texts)
                own = nodes_of(d, v, c, len(texts)).view(np.int64)
                edge = np.searchsorted(d, np.arange(len(texts) + 1))
                for k in range(len(texts)):
                    if own[k] == node_of[first + k]:
                        part = c[edge[k] : edge[k + 1]]
                        nodes.append(int(own[k]))
                        keys.append(v[edge[k] : edge[k + 1]].view(np.int64))
                        counts.append(part.astype(np.int32) if (part > 1).any() else _NONE)
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))], names=schema.names)

        return step

    return map_rows(source, ["node", "_text"], make, schema).dropDuplicates(["node"])


_NONE = np.zeros(0, np.int32)


def weighted_jaccard(ka: np.ndarray, ca: np.ndarray, kb: np.ndarray, cb: np.ndarray) -> float:
    """Sum of least over sum of greatest counts of two sets of keys; no counts: all are 1."""
    if not len(ca) and not len(cb):
        both = int(np.isin(ka, kb, assume_unique=True, kind="sort").sum())
        return both / (len(ka) + len(kb) - both)
    ca, cb = (c if len(c) else np.ones(len(k), np.int32) for k, c in ((ka, ca), (kb, cb)))
    _, i, j = np.intersect1d(ka, kb, True, return_indices=True)
    both = int(np.minimum(ca[i], cb[j]).sum())
    return both / (int(ca.sum()) + int(cb.sum()) - both)


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of an Arrow column as views of one array."""
    edge = np.concatenate(([0], np.cumsum(pc.list_value_length(column).to_numpy())))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return [flat[i:j] for i, j in zip(edge[:-1].tolist(), edge[1:].tolist())]


def _verified(pairs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough."""
    left = shingles.select(F.col("node").alias("a"), F.col("keys").alias("ka"), F.col("counts").alias("ca"))
    right = shingles.select(F.col("node").alias("b"), F.col("keys").alias("kb"), F.col("counts").alias("cb"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            four = [_lists(batch.column(k)) for k in range(2, 6)]
            good = [k for k, one in enumerate(zip(*four)) if weighted_jaccard(*one) >= threshold]
            return pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(good, pa.int64())) for k in (0, 1)], names=["a", "b"])

        return step

    return map_rows(pairs.join(left, "a").join(right, "b"), ["a", "b", "ka", "ca", "kb", "cb"], make, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


#: Nodes with one shingle that one task compares with others.
_MEMBERS = 1024


def _apart(nodes: DataFrame, shingles: DataFrame, threshold: float, files: int = 0) -> DataFrame:
    """(a, b): all pairs of nodes (node, label, weight) with different labels whose overlap may be enough, by a prefix filter.

    Shingles of one label are left out, as pairs of two labels cannot share them. Of
    the others, from rare to common, `left` is the weight from one on: no more can be
    shared if it is the first shared one. So it bounds the partner's weight from above
    and the threshold bounds it from below; nodes meet by shingle and class of weight.
    Of each shingle, nodes of the largest label are not paired among themselves.
    """
    share = threshold / (1 + threshold)  # of both weights, that the overlap must reach
    element = F.explode(F.arrays_zip("keys", "counts"))
    tokens = nodes.join(shingles, "node").select("node", "label", "weight", element.alias("_x")).select("node", "label", "weight", F.col("_x.keys").alias("token"), F.coalesce("_x.counts", F.lit(1)).alias("_c"))
    tokens = materialize(tokens)
    common = tokens.groupBy("token").agg(F.count("*").alias("_df"), F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo <> _hi").select("token", "_df")
    onward = Window.partitionBy("node").orderBy(F.desc("_df"), "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefix = tokens.join(common, "token").withColumn("left", F.sum("_c").over(onward)).where(F.col("left") >= threshold * F.col("weight") - 1e-6).select("token", "node", "label", "weight", "left")
    prefix = materialize(prefix, _MORE_FILES * files)
    sizes = prefix.groupBy("token", "label").agg(F.count("*").alias("_n"))
    most = sizes.groupBy("token").agg(F.max(F.struct("_n", "label")).alias("_most"), F.count("*").alias("_labels"), F.ceil(F.sum("_n") / _MEMBERS).alias("_blocks")).where("_labels > 1")
    dealt = prefix.join(most, "token").withColumn("_minor", F.col("label") != F.col("_most.label"))
    size_class = lambda w: F.floor(F.log(w) * 20)
    lightest, heaviest = F.ceil(threshold * F.col("weight") - 1e-6), F.floor(F.col("left") / share - F.col("weight") + 1e-6)
    left = dealt.where("_minor").withColumn("_from", lightest).withColumn("_to", heaviest).where("_from <= _to")
    left = left.select("token", F.explode(F.sequence(size_class("_from"), size_class("_to"))).alias("_class"), F.col("node").alias("a"), F.col("weight").alias("_wa"), F.col("label").alias("_la"), F.col("left").alias("_lefta"), "_blocks")
    left = left.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")
    right = dealt.select("token", F.pmod(F.xxhash64("node"), "_blocks").alias("_block"), size_class("weight").alias("_class"), F.col("node").alias("b"), F.col("weight").alias("_wb"), F.col("label").alias("_lb"), F.col("left").alias("_leftb"), "_minor")
    met = left.join(right, ["token", "_block", "_class"]).where("_la <> _lb and (not _minor or a < b)").where(F.least("_lefta", "_leftb") >= share * (F.col("_wa") + F.col("_wb")) - 1e-6)
    return met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.lit(1).alias("_one")).drop("_one")


def _classes(df: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, rows: int) -> tuple[DataFrame, int]:
    """(_id, _text_hash, class) of every row, and how many files a narrow table gets; class is null for texts without a word, else a node of it."""
    sketch = materialize(_sketch(df, id_col, text_col, bands, rows))
    files = max(1, -(-sketch.count() // _FILE_ROWS))
    member = sketch.where("node is not null").select("node", "weight", F.explode("bands").alias("key"))
    shared = materialize(member.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key"), files)
    member = materialize(member.join(small_or_shuffled(shared, shared.count()), "key").groupBy("key", "node").agg(F.first("weight").alias("weight")), _MORE_FILES * files)
    labels = None
    if not member.isEmpty():
        first = materialize(leaders(member).select("key", F.col("leader.node").alias("to"), F.col("leader.weight").alias("to_weight")), files)
        met = member.join(small_or_shuffled(first, first.count()), "key").where("node <> to")
        # the smaller multiset's weight over the larger's bounds their similarity
        met = met.where(F.least("weight", "to_weight") >= threshold * F.greatest("weight", "to_weight"))
        pairs = materialize(met.groupBy(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).agg(F.lit(1).alias("_one")).drop("_one"), files)
        nodes = materialize(member.groupBy("node").agg(F.lit(1).alias("_one")).drop("_one"), files)
        wanted = materialize(sketch.join(small_or_shuffled(nodes, nodes.count()), "node").groupBy("node").agg(F.min("_text_hash").alias("_text_hash")), files)
        shingles = materialize(_shingles(df, text_col, wanted, wanted.count()))
        edges = materialize(_verified(pairs, shingles, threshold), files)
        labels = components(edges, files)
        # what the leaders left apart
        named = member.join(small_or_shuffled(labels, labels.count()), "node", "left").withColumn("label", F.coalesce("label", "node"))
        split = materialize(named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key"), files)
        if not split.isEmpty():
            apart = materialize(named.join(small_or_shuffled(split, split.count()), "key").groupBy("node").agg(F.first("label").alias("label"), F.first("weight").alias("weight")), files)
            more = materialize(_apart(apart, shingles, threshold, files).join(pairs, ["a", "b"], "left_anti"), files)
            found = materialize(_verified(more, shingles, threshold), files)
            if not found.isEmpty():
                labels = components(edges.union(found), files)
    if labels is None:
        out = sketch.select("_id", "_text_hash", F.col("node").alias("class"))
    else:
        out = sketch.select("_id", "_text_hash", "node").join(small_or_shuffled(labels, labels.count()), "node", "left").select("_id", "_text_hash", F.coalesce("label", "node").alias("class"))
    return materialize(out, files), files


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """Each row's id, class_id (least id of the class) and class_size."""
    own, files = _classes(df, id_col, text_col, threshold, bands, rows)
    many = materialize(own.where("class is not null").groupBy("class").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1"), files)
    out = own.join(small_or_shuffled(many, many.count()), "class", "left")
    return out.select(F.col("_id").alias(id_col), F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_first")).alias("class_id"), F.coalesce("_n", F.lit(1)).alias("class_size"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """The rows and columns of df with one row of each class: that of the least id (nulls last), of repeated rows one."""
    own, files = _classes(df, id_col, text_col, threshold, bands, rows)
    own = own.where("class is not null")
    order = F.struct(F.col("_id").isNull().alias("_null"), "_id", "_text_hash")
    many = materialize(own.groupBy("class").agg(F.min(order).alias("_best"), F.count("*").alias("_n")).where("_n > 1"), files)
    if many.isEmpty():
        return df
    n = many.count()
    grouped = own.join(small_or_shuffled(many, n), "class")
    first = F.col("_id").eqNullSafe(F.col("_best._id")) & (F.col("_text_hash") == F.col("_best._text_hash"))
    dropped = materialize(grouped.where(~first).select("_id", "_text_hash").distinct(), files)
    twice = materialize(grouped.where(first).groupBy("_id", "_text_hash").count().where("count > 1").select("_id", "_text_hash"), files)
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    match = lambda other: F.col(id_col).eqNullSafe(other["_id"]) & (text_hash == other["_text_hash"])
    other = small_or_shuffled(dropped, dropped.count())
    kept = df.join(other, match(other), "left_anti")
    if twice.isEmpty():
        return kept
    other = small_or_shuffled(twice, twice.count())
    # of rows that share id and text one stays; only these are shuffled
    again = kept.join(other, match(other), "left_semi").withColumn("_corpusloom_hash", text_hash).dropDuplicates([id_col, "_corpusloom_hash"]).drop("_corpusloom_hash")
    return kept.join(other, match(other), "left_anti").unionByName(again)
