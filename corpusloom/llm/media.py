"""Copies of images by local descriptors.

Grey images (binary PGM) get corners at two scales (Harris responses, greatest in
their neighbourhood), an orientation from the intensity centroid, and 128 binary
tests turned by it. Equal images are one node from the start. One corner's tests say
little where pictures are built of few patterns, so the Hamming tables are keyed by a
corner and its eight nearest of one scale: eight of the longest tests of each, another
eight in each of four tables, and the octants in which a neighbour stands and is
turned, seen from the corner. So descriptors that differ elsewhere meet, a copy shares
tens of keys with its original, and unlike pictures share one in thousands.

A bucket's leader is the member that meets most others over all its buckets. Each
image is confirmed against the greatest of its leaders, then against the others that
are still in another component, and last every two members of a bucket that these
links leave in different components. Buckets are counted and led by windows, and labels
are joined once an image, not once a key of it. Pairs are confirmed by geometry over all
descriptors: of the matched corners, enough must agree on one scale, rotation and shift.
Components of the confirmed links are the classes.

Rows: a null, broken or flat image (no corners) has only exact copies in its class;
null images are each a class of their own; a null id takes part; repeated rows belong
to one class; an empty table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import U64, map_rows, materialize, mix64, prepare, small_or_shuffled
from ._components import components, cross_pairs

#: Bits of difference in a match; agreeing matches.
BITS, AGREE = 12, 8
#: Neighbours of a corner in a key, tables, tests of a corner in each, classes of an angle.
NEIGHBOURS, TABLES, TESTS, ANGLES = 8, 4, 8, 8
#: Agreeing corners that unlike pictures of many corners may have by chance.
CHANCE = 6
#: Pairs that a task confirms at a time, at about.
_PAIRS = 4000
_MARGIN, _RADIUS = 6, 5
_rng = np.random.default_rng(20_240_601)
_PATTERN = np.clip(_rng.normal(0, 2.2, (128, 2, 2)), -4, 4)
#: The tests in the order of the distance of their two places, the longest (the surest) first.
_LONGEST = np.argsort(-np.hypot(*(_PATTERN[:, 0] - _PATTERN[:, 1]).T), kind="stable")
_SPACE = np.arange(-_RADIUS, _RADIUS + 1)


def read_pgm(data: bytes | None) -> np.ndarray | None:
    """Pixels of a binary PGM, or None if it isn't one."""
    m = re.match(rb"P5\s+(\d{1,5})\s+(\d{1,5})\s+255\s", data or b"")
    if not m or len(data) - m.end() != int(m[1]) * int(m[2]):
        return None
    return np.frombuffer(data, np.uint8, offset=m.end()).reshape(int(m[2]), int(m[1]))


def write_pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def _box(x: np.ndarray) -> np.ndarray:
    """Mean over 3 x 3 (edges repeated)."""
    p = np.pad(x, ((1, 1), (1, 1)), "edge")
    r = p[:-2] + p[1:-1] + p[2:]
    return (r[:, :-2] + r[:, 1:-1] + r[:, 2:]) / 9


def describe(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (x, y, scale, angle) in the image's own pixels and their 16-byte descriptors."""
    places, bits = [], []
    image, scale = pixels.astype(np.float32), 1.0
    for _ in range(2):
        h, w = image.shape
        if min(h, w) <= 2 * _MARGIN + 2:
            break
        soft = _box(image)
        gy, gx = np.gradient(soft)
        a, b, c = _box(gx * gx), _box(gy * gy), _box(gx * gy)
        response = a * b - c * c - 0.05 * (a + b) ** 2
        greatest = np.lib.stride_tricks.sliding_window_view(np.pad(response, 2, constant_values=-np.inf), (5, 5)).max((2, 3))
        good = (response == greatest) & (response > 1.0)
        good[:_MARGIN], good[-_MARGIN:], good[:, :_MARGIN], good[:, -_MARGIN:] = False, False, False, False
        y, x = np.nonzero(good)
        if len(x):
            patch = soft[y[:, None, None] + _SPACE[:, None], x[:, None, None] + _SPACE[None, :]]
            disc = (_SPACE[:, None] ** 2 + _SPACE[None, :] ** 2) <= _RADIUS**2
            angle = np.arctan2((patch * disc * _SPACE[:, None]).sum((1, 2)), (patch * disc * _SPACE[None, :]).sum((1, 2)))
            cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
            px = np.rint(x[:, None, None] + cos * _PATTERN[..., 0] - sin * _PATTERN[..., 1]).astype(int).clip(0, w - 1)
            py = np.rint(y[:, None, None] + sin * _PATTERN[..., 0] + cos * _PATTERN[..., 1]).astype(int).clip(0, h - 1)
            value = soft[py, px]
            bits.append(np.packbits(value[..., 0] < value[..., 1], axis=1))
            places.append(np.stack([x * scale, y * scale, np.full(len(x), scale), angle], 1))
        image = image[: h // 2 * 2, : w // 2 * 2].reshape(h // 2, 2, w // 2, 2).mean((1, 3))
        scale *= 2
    if not places:
        return np.zeros((0, 4), np.float32), np.zeros((0, 16), np.uint8)
    return np.concatenate(places).astype(np.float32), np.concatenate(bits)


def _octant(angle: np.ndarray) -> np.ndarray:
    return np.floor(angle / (2 * np.pi) * ANGLES).astype(np.int64) % ANGLES


@np.errstate(over="ignore")
def constellations(places: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The distinct keys of an image: of every corner with its nearest ones, in each table."""
    flags = np.unpackbits(bits, axis=1)[:, _LONGEST[: TABLES * TESTS]].reshape(len(bits), TABLES, TESTS)
    code = (flags << np.arange(TESTS, dtype=np.uint8)).sum(2).astype(np.int64)
    out = [np.zeros(0, U64)]
    for scale in np.unique(places[:, 2]):
        own = np.flatnonzero(places[:, 2] == scale)
        k = min(NEIGHBOURS, len(own) - 1)
        if k < AGREE - 1:
            continue
        x, y, turn = places[own, 0], places[own, 1], places[own, 3]
        dx, dy = x[None] - x[:, None], y[None] - y[:, None]
        apart = np.hypot(dx, dy)
        near = np.argsort(np.where(apart < 3 * scale, np.inf, apart), axis=1, kind="stable")[:, :k]
        row = np.arange(len(own))[:, None]
        seen = _octant(np.arctan2(dy, dx)[row, near] - turn[:, None]) * ANGLES + _octant(turn[near] - turn[:, None])
        for t in range(TABLES):
            rest = np.sort(seen * 256 + code[own[near], t], axis=1).astype(U64)
            key = mix64(code[own, t].astype(U64) + U64(256 * (t + 1)))
            for j in range(k):
                key = mix64(key * U64(0x9FB21C651E98DF25) + rest[:, j])
            out.append(key)
    return np.unique(np.concatenate(out))


def _fit(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: int = 1) -> tuple[int, int]:
    """Matched corners that agree on the best scale, rotation and shift, and the corners that each shows of the other's frame, the fewer; 0, 0 below least."""
    (pa_, da), (pb, db) = a, b
    if min(len(da), len(db)) < least:
        return 0, 0
    apart = np.bitwise_count(da.view(np.uint64)[:, None] ^ db.view(np.uint64)[None])
    apart = apart[..., 0] + apart[..., 1]
    j = apart.argmin(1)
    i = np.flatnonzero(apart[np.arange(len(da)), j] <= BITS)
    p, q = pa_[i].astype(np.float64), pb[j[i]].astype(np.float64)
    scale, turn = q[:, 2] / p[:, 2], q[:, 3] - p[:, 3]
    cos, sin = (scale * np.cos(turn))[:, None], (scale * np.sin(turn))[:, None]
    dx, dy = p[:, 0] - p[:, 0, None], p[:, 1] - p[:, 1, None]
    x = q[:, 0, None] + cos * dx - sin * dy - q[:, 0]
    y = q[:, 1, None] + sin * dx + cos * dy - q[:, 1]
    near = x * x + y * y <= 9 * np.maximum(1.0, scale[:, None]) ** 2
    best, at, most = least - 1, -1, near.sum(1)
    for k in np.argsort(-most, kind="stable"):
        if most[k] <= best:
            break
        n = len(np.unique(j[i][near[k]]))
        if n > best:
            best, at = n, k
    if at < 0:
        return 0, 0
    return best, min(_inside(pa_, pb, p[at], q[at], scale[at], turn[at]), _inside(pb, pa_, q[at], p[at], 1 / scale[at], -turn[at]))


def _inside(places: np.ndarray, others: np.ndarray, p: np.ndarray, q: np.ndarray, scale: float, turn: float) -> int:
    """How many places fall into the frame of the others if p is moved to q."""
    d = places[:, :2] - p[:2]
    x = q[0] + scale * (np.cos(turn) * d[:, 0] - np.sin(turn) * d[:, 1])
    y = q[1] + scale * (np.sin(turn) * d[:, 0] + np.cos(turn) * d[:, 1])
    low, high = others[:, :2].min(0) - 3, others[:, :2].max(0) + 3
    return int(((x >= low[0]) & (x <= high[0]) & (y >= low[1]) & (y <= high[1])).sum())


def agreeing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Matched corners that agree on the best scale, rotation and shift."""
    return _fit(a, b)[0]


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether enough corners agree: AGREE, and CHANCE more than a quarter of those that the common part shows."""
    found, shown = _fit(a, b, AGREE)
    return found >= AGREE and found >= CHANCE + shown / 4


def _features(df: DataFrame, image_col: str) -> DataFrame:
    """(_node, _places, _bits, _keys) of every distinct image: corners and descriptors packed, and the keys of its buckets."""
    schema = T.StructType([T.StructField("_node", T.LongType()), T.StructField("_places", T.BinaryType()), T.StructField("_bits", T.BinaryType()), T.StructField("_keys", T.ArrayType(T.LongType()))])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, places, bits, keys = [], [], [], []
            for node, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pixels = read_pgm(data)
                if pixels is not None and pixels.size:
                    p, d = describe(pixels)
                    if len(p):
                        nodes.append(node), places.append(p.tobytes()), bits.append(d.tobytes()), keys.append(constellations(p, d).view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(places, pa.binary()), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

        return step

    return map_rows(df, ["_node", image_col], make, schema)


def _confirmed(pairs: DataFrame, features: DataFrame, n: int) -> DataFrame:
    """The n pairs (a, b) whose geometry agrees.

    Nodes fall into parts, and the pairs of two parts are one group, to which each
    image comes once.
    """
    prepare(pairs.sparkSession)
    parts = int(np.ceil(np.sqrt(max(n, 1) / _PAIRS)))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    dealt = pairs.select("a", "b", (part("a") * parts + part("b")).alias("_group"))
    asked = dealt.select(F.col("_group").alias("_of"), F.explode(F.array("a", "b")).alias("_node")).distinct()
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def step(own: pa.Table, images: pa.Table) -> pa.Table:
        rows = zip(*(images[c].to_pylist() for c in ("_node", "_places", "_bits")))
        held = {node: (np.frombuffer(p, np.float32).reshape(-1, 4), np.frombuffer(d, np.uint8).reshape(-1, 16)) for node, p, d in rows}
        good = [k for k, (x, y) in enumerate(zip(own["a"].to_pylist(), own["b"].to_pylist())) if alike(held[x], held[y])]
        return own.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return dealt.groupBy("_group").cogroup(asked.join(features.drop("_keys"), "_node").groupBy("_of")).applyInArrow(step, schema)


def copies(df: DataFrame, id_col: str, image_col: str) -> DataFrame:
    """Each row's id, class_id (least id of its class) and class_size."""
    rows = materialize(df.select(F.col(id_col).alias("_id"), F.xxhash64(image_col).alias("_h"), F.col(image_col).isNull().alias("_none"), F.col(image_col).alias("_image")))
    rows = rows.withColumn("_node", F.when(~F.col("_none"), F.col("_h")))
    images = rows.where("_node is not null").groupBy("_node").agg(F.first("_image").alias("_image"))
    features = materialize(_features(images, "_image"))
    bucket = Window.partitionBy("key")
    member = features.select(F.col("_node").alias("node"), F.explode("_keys").alias("key")).withColumn("_size", F.count("*").over(bucket)).where("_size > 1")
    held = materialize(member.groupBy("node").agg(F.sum("_size").alias("met"), F.collect_list("key").alias("keys")))  # no more than an image's keys
    led = held.select("node", "met", F.explode("keys").alias("key")).withColumn("_leader", F.max(F.struct("met", "node")).over(bucket))
    led = materialize(led.where("node <> _leader.node").groupBy("node").agg(F.collect_set("_leader").alias("_leaders")))
    pair = (F.least("node", "_to").alias("a"), F.greatest("node", "_to").alias("b"))
    labels = asked = links = None
    for step in range(3):
        if step == 0:
            pairs = led.select("node", F.array_max("_leaders")["node"].alias("_to")).select(*pair).distinct()
        else:
            named = labels.select("node", "label")
            label = lambda c: F.coalesce(c, "node")
            if step == 1:
                of = led.join(named, "node", "left").select("node", label("label").alias("_own"), F.explode("_leaders.node").alias("_to"))
                of = of.join(named.withColumnRenamed("node", "_to"), "_to", "left").where(F.col("_own") != F.coalesce("label", "_to"))
                pairs = of.select(*pair).distinct()
            else:
                pairs = cross_pairs(materialize(held.join(named, "node", "left").select("node", label("label").alias("label"), F.explode("keys").alias("key"))))
            pairs = pairs.join(asked, ["a", "b"], "left_anti")
        pairs = materialize(pairs)
        found = materialize(_confirmed(pairs, features, pairs.count()))
        asked, links = (pairs, found) if step == 0 else (asked.union(pairs), links.union(found))
        if step == 0 or not found.isEmpty():
            labels = components(links)
    named = labels.withColumnRenamed("node", "_node")
    own = materialize(rows.drop("_image").join(small_or_shuffled(named, labels.count()), "_node", "left").select("_id", F.coalesce("label", "_node").alias("_class")))
    many = materialize(own.where("_class is not null").groupBy("_class").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1"))
    out = own.join(small_or_shuffled(many, many.count()), "_class", "left")
    return out.select(F.col("_id").alias(id_col), F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_first")).alias("class_id"), F.coalesce("_n", F.lit(1)).alias("class_size"))


def rendered(df: DataFrame, id_col: str, vector_col: str, side: int = 8, cell: int = 10) -> DataFrame:
    """(id, image): each vector of side * side numbers drawn as a grid of grey cells (PGM), so that tables of vectors have a media column. A vector of another length, or null, has no image."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("image", T.BinaryType())])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for v in batch.column(1).to_pylist():
                if v is None or len(v) != side * side or None in v:
                    out.append(None)
                    continue
                x = np.asarray(v, np.float64)
                spread = x.std()
                x = 128 + 48 * (x - x.mean()) / spread if spread > 0 else np.full(x.shape, 128.0)
                grid = np.kron(x.reshape(side, side), np.ones((cell, cell)))
                out.append(write_pgm(np.nan_to_num(_box(grid)).clip(0, 255)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=schema.names)

        return step

    return map_rows(df, [id_col, vector_col], make, schema)
