"""Vector functions as Column expressions: norms, affine 8-bit rows, sketches, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in DOUBLE."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def valid(v: Column, dim: int | None = None) -> Column:
    """Finite numbers, no zero vector and, if given, the right length."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm(v) > 1e-30)
    return F.coalesce(good & (F.size(v) == dim) if dim else good, F.lit(False))


def normalized(v: Column) -> Column:
    return let(v, lambda w: let(norm(w), lambda n: F.transform(w, lambda x: x.cast("double") / n)))


def quantized(v: Column) -> Column:
    """A struct of codes q (0..255), scale and offset of a row, in FLOAT as stored rows have them."""
    one = lambda x: x.cast("float")

    def made(w: Column, low: Column, spread: Column) -> Column:
        up = one(one(F.lit(255.0)) / spread)
        code = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), one(one(one(one(x) - low) * up) + one(F.lit(0.5))).cast("int")))
        return F.struct(F.transform(w, code).alias("q"), one(spread / one(F.lit(255.0))).alias("scale"), low.alias("offset"))

    wide = lambda spread: F.when(spread < 1e-30, one(F.lit(1.0))).otherwise(spread)
    return let(v, lambda w: let(one(F.array_min(w)), lambda low: let(wide(one(one(F.array_max(w)) - low)), lambda spread: made(w, low, spread))))


def restored(codes: Column, scale: Column, offset: Column) -> Column:
    return F.transform(codes, lambda q: offset.cast("double") + scale.cast("double") * q)


def pooled(codes: Column, dims: int, pool: int, bits: int = 8) -> Column:
    """Rounded means of groups of codes; at 4 bits as 0..15."""
    mean = lambda i: F.floor(F.aggregate(F.slice(codes, i * pool + 1, pool), F.lit(0.0), lambda s, x: s + x) / pool + 0.5)
    short = (lambda p: F.least(F.lit(15), F.floor(p / 17 + 0.5))) if bits == 4 else (lambda p: p)
    return F.transform(F.sequence(F.lit(0), F.lit(dims // pool - 1)), lambda i: short(mean(i)).cast("int"))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def hash_embedding(tokens: Column, dims: int) -> Column:
    """A stand-in encoder: of each token's SHA-256 the first four bytes (little-endian) choose a place, the fifth its value; normalized."""
    def place(h: Column) -> Column:
        order = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
        return (F.conv(order, 16, 10).cast("long") % dims).cast("int")

    value = lambda h: F.conv(F.substring(h, 9, 2), 16, 10).cast("double") / 255 * 2 - 1
    made = F.transform(tokens, lambda t: let(F.sha2(t, 256), lambda h: F.struct(place(h).alias("i"), value(h).alias("x"))))
    total = lambda m: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(F.filter(m, lambda y: y["i"] == i), F.lit(0.0), lambda s, y: s + y["x"]))
    return normalized(let(made, total))
