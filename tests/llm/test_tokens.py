"""Packing and BPE against the tokenizers library."""

import functools
import hashlib
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import _common, bpe, packing
from corpusloom.llm.queries import tokenizer_path

from .cases import ROWS, frame


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(tokenizer_path())
    out.no_truncation()
    out.no_padding()
    return out


@functools.cache
def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encode_like_the_library_on_any_text(text):
    lib = _library()
    ids = lib.encode(text, add_special_tokens=False).ids
    own = bpe.encoder(tokenizer_path())
    assert own.encode(text) == packed(ids)
    assert own.decode(packed(ids)) == lib.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["it's we'll DON'T", "a  b\tc\nd", "x<|endoftext|>y", "<|startoftext|>", "İstanbul ǅ ß ﬀ", "é ẛ̣", "1234 ½ ²", " x y​z", "\U0001f469‍\U0001f4bb", "' s 't", "don’t", "\x85\x1c\x1f x"])
def test_encode_like_the_library(library, text):
    assert bpe.encoder(tokenizer_path()).encode(text) == packed(library.encode(text, add_special_tokens=False).ids)


def test_cuts_are_pairs_inside_no_token(library):
    own = bpe.encoder(tokenizer_path())
    for word in ("zzxqjj", "strawberry", "qqqqzx9"):
        parts = own.cuts(word)
        assert "".join(parts) == word
        assert all(a[-1] + b[0] not in own.inside for a, b in zip(parts, parts[1:]))


def test_queries_contract(spark, library):
    got = bpe.encode_decode(frame(spark), tokenizer_path()).collect()
    want = []
    for i, text in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_keep_ids_returns_the_ids_and_the_text(spark, library):
    row = bpe.encode_decode(frame(spark, [(1, "hello big world")]), tokenizer_path(), keep_ids=True).first()
    ids = library.encode("hello big world", add_special_tokens=False).ids
    assert row["ids"] == ids and row["decoded"] == library.decode(ids)


def test_packing_places_every_piece(spark, library):
    got = packing.pack(frame(spark), tokenizer_path()).collect()
    want = []
    for i, text in ROWS:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want.append((i, piece, start, len(part), zlib.crc32(packed(part))))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(held) <= -(-total // 2048) + 1


def test_packing_nothing(spark):
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0
    assert bpe.encode_decode(frame(spark, []), tokenizer_path()).count() == 0


def test_packing_leaves_pieces_in_place_while_the_counts_of_tasks_are_few(spark, monkeypatch):
    counted, found = [], []
    monkeypatch.setattr(packing, "small_or_shuffled", lambda df, rows: counted.append((rows, df.count())) or _common.small_or_shuffled(df, rows))
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # Spark alone would broadcast nothing
    try:
        for most, join in ((_common.BROADCAST_ROWS, "BroadcastHashJoin"), (0, "SortMergeJoin")):
            monkeypatch.setattr(_common, "BROADCAST_ROWS", most)
            got = packing.pack(frame(spark).repartition(3), tokenizer_path())
            assert join in got._jdf.queryExecution().executedPlan().toString()
            found.append(got.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
    assert all(rows == n > 0 for rows, n in counted)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5])
    first, second = (sorted([tuple(r)[:5] for r in rows], key=key) for rows in found)
    assert first == second
    for rows in found:
        places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
        ends = [(s, at + n) for s, at, n in places]
        assert all(at == (end if s == before else 0) for (s, at, _), (before, end) in zip(places, [(None, 0), *ends]))
        assert max(end for _, end in ends) <= 2048


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_holds_the_histogram_and_is_near_the_bound(lengths):
    histogram = np.zeros(65, np.int64)
    for size, n in lengths.items():
        histogram[size] = n
    made = np.zeros(65, np.int64)
    bins = 0
    for config, n in packing.plan(histogram, 64):
        assert sum(config) <= 64 and n > 0
        bins += n
        for size in config:
            made[size] += n
    assert (made == histogram).all()
    total = int((histogram * np.arange(65)).sum())
    big = int(histogram[33:].sum())  # no two of these share a sequence
    sizes = np.repeat(np.arange(65), histogram)
    most = max(1, int((np.cumsum(sizes) <= 64).sum()))  # no sequence holds more pieces than the smallest ones allow
    assert bins <= 1.25 * max(-(-total // 64), big, -(-len(sizes) // most)) + 2


def test_plan_takes_no_more_sequences_than_best_fit_decreasing():
    rng = np.random.default_rng(0)
    for _ in range(200):
        histogram = np.zeros(65, np.int64)
        for size in rng.integers(1, 65, rng.integers(1, 21)):
            histogram[size] = rng.integers(1, 41)
        space, made = [], np.zeros(65, np.int64)  # one piece at a time
        for size in np.repeat(np.arange(65), histogram)[::-1].tolist():
            fits = [(left, k) for k, left in enumerate(space) if left >= size]
            if fits:
                space[min(fits)[1]] -= size
            else:
                space.append(64 - size)
        planned = packing.plan(histogram, 64)
        for config, n in planned:
            assert sum(config) <= 64 and n > 0
            np.add.at(made, config, n)
        assert (made == histogram).all()
        assert sum(n for _, n in planned) <= len(space), np.flatnonzero(histogram)


def test_encoding_all_at_once_equals_the_library():
    """Every code point below U+2500 alone and among letters, and random texts of blanks, marks, digits and special tokens."""
    own = bpe.encoder(tokenizer_path())
    alone = [chr(c) for c in range(0x2500)]
    texts = [*alone, *("a" + c + "b 1" + c for c in alone), "a<|endoftext|>b", "<|startoftext|><|endoftext|>x'S 'LL", "İ<| x", "", None]
    rng = np.random.default_rng(3)
    letters = list("abcDEF'stredvmll0123 .,;!?-_<|>\t\n\r\x0b\x0c\x85\xa0éÖßñÉİıſǅ²½ªªµ\u0301\u00ad\u200b語")
    texts += ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(5000)]
    got = own.encode_all(pa.array(texts))
    want = own.library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [w.ids for w in want]


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(20):
        price = rng.random(12)
        best, last = packing._knapsack(price, 12)
        want = [0.0]
        for c in range(1, 13):
            want.append(max([want[c - 1], *(want[c - n] + price[n - 1] for n in range(1, c + 1))]))
        assert np.allclose(best, want)
        taken = packing._take(last, 12)
        assert np.isclose(sum(price[n - 1] for n in taken), best[12]) and sum(taken) <= 12
