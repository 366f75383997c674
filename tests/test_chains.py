"""Chains, the index in lists, exports, features, notes and gates on small rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import student
from corpusloom.functions import text as fx
from corpusloom.operators import calibrate, chain, evaluate, index, layers, lexical, ranking, vector
from corpusloom.sources import exports
from corpusloom.streaming import append

LAYERS = "depth long, identity string, parent string, n_records long"


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def order(spark, rows, lexical_ids, **more):
    """Fused order of (id, distance) rows with lexical hits in order."""
    place = {}
    for k, i in enumerate(lexical_ids, 1):
        place.setdefault(i, k)
    pool = [(1, i, d, k, place.get(i), False) for k, (i, d) in enumerate(rows, 1)]
    df = spark.createDataFrame(pool, "query_id long, row_id long, distance double, vec_rank long, lexical_rank long, pinned boolean")
    return [r["row_id"] for r in ranking.fuse(df, **more).orderBy("fused_rank").collect()]


def test_fusion(spark):
    pool = [(10, 0.20), (11, 0.30), (12, 0.31), (13, 0.40), (14, 0.50)]
    assert order(spark, pool, [13])[:3] == [10, 13, 11]
    assert order(spark, pool, [13], weight=1, guard=None)[0] == 13
    assert order(spark, pool, [12, 11], weight=1, guard=None)[:2] == [12, 11]
    assert order(spark, pool, [99, 13], weight=1, guard=None)[0] == 13
    assert order(spark, pool[1:], [13])[0] == 13
    assert order(spark, [(10, 0.0), (13, 0.9)], [13])[0] == 10
    assert order(spark, [(10, 0.0), (13, 0.0)], [13])[0] == 13


def test_masks_come_before_the_cut(spark):
    rows = [np.array([1, i / 64, *[0] * 14]) for i in range(64)]
    df = spark.createDataFrame([(k, (v / np.linalg.norm(v)).tolist()) for k, v in enumerate(rows)], "row_id long, vector array<double>")
    q = df.where("row_id = 0").select(F.col("row_id").alias("query_id"), "vector")
    mask = lambda ids: spark.createDataFrame([(i,) for i in ids], "row_id long")
    got = [r["row_id"] for r in vector.nearest(df, q, 5, exclude=mask([0, 1, 2])).orderBy("vec_rank").collect()]
    assert got == [3, 4, 5, 6, 7]
    assert vector.nearest(df, q, 3, exclude=mask(range(50))).orderBy("vec_rank").first()["row_id"] == 50
    assert vector.nearest(df, q, 3, exclude=mask(range(64))).count() == 0


def test_layers_by_hand(spark):
    lay = spark.createDataFrame([(0, "a", None, 100), (1, "b", "a", 10), (2, "c", "b", 0), (3, "d", "c", 5)], LAYERS)
    ids = spark.createDataFrame([(110,), (115,), (-1,), (99,)], "record_id long")
    assert {(r["record_id"], r["depth"], r["local_id"]) for r in layers.owners(ids, lay).collect()} == {(110, 3, 0), (99, 0, 99)}
    tomb = spark.createDataFrame([(1, i) for i in (5, 99)] + [(2, i) for i in (5, 99, 100, 109)], "depth long, record_id long")
    two = lay.where("depth < 2")
    assert layers.live(spark.range(110).select(F.col("id").alias("record_id")), tomb).count() == 106
    assert {r["local_id"] for r in layers.owners(tomb.select("record_id").distinct(), two).where("depth = 1").collect()} == {0, 9}


def test_successors_by_depth(spark):
    edges = "depth long, old_id long, new_id long"
    got = {r["old_id"]: r for r in layers.successors(spark.createDataFrame([(1, 10, 100), (2, 10, 150), (3, 100, 200)], edges)).collect()}
    assert (got[10]["immediate"], got[10]["successors"], got[10]["current"]) == (100, [100, 150], 150)
    two = {r["old_id"]: r for r in layers.successors(spark.createDataFrame([(1, 10, 100), (2, 100, 200)], edges)).collect()}
    assert two[10]["immediate"] == 100 and two[10]["current"] == 200


@pytest.mark.parametrize("repeated", [False, True])
def test_drift_counts_each_deletion_once(spark, repeated):
    """The same with tables of deltas and with cumulative ones."""
    lay = spark.createDataFrame([(0, "a", None, 1000), (1, "b", "a", 50), (2, "c", "b", 30)], LAYERS)
    first = [(1, i) for i in range(50)]
    rows = first + [(2, i) for i in range(50, 80)] + ([(2, i) for i in range(50)] if repeated else [])
    got = layers.drift(lay, spark.createDataFrame(rows, "depth long, record_id long")).orderBy("depth").collect()
    assert [r["drift"] for r in got] == [0.0, 0.1, 0.16] and {r["status"] for r in got} == {"inherited"}
    fewer = spark.createDataFrame([(2, i) for i in range(20)], "depth long, record_id long")
    drifts = layers.drift(lay, fewer).drop("status")
    state = lambda **more: [r["status"] for r in layers.calibration_status(drifts, **more).orderBy("depth").collect()]
    assert state() == ["inherited"] * 3 and state(base_has_fit=False) == ["none"] * 3
    assert state(envelope=0.05) == ["inherited", "inherited", "drift-exceeded"]
    assert state(blooms=lay.where("depth = 2").select("depth")) == ["inherited", "drift-exceeded", "drift-exceeded"]
    with pytest.raises(ValueError):
        layers.calibration_status(drifts, reader_limit=float("inf"))


def test_rebase_modes(spark):
    ids = lambda rows: spark.createDataFrame([(r,) for r in rows], "record_id long")
    edges = lambda rows: spark.createDataFrame(rows, "old_id long, new_id long")
    head = spark.createDataFrame([(4, 7, 130), (4, 8, 131)], "depth long, old_id long, new_id long")
    args = (ids([1, 2, 3, 105]), ids([1]), edges([(7, 112), (9, 113), (106, 114)]), 110, 5, 140, ids([2]), head, 100)
    for more in ({}, {"on_foreign": "drop"}):
        with pytest.raises(ValueError):
            chain.rebase(*args, **more)
    with pytest.raises(ValueError):
        chain.rebase(*args, on_foreign="ask")
    got = {(r["kind"], r["old_id"], r["new_id"], r["action"]) for r in chain.rebase(*args, on_foreign="drop", on_conflict="keep-both").collect()}
    assert got == {("deletion", 2, None, "no-op"), ("deletion", 3, None, "set"), ("deletion", 105, None, "drop"), ("edge", 7, 142, "keep-both"), ("edge", 9, 143, "record"), ("edge", 106, 144, "drop")}
    skipped = chain.rebase(*args, on_foreign="drop", on_conflict="skip")
    assert skipped.where("action = 'skip'").count() == 1 and chain.emits(skipped, ids([2]), 0)
    nothing = chain.rebase(ids([2]), ids([]), edges([]), 110, 0, 140, ids([2]), head, 100)
    assert not chain.emits(nothing, ids([2]), 0) and chain.emits(nothing, ids([2]), 1)
    with pytest.raises(ValueError):  # an edge out of the layer's own range
        chain.rebase(ids([]), ids([]), edges([(9, 130)]), 110, 5, 140, ids([]), head, 100)


def test_compaction_carries_the_rows(spark):
    records = spark.createDataFrame([(k, f"t{k}") for k in range(6)], "record_id long, text string")
    tomb = spark.createDataFrame([(1, 1), (1, 4), (1, 4)], "depth long, record_id long")
    edges = spark.createDataFrame([(1, 1, 5)], "depth long, old_id long, new_id long")
    live, lineage = chain.compacted(records, tomb, edges)
    assert sorted((r["record_id"], r["old_id"], r["text"]) for r in live.collect()) == [(0, 0, "t0"), (1, 2, "t2"), (2, 3, "t3"), (3, 5, "t5")]
    assert {r["record_id"]: (r["new_id"], r["reason"]) for r in lineage.collect()} == {0: (0, "live"), 1: (3, "superseded"), 2: (1, "live"), 3: (2, "live"), 4: (None, "deleted"), 5: (3, "live")}


def test_walk_targets_and_asof(spark):
    lay = spark.createDataFrame([(d, f"h{d}", f"h{d - 1}" if d else None, 10) for d in range(12)] + [(1, "lost", "nowhere", 3)], LAYERS)
    got = chain.walk_to_base(lay, spark.createDataFrame([("h11",), ("lost",)], "identity string")).collect()
    assert sorted((r["hop"], r["identity"]) for r in got if r["head"] == "h11") == [(k, f"h{11 - k}") for k in range(12)]
    assert [(r["hop"], r["depth"]) for r in got if r["head"] == "lost"] == [(0, 1)]
    ids = spark.createDataFrame([(0,), (10,), (119,), (120,)], "record_id long")
    assert {r["record_id"]: r["since"] for r in chain.citable_since(ids, lay.where("identity <> 'lost'")).collect()} == {0: 0, 10: 1, 119: 11}
    asked = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, old_id long")
    new = spark.createDataFrame([(7, "a"), (8, "b"), (9, "b")], "record_id long, path string")
    assert {r["path"]: (r["new_id"], r["status"]) for r in chain.supersede_targets(asked, new).collect()} == {"a": (7, "resolved"), "b": (None, "ambiguous"), "c": (None, "missing")}


def test_hits_win_over_records(spark):
    hits = spark.createDataFrame([(1, 5, 0.25)], "query_id long, row_id long, distance double")
    records = spark.createDataFrame([(5, "T", 9.0, 77, "b")], "doc_id long, title string, Distance double, row_id long, text string")
    row = chain.hydrated(hits, records).first()
    assert row["distance"] == 0.25 and row["row_id"] == 5 and row["title"] == "T"
    out = chain.public(chain.hydrated(hits, records), "p", "i").first().asDict()
    assert out == {"pack": "p", "pack_identity": "i", "id": 5, "title": "T", "heading_path": [], "anchor": None, "source": None, "distance": 0.25, "text": "b"}


def test_notes(spark):
    rows = [("todo", " a title ", "text ", ["A", "a", " b "]), ("joke", "t", "x", None), ("todo", "two\nlines", "x", None), ("todo", "t" * 201, "x", None), ("todo", "t", " \n", None), ("todo", "t", "é" * 9000, None), ("todo", "t", "x", ["a"] * 21), ("todo", "t", "x", [" "]), (None, "t", "x", [])]
    got = chain.shaped_notes(spark.createDataFrame(rows, "kind string, title string, text string, tags array<string>")).collect()
    assert [r["reason"] for r in got] == [None, "kind", "title", "title", "text", "text", "tags", "tags", "kind"]
    assert (got[0]["title"], got[0]["text"], got[0]["tags"]) == ("a title", "text", ["a", "b"])


def test_journal_and_shelf(spark, tmp_path):
    kind = "kind string, title string, text string, tags array<string>"
    path = str(tmp_path / "journal")
    bad = append.append_note(spark.createDataFrame([("todo", "one", "x", ["t"]), ("bad", "two", "y", [])], kind), 0, path)
    assert [r["title"] for r in bad.collect()] == ["two"]
    append.append_note(spark.createDataFrame([("todo", "three", "x", ["t"])], kind), 1, path)
    assert {r["title"]: r["depth"] for r in append.records(spark, path).collect()} == {"one": 1, "three": 2}
    rows = {r["pack"]: r for r in chain.shelf(spark, {"j": f"{path}", "none": str(tmp_path / "none")}).collect()}
    assert rows["none"]["status"] == "failed" and rows["none"]["reason"] and rows["j"]["records"] == 2


def test_stream_keeps_refused_batches_and_passes_the_depth(spark, tmp_path):
    path = str(tmp_path / "pack")
    batch = lambda n, size=2: spark.createDataFrame([(100 * n + k, f"t{n}") for k in range(size)], "record_id long, text string")
    for n in range(12):  # deeper than a chain may be: compacted in between
        assert append.append_batch(batch(n), n, path, 100) == "appended"
    assert append.append_batch(batch(3), 3, path, 100) == "again"
    assert append.append_batch(batch(50, 0), 50, path, 100) == "empty"
    rows = append.records(spark, path)
    assert rows.count() == 24 and rows.agg(F.max("depth")).first()[0] == 4
    with pytest.raises(append.DriftExceeded):
        append.append_batch(batch(60, 30), 60, path, 100)
    assert append.heads(spark, path).where("batch = 60").isEmpty() and append.records(spark, path).count() == 24
    refused = []
    assert append.append_batch(batch(60, 30), 60, path, 100, on_refusal=lambda *a: refused.append(a)) == "refused"
    assert refused[0][0] == 60 and spark.read.parquet(f"{path}/refused/batch=60").count() == 30
    assert append.append_batch(batch(61), 61, path, 100) == "appended"


def test_stream_without_callback_stops_before_it_loses_rows(spark, tmp_path):
    src, path = tmp_path / "in", str(tmp_path / "pack")
    spark.createDataFrame([(k, "x") for k in range(50)], "record_id long, text string").write.parquet(str(src))
    stream = lambda: spark.readStream.schema("record_id long, text string").parquet(str(src))
    with pytest.raises(Exception, match="drift"):
        append.append_stream(stream(), path, str(tmp_path / "ck"), 100).awaitTermination()
    append.append_stream(stream(), path, str(tmp_path / "ck"), 1000).awaitTermination()  # the same batch, against a larger base
    assert append.records(spark, path).count() == 50


def clustered(n=600, dims=16, groups=12, seed=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dims))
    x = middle[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_index_in_lists(spark, tmp_path):
    x = clustered()
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "row_id long, vector array<double>")
    queries = rows.where("row_id % 20 = 0").select(F.col("row_id").alias("query_id"), "vector")
    truth = vector.nearest(rows, queries, 10)
    own = index.VectorIndex(spark, str(tmp_path / "ix"), lists=16)
    own.add(rows.where("row_id < 400"))
    own.add(rows.where("row_id >= 400"))
    with pytest.raises(ValueError):
        own.add(spark.createDataFrame([(1000, [0.0] * 16)], "row_id long, vector array<double>"))
    pairs = lambda df: sorted((r["query_id"], r["vec_rank"], r["row_id"]) for r in df.collect())
    assert pairs(own.search(queries, 10)) == pairs(truth)
    assert own.tune(queries) < 16
    assert index.recall(own.search(queries, 10), truth).first()[0] >= 0.95
    allow = rows.where("row_id % 50 = 1").select("row_id")  # few rows: the search widens
    exact = vector.nearest(rows, queries, 10, allow=allow)
    assert own.search(queries, 10, probes=1, allow=allow).groupBy("query_id").count().where("count < 10").count() == 0
    assert index.recall(own.search(queries, 10, probes=16, allow=allow), exact).first()[0] == 1.0
    own.delete(queries.select(F.col("query_id").alias("row_id")))
    state = own.state().first()
    assert (state["stored"], state["live"], state["deleted"]) == (600, 570, 30)
    assert own.search(queries, 10, probes=16).where("row_id % 20 = 0").count() == 0
    assert own.has(spark.createDataFrame([(0,), (1,), (9999,)], "row_id long")).orderBy("row_id").collect() == [(0, True, True), (1, True, False), (9999, False, False)]
    own.delete(rows.where("row_id < 400").select("row_id"))
    own.compact()
    state = own.state().first()
    assert state["stored"] == state["live"] == 190 and state["deleted_ratio"] == 0
    assert {r["row_id"] % 20 for r in own.search(queries, 5, probes=16).collect()} >= {1, 2}


def test_clusters_and_overlap(spark):
    x = clustered(groups=4)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "row_id long, vector array<double>")
    got = {r["row_id"]: r["cluster"] for r in index.clusters(rows, 4).collect()}
    near = (x @ x.T) > 0.9
    same = np.array([[got[i] == got[j] for j in range(0, 600, 7)] for i in range(0, 600, 7)])
    assert same[near[::7, ::7]].mean() > 0.95
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id long, row_id long, vec_rank long")
    b = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "query_id long, row_id long, vec_rank long")
    assert index.topk_overlap(a, b, 2).first()["overlap"] == 0.5
    assert index.centres(rows.limit(0), 3).size == 0


def test_exports(spark):
    listed = [{"uuid": "u1", "name": " ", "chat_messages": [{"sender": "human", "created_at": "2024-05-06T01:02:03Z", "text": "flat", "content": [{"type": "text", "text": "Hi there"}, {"type": "tool_use", "text": None}]}, {"sender": "assistant", "created_at": None, "text": "Reply", "content": []}, {"sender": "system", "text": "no"}]}]
    node = lambda parent, role, parts, **more: {"parent": parent, "message": {"author": {"role": role}, "recipient": "all", "create_time": 1714953600.0, "metadata": {}, "content": {"content_type": "text", "parts": parts}, **more}}
    tree = [{
        "id": "c1", "title": "Talk", "current_node": "d", "mapping": {
            "r": {"parent": None, "message": None}, "a": node("r", "user", ["Question", {"asset": 1}, "more"]), "b": node("a", "assistant", ["old"]), "h": node("a", "user", ["hidden"], metadata={"is_visually_hidden_from_conversation": True}),
            "t": node("h", "assistant", ["call"], recipient="python"), "d": node("t", "assistant", ["Answer"]),
        },
    }]
    files = lambda x: spark.createDataFrame([("f", json.dumps(x)), ("g", "{no json"), ("h", None)], "path string, value string")
    got = exports.listed_turns(files(listed)).orderBy("turn").collect()
    assert [(r["role"], r["text"], r["date"], r["title"]) for r in got] == [("user", "Hi there", "2024-05-06", "Hi there"), ("assistant", "Reply", None, "Hi there")]
    got = exports.tree_turns(files(tree)).orderBy("turn").collect()
    assert [(r["conv_id"], r["role"], r["text"], r["title"]) for r in got] == [("c1", "user", "Question\n\nmore", "Talk"), ("c1", "assistant", "Answer", "Talk")]
    assert exports.tree_turns(files(listed)).count() == 0 and exports.listed_turns(files(tree)).count() == 0


def test_student_features(spark):
    got = one(spark, student.features(F.col("t"), 100), t="Ab, c9")
    assert got == ["w:ab", "c3:^ab", "c3:ab$", "c4:^ab$", "w:c9", "c3:^c9", "c3:c9$", "c4:^c9$", "b:ab:c9"]
    assert one(spark, student.features(F.col("t"), 3), t="Ab, c9") == got[:3] and one(spark, student.features(F.col("t"), 3), t=None) == []
    want = 17
    for c in b"w:ab":
        want = ((want ^ c) * 16777619) & 0xFFFFFFFF
    assert one(spark, student.feature_hash(F.col("t"), 17), t="w:ab") == want
    assert one(spark, student.family(F.col("t")), t="c3:abc") == "char" and one(spark, student.family(F.col("t")), t="w:c3") == "word"
    p = lambda **s: one(spark, student.confidence({k: F.col(k) for k in s}, {k: 2.0 for k in s}, -1.0), **s)
    assert p(a=1.0) == pytest.approx(1 / (1 + np.exp(-1))) and p(a=-900.0) == pytest.approx(0.0)
    v = lambda p, n, norm: one(spark, student.verdict(F.col("p"), F.col("n"), F.col("m"), 0.1, 0.6), p=p, n=n, m=norm)
    assert [v(0.05, 9, 1.0), v(0.5, 9, 1.0), v(0.6, 9, 1.0), v(0.9, 2, 1.0), v(0.9, 9, 0.3)] == ["none", "weak", "strong", "none", "none"]
    assert one(spark, student.known_fraction(F.array(F.lit(1), F.lit(2), F.lit(2)), F.array(F.lit(2)))) == pytest.approx(2 / 3)


def test_quotes(spark):
    said = lambda passage, quote: one(spark, fx.quote_present(F.col("p"), F.col("q")), p=passage, q=quote)
    assert said("It's a well-known FACT.", "well known fact") and not said("nothing", "well known fact") and not said("x", "")
    long = "alpha beta gamma delta epsilon zeta theta iota"
    assert said("alpha beta gamma delta epsilon and more", long) and not said("alpha beta gamma delta", long)


def test_probability_thresholds():
    low, high = np.linspace(0.01, 0.2, 100), np.linspace(0.7, 0.99, 100)
    hard, weak = calibrate.thresholds(high, low, np.zeros(0))
    assert hard == calibrate.quantile(low, 0.95) and weak == pytest.approx(0.9 * calibrate.quantile(high, 0.05))
    hard, weak = calibrate.thresholds(high, low, np.array([0.4, 0.5]))
    assert weak == pytest.approx(np.sqrt(0.5 * calibrate.quantile(high, 0.05)))
    assert calibrate.thresholds(high, np.full(50, 0.97), np.zeros(0))[0] == 0.5
    hard, weak = calibrate.thresholds(np.full(9, 0.1), np.full(9, 0.3), np.zeros(0))
    assert weak == pytest.approx(hard + 0.08)


def test_gates_of_the_fit():
    rng = np.random.default_rng(1)
    y = np.repeat([1, 0], 40)
    near = np.where(y == 1, 0.2, 0.6)[:, None] + 0.02 * rng.normal(size=(80, 1))
    assert calibrate.calibrated(near, y)["passed"]
    assert calibrate.calibrated(-near, y)["reason"] == "distance weight"
    assert calibrate.calibrated(rng.normal(size=(80, 1)), y)["reason"] == "auc"
    assert calibrate.calibrated(near[:43], y[:43])["reason"] == "few negatives" and calibrate.calibrated(near[38:], y[38:])["reason"] == "few positives"
    assert calibrate.calibrated(near, y, human=np.full((8, 1), 0.6))["reason"] == "human questions withheld"
    assert calibrate.calibrated(near, y, human=np.full((7, 1), 0.6))["passed"]
    got = calibrate.sample(list(range(50)), 50, 9)
    assert sorted(got) == list(range(50)) and got != sorted(got) and calibrate.sample([], 3, 1) == []


def test_entities_and_blooms(spark):
    docs = spark.createDataFrame([(1, "Darcy met Civil Mix and the NASA crew. Apple"), (2, "an apple for Darcy"), (3, None)], "doc_id long, text string")
    assert {r["entity"] for r in lexical.entities(docs).collect()} == {"darcy", "nasa"}
    layered = spark.createDataFrame([(0, "one two"), (1, "two three"), (1, None)], "depth long, text string")
    blooms = lexical.layer_blooms(layered, 1 << 14)
    assert blooms.where("depth = 0").count() == 4 and lexical.union_bloom(blooms).count() == 6 and lexical.union_bloom(blooms).where("n_layers = 2").count() == 2


def test_search_arguments(spark):
    assert ranking.checked(7, 5) == 5 and ranking.checked(3, 0) == 1
    for bad in ((0, 5), (2.5, 5), (True, 5), (5, 9, "graph"), (30, 90, "hybrid", 20)):
        with pytest.raises(ValueError):
            ranking.checked(*bad)
    assert vector.candidates_kept(5, 1000) == 100 and vector.candidates_kept(5, 1000, recommended=9000) == 1000 and vector.candidates_kept(5, 60, tier="micro") == 60
    hits = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "query_id long, row_id long")
    verdicts = spark.createDataFrame([(1, "none"), (2, "weak")], "query_id long, verdict string")
    assert {r["query_id"]: r["verdict"] for r in ranking.gated(hits, verdicts).collect()} == {2: "weak", 3: "unscored"}
    assert ranking.gated(hits, verdicts, show_abstained=True).count() == 3


def test_rank_classes(spark):
    rows = [(1, "hybrid", 2), (1, "vector", 9), (2, "hybrid", 7), (2, "lexical", 1), (3, "vector", 30), (4, "hybrid", 8), (4, "vector", 6), (5, "hybrid", None)]
    got = {r["query_id"]: r["class"] for r in evaluate.rank_classes(spark.createDataFrame(rows, "query_id long, mode string, rank long"), 10).collect()}
    assert got == {1: "top3", 2: "demotion", 3: "gap", 4: "range", 5: "gap"}
