"""Near-duplicates, repeated passages and image copies against brute force."""

from collections import Counter, defaultdict

import numpy as np

from corpusloom.llm import _common, _components, media, neardup, substring
from corpusloom.llm._components import components

from .cases import PROSE, ROWS, frame, ids, want_ids


def sentence(rng, n):
    return [f"w{k}" for k in rng.integers(0, 3000, n)]


def edited(rng, words, changes):
    out = list(words)
    for k in rng.choice(len(out), changes, replace=False):
        out[k] = f"edit{rng.integers(10**6)}"
    return out


def shingles(text):
    w = ["".join(c for c in x) for x in "".join(c.lower() if c.isalnum() else " " for c in text or "").split()]
    if not w:
        return Counter()
    n = min(5, len(w))
    return Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))


def overlap(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows):
    own = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if own[i] and own[j] and overlap(own[i], own[j]) >= 0.8:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[find(k)].append(i)
    return sorted(sorted((i is None, i or 0) for i in g) for g in groups.values())


def corpus(seed=1):
    rng = np.random.default_rng(seed)
    rows, at = [], 1000
    for _ in range(12):
        base = sentence(rng, 150)
        for _ in range(rng.integers(1, 9)):
            rows.append((at, " ".join(edited(rng, base, rng.integers(0, 3)))))
            at += 1
    rows += [(at + k, " ".join(sentence(rng, 80))) for k in range(20)]
    return rows


def got_classes(out):
    groups = defaultdict(list)
    lone = []
    for k, r in enumerate(out.collect()):
        (lone if r["class_size"] == 1 else groups[r["class_id"]]).append(r["doc_id"])
    return sorted([sorted((i is None, i or 0) for i in g) for g in groups.values()] + [[(i is None, i or 0)] for i in lone])


def test_classes_like_brute_force(spark):
    rows = corpus() + ROWS
    assert got_classes(neardup.classes(frame(spark, rows))) == brute_classes(rows)


def test_many_copies_and_chains(spark):
    rng = np.random.default_rng(7)
    base = sentence(rng, 200)
    rows = [(k, " ".join(base)) for k in range(300)]
    for k in range(12):  # each a little further from the first
        base = edited(rng, base, 2)
        rows.append((1000 + k, " ".join(base)))
    assert got_classes(neardup.classes(frame(spark, rows))) == brute_classes(rows)


def test_drifting_families_and_two_hubs_joined_by_one_pair(spark):
    """Families whose versions drift from copy to copy, and two stars that only one pair of their members joins."""
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(4):
        base = sentence(rng, 150)
        for _ in range(40):
            rows.append((len(rows), " ".join(base)))
            base = edited(rng, base, rng.integers(1, 4))
    base = sentence(rng, 200)
    far = edited(rng, base, 11)
    changed = [k for k in range(200) if far[k] != base[k]]
    between = lambda n: [far[k] if k in changed[:n] else base[k] for k in range(200)]
    for hub, chain in ((base, between(4)), (far, between(8))):
        rows.append((len(rows), " ".join(hub)))
        rows.append((len(rows), " ".join(chain)))
        own = [k for k in range(200) if k not in changed]
        for _ in range(25):
            text = list(hub)
            for k in rng.choice(own, 3, replace=False):
                text[k] = f"edit{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(text)))
    assert overlap(*(shingles(" ".join(x)) for x in (base, far))) < 0.8
    want, got = brute_classes(rows), got_classes(neardup.classes(frame(spark, rows)))
    pairs = lambda groups: {(a[1], b[1]) for g in groups for a in g for b in g if a < b}
    assert pairs(got) <= pairs(want)
    assert len(pairs(got)) >= 0.99 * len(pairs(want))


def test_prefix_filter_keeps_every_alike_pair(spark):
    """All pairs of 0.8 and more with different labels pass the bound, and few others do."""
    rng = np.random.default_rng(12)
    base = sentence(rng, 150)
    texts = [" ".join(edited(rng, base, rng.integers(0, 9))) for _ in range(120)] + [" ".join(base + base[: rng.integers(0, 60)]) for _ in range(30)]
    doc, value, count = neardup.multisets(texts)
    nodes, lists = [], []
    for k in range(len(texts)):
        own = doc == k
        nodes.append((k, k // 3, int(count[own].sum())))
        lists.append((k, value[own].view(np.int64).tolist(), count[own].tolist() if (count[own] > 1).any() else []))
    out = neardup._apart(spark.createDataFrame(nodes, "node long, label long, weight long"), spark.createDataFrame(lists, "node long, keys array<long>, counts array<int>"), 0.8)
    got = {(r["a"], r["b"]) for r in out.collect()}
    own = [shingles(t) for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if i // 3 != j // 3 and overlap(own[i], own[j]) >= 0.8}
    assert want and want <= got
    assert len(got) < 0.5 * len(texts) ** 2 / 2


def test_keep_first_keeps_one_row_of_each_class(spark):
    rows = corpus(3) + ROWS
    df = frame(spark, rows)
    kept = neardup.keep_first(df)
    assert kept.columns == df.columns
    want = Counter()
    for group in brute_classes(rows):
        want[group[0]] += 1
    got = Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert got == want
    assert neardup.keep_first(frame(spark, [])).count() == 0 == neardup.classes(frame(spark, [])).count()


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    near, far = [], []
    for _ in range(40):
        a = rng.integers(0, 60, 300)
        b = np.where(rng.random(300) < 0.15, rng.integers(100, 160, 300), a)
        counts = [Counter(a.tolist()), Counter(b.tolist())]
        doc = np.repeat([0, 1], [len(c) for c in counts])
        value = np.concatenate([np.array(sorted(c), np.uint64) for c in counts])
        count = np.concatenate([np.array([c[k] for k in sorted(c)]) for c in counts])
        with np.errstate(over="ignore"):
            s = neardup.signatures(doc, value, count, 2, 256)
        near.append((s[0] == s[1]).mean())
        far.append(overlap(*counts))
    assert abs(np.mean(near) - np.mean(far)) < 0.02 and np.max(np.abs(np.array(near) - far)) < 0.13


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 20)] + [(200, 201), (201, 200), (200, 200)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(31)) and all(got[100 + k] == 100 for k in range(20)) and got[201] == 200


def test_repeated_passage_is_found_whatever_stands_before_it(spark):
    rng = np.random.default_rng(2)
    passage = " ".join(sentence(rng, 90))
    rows = [(k, " ".join(sentence(rng, 40 + 7 * k)) + " " + passage + " " + " ".join(sentence(rng, 30))) for k in range(6)]
    rows += [(50 + k, " ".join(sentence(rng, 200))) for k in range(6)]
    out = {r["doc_id"]: r for r in substring.report(frame(spark, rows)).collect()}
    assert out[0]["removed_words"] == 0
    for k in range(1, 6):
        assert 60 <= out[k]["removed_words"] <= 95, (k, out[k])
        text = rows[k][1]
        for run in out[k]["runs"].split(","):
            start, end = map(int, run.split(":"))
            assert text[start:end].strip() in passage + " w"
    assert all(out[50 + k]["removed_words"] == 0 for k in range(6))


def brute_chunks(rows):
    """What is repeated, by a dictionary over all chunks in order."""
    order = sorted({(i is None, i or 0, t) for i, t in rows if t})
    seen, out = {}, defaultdict(list)
    for doc in order:
        d, start, end, digest = substring.chunks([doc[2]])
        for s, e, g in zip(start.tolist(), end.tolist(), digest.tolist()):
            if g in seen:
                out[doc].append((s, e, ((g >> 1) & 63) + 1))
            else:
                seen[g] = doc
    return {doc: substring._runs(x) for doc, x in out.items() if substring._runs(x)}


def test_runs_like_a_dictionary_of_chunks(spark):
    rng = np.random.default_rng(9)
    shared = [" ".join(sentence(rng, n)) for n in (20, 60, 120)]
    rows = [(k, " ".join(sentence(rng, 50)) + " " + shared[k % 3] + "\n" + " ".join(sentence(rng, 20)) + " " + shared[(k + 1) % 3]) for k in range(30)]
    rows += [(None, shared[2]), (5, shared[1])]
    df = frame(spark, rows).repartition(5)
    want = brute_chunks(rows)
    out = substring.report(df).collect()
    assert len(out) == len(rows)
    totals = Counter()
    for (null, i, _), runs in want.items():
        totals[None if null else i] += sum(w for *_, w in runs)
    got = Counter()
    for r in out:
        got[r["doc_id"]] += r["removed_words"]
    assert +got == +totals


def test_hash_is_of_the_last_characters_only():
    a = np.frombuffer(("x" * 40 + "the same tail of text").encode("utf-32-le"), np.uint32)
    b = np.frombuffer(("another beginning" + "the same tail of text").encode("utf-32-le"), np.uint32)
    with np.errstate(over="ignore"):
        assert (substring.gear(a.copy())[-3:] == substring.gear(b.copy())[-3:]).all()


def test_report_moves_no_text_and_broadcasts_by_bytes(spark, monkeypatch):
    """A report whose list of runs is too large to broadcast joins hashes, not texts, with the same rows; the list is held by bytes too."""
    rng = np.random.default_rng(41)
    passages = [" ".join(sentence(rng, 40)) for _ in range(6)]
    rows = [(k, " ".join([*sentence(rng, 20), passages[k % 6], *sentence(rng, 20), passages[(k + 1) % 6]])) for k in range(30)] + ROWS
    df = frame(spark, rows)

    def joins(plan):
        found = [plan] if plan.nodeName() == "Join" else []
        return found + [j for k in range(plan.children().size()) for j in joins(plan.children().apply(k))]

    def run():
        out = substring.report(df)
        last = joins(out._jdf.queryExecution().optimizedPlan())
        assert len(last) == 1
        return Counter(tuple(r) for r in out.collect()), last[0].left().output().toString(), "broadcast" in last[0].hint().toString()

    want, columns, held = run()
    assert held and sum(r[1] for r in want) > 0
    monkeypatch.setattr(substring, "_BROADCAST", 0)
    got, columns, held = run()
    assert got == want and not held
    assert "text#" not in columns.replace("_corpusloom_text", "")
    monkeypatch.setattr(substring, "_BROADCAST", 100_000)
    monkeypatch.setattr(substring, "_BROADCAST_BYTES", 1000)
    got, columns, held = run()
    assert got == want and not held


def test_remove_takes_repeats_and_keeps_the_rest(spark):
    df = frame(spark)
    out = substring.remove(df)
    assert out.columns == df.columns
    assert ids(substring.report(df)) == want_ids()
    texts = [r["text"] for r in out.collect()]
    assert PROSE in texts and sum(t == PROSE for t in texts) >= 1
    assert substring.remove(frame(spark, [])).count() == 0 == substring.report(frame(spark, [])).count()


def picture(rng, side=96):
    cells = rng.integers(0, 255, (side // 8, side // 8)).astype(float)
    return media._box(np.kron(cells, np.ones((8, 8))))


def test_copies_of_images_are_found(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(6):
        p = picture(rng)
        rows.append((10 * k, p))
        rows.append((10 * k + 1, p[5:, 3:]))  # cropped
        rows.append((10 * k + 2, np.clip(p * 0.9 + 10, 0, 255)))  # darker
        q = p.copy()
        q[30:50, 30:50] = 128  # partly covered
        rows.append((10 * k + 3, q))
    rows = [(i, media.write_pgm(p)) for i, p in rows] + [(0, None), (None, None), (None, b"broken"), (900, b"broken"), (901, media.write_pgm(np.full((50, 50), 7)))]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None, "x") for i, b in rows], "doc_id long, image binary, _node string")
    out = media.copies(df, "doc_id", "image").collect()
    assert len(out) == len(rows)
    of = {(r["doc_id"], r["class_size"]): r["class_id"] for r in out}
    for k in range(6):
        assert {of.get((10 * k + j, 4)) for j in range(4)} == {10 * k}, (k, sorted(of.items(), key=str))
    assert Counter(r["class_id"] for r in out)[900] == 2
    empty = spark.createDataFrame([], "doc_id long, image binary")
    assert media.copies(empty, "doc_id", "image").count() == 0


def test_agreeing_counts_a_shifted_copy_and_not_another_image():
    rng = np.random.default_rng(8)
    p, q = picture(rng), picture(rng)
    same = media.agreeing(media.describe(p), media.describe(p[4:, 6:]))
    assert same >= media.AGREE > media.agreeing(media.describe(p), media.describe(q))


def test_rendered_vectors(spark):
    rows = [(1, [float(k) for k in range(64)]), (2, [1.0, 2.0]), (3, None), (4, [1.0] * 64), (5, [float(k) for k in range(63)] + [None])]
    out = {r["vec_id"]: r["image"] for r in media.rendered(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding").collect()}
    assert media.read_pgm(out[1]).shape == (80, 80) and out[2] is None and out[3] is None and out[5] is None
    assert (media.read_pgm(out[4]) == 128).all()


def drawn(rng, n):
    out = []
    for v in rng.normal(0, 1, (n, 64)):
        out.append(media._box(np.kron((128 + 48 * (v - v.mean()) / v.std()).reshape(8, 8), np.ones((10, 10)))).clip(0, 255).astype(np.uint8))
    return out


def test_a_quarter_of_a_picture_keeps_its_corners():
    pictures = drawn(np.random.default_rng(5), 40)
    assert all(media.alike(media.describe(p[20:60, 20:60]), media.describe(p)) for p in pictures)


def doubled(p):
    """Twice the size, by straight lines between pixels."""
    for axis in (0, 1):
        n = p.shape[axis]
        at = ((np.arange(2 * n) + 0.5) / 2 - 0.5).clip(0, n - 1)
        low = np.floor(at).astype(int).clip(0, n - 2)
        share = np.expand_dims(at - low, 1 - axis)
        p = (1 - share) * p.take(low, axis) + share * p.take(low + 1, axis)
    return p


EDITS = {
    "cropped": lambda p, rng: p[7:60, 3:70],
    "a quarter": lambda p, rng: p[20:60, 20:60],
    "darker": lambda p, rng: p * 0.7 + 10,
    "turned": lambda p, rng: np.rot90(p),
    "noise": lambda p, rng: p + rng.normal(0, 4, p.shape),
    "doubled": lambda p, rng: doubled(p.astype(float)),
}


def test_edited_copies_like_brute_force(spark):
    """Links of each kind of edit against brute force over all pairs: nine tenths at least, and no class that brute force has not."""
    rng = np.random.default_rng(6)
    pictures, of = drawn(rng, 240), {}
    for j, edit in enumerate(EDITS.values()):
        for k in range(40 * j, 40 * j + 40):
            of[len(pictures)] = k
            pictures.append(edit(pictures[k], rng).clip(0, 255))
    data = [media.write_pgm(p) for p in pictures]
    own = [media.describe(media.read_pgm(b)) for b in data]
    links = {(i, j) for j in range(len(own)) for i in range(j) if media.alike(own[i], own[j]) or media.alike(own[j], own[i])}
    assert links <= {(k, c) for c, k in of.items()}
    out = media.copies(spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(data)], "doc_id long, image binary"), "doc_id", "image").collect()
    got = {r["doc_id"]: r["class_id"] for r in out}
    assert {(k, c) for c, k in got.items() if c != k} <= links
    for j, name in enumerate(EDITS):
        true = {(k, c) for k, c in links if 40 * j <= k < 40 * j + 40}
        assert len(true) >= 36, (name, len(true))
        assert sum(got[c] == k for k, c in true) >= 0.9 * len(true), name


def joined_rows(spark, work):
    """What work() returns, and the output rows of each join that it ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    seen = store.executionsCount()
    out = work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    rows, runs = [], store.executionsList()
    for k in range(seen, runs.size()):
        run = runs.apply(k).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if "Join" in node.name():
                metrics = node.metrics()
                for metric in (metrics.apply(j) for j in range(metrics.size())):
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        rows.append((node.name(), int(values.apply(metric.accumulatorId()).replace(",", ""))))
    return out, rows


def test_joins_of_images_make_no_row_for_each_key(spark):
    """Near copies share many keys; labels and sizes are joined by image, and all of them are still one class."""
    rng = np.random.default_rng(9)
    base = drawn(rng, 1)[0]
    data = [media.write_pgm((base + rng.normal(0, 2, base.shape)).clip(0, 255)) for _ in range(60)]
    keys = Counter(int(x) for b in data for x in media.constellations(*media.describe(media.read_pgm(b))))
    shared = sum(n for n in keys.values() if n > 1)
    df = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(data)], "doc_id long, image binary")
    out, rows = joined_rows(spark, lambda: media.copies(df, "doc_id", "image").collect())
    assert {(r["class_id"], r["class_size"]) for r in out} == {(0, 60)}
    leaders = 60 * 20  # an image meets some of the others as leaders
    assert rows and shared > 2 * leaders
    assert max(n for _, n in rows) < leaders, (shared, sorted(rows, key=lambda x: -x[1])[:4])


def test_drifting_families_like_brute_force(spark):
    rng = np.random.default_rng(21)
    rows = []
    for family in range(8):
        versions = [sentence(rng, 150)]
        for _ in range(59):
            versions.append(edited(rng, versions[rng.integers(max(0, len(versions) - 8), len(versions))], rng.integers(1, 4)))
        rows += [(family * 100 + k, " ".join(v)) for k, v in enumerate(versions)]
    df = frame(spark, rows)
    assert got_classes(neardup.classes(df)) == brute_classes(rows)


def test_common_phrases_make_no_run(spark):
    """Unique text made of phrases that stand in many texts, never 12 words together, loses nothing; a true repeat beside it goes."""
    rng, n = np.random.default_rng(33), 12
    phrases = [" ".join(sentence(rng, 5)) for _ in range(60)]
    rows = [(k, " ".join(phrases[j] for j in rng.choice(60, 40))) for k in range(60)]
    passage = " ".join(sentence(rng, 60))
    rows += [(100 + k, " ".join(sentence(rng, 50)) + " " + passage) for k in range(2)]
    texts = {i: t.split() for i, t in rows}
    at = Counter(tuple(w[k : k + n]) for w in texts.values() for k in range(len(w) - n + 1))
    for r in substring.report(frame(spark, rows).repartition(4)).collect():
        text = dict(rows)[r["doc_id"]]
        for run in filter(None, r["runs"].split(",")):
            words = text[slice(*map(int, run.split(":")))].split()
            windows = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
            backed = {j for k, w in enumerate(windows) if at[w] > 1 for j in range(k, k + n)}
            assert len(backed) == len(words), (r["doc_id"], words)
        if r["doc_id"] == 101:
            assert r["removed_words"] >= 40


def test_narrow_tables_are_few_files(spark, monkeypatch):
    """However many tasks make them, the tables of keys, pairs and labels are written as one file for so many rows, and the classes stay the same."""
    written, real = [], _common.materialize

    def counted(df, *files):
        out = real(df, *files)
        written.append((len(out.inputFiles()), out.columns))
        return out

    for module in (neardup, _components):
        monkeypatch.setattr(module, "materialize", counted)
    rows = corpus(5) + ROWS
    key, own = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set(key, "false")  # as where each task's part is large enough to stay alone
    try:
        df = frame(spark, rows).repartition(4)
        assert got_classes(neardup.classes(df)) == brute_classes(rows)
        kept = neardup.keep_first(df).count()
    finally:
        spark.conf.set(key, own)
    assert kept == len(brute_classes(rows))
    wide = [n for n, columns in written if {"bands", "keys", "token"} & set(columns)]
    narrow = [(n, columns) for n, columns in written if not {"bands", "keys", "token"} & set(columns)]
    assert len(wide) >= 4 and max(wide) > 1 and len(narrow) > 20
    assert all(n <= (3 if columns == ["key", "node", "weight"] else 1) for n, columns in narrow), narrow
