"""Language identification and LM scoring against plain models."""

import math
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import bpe, langid, lmscore
from corpusloom.llm.queries import START_OF_TEXT, tokenizer_path

from .cases import ROWS, frame, ids, want_ids

SF = "/root/testdata/sf0.01"
WORDS = {"aa": "kata rana mado sila pore", "bb": "streng schlicht zwischen pfad wurzel", "cc": "quey ouvreaux laitue mieux jardin"}


def texts(label, n, seed=0):
    rng = np.random.default_rng(seed)
    w = WORDS[label].split()
    return [" ".join(rng.choice(w, 12)) + f" {k}" for k in range(n)]


class Plain:
    """Interpolated Kneser-Ney by its definition, without hashing or arrays."""

    def __init__(self, words, alphabet):
        n = langid.ORDER
        self.n, self.alphabet = n, alphabet
        self.c = {n: Counter()}
        for w in words:
            line = "\x01" * (n - 1) + w + "\x02"
            for k in range(n - 1, len(line)):
                self.c[n][line[k - n + 1 : k + 1]] += 1
        for m in range(n - 1, 0, -1):
            self.c[m] = Counter(g[1:] for g in self.c[m + 1])
        self.d = {}
        for m in self.c:
            ones, twos = sum(v == 1 for v in self.c[m].values()), sum(v == 2 for v in self.c[m].values())
            self.d[m] = ones / (ones + 2 * twos) if ones and twos else 0.5

    def p(self, gram):
        if not gram:
            return 1 / self.alphabet
        m, context = len(gram), gram[:-1]
        after = {g: v for g, v in self.c[m].items() if g[:-1] == context}
        lower = self.p(gram[1:])
        if not after:
            return lower
        total = sum(after.values())
        return max(self.c[m].get(gram, 0) - self.d[m], 0) / total + self.d[m] * len(after) / total * lower


def test_word_scores_equal_the_plain_model():
    samples = {x: texts(x, 4) for x in WORDS}
    model = langid.fit({x: samples[x] for x in WORDS})
    alphabet = None
    counted = {x: [w for t in sorted(set(samples[x])) for w in langid.letters(t)] for x in WORDS}
    alphabet = len({c for ws in counted.values() for w in ws for c in w}) + 2
    plain = {x: Plain(counted[x], alphabet) for x in WORDS}
    words = ["kata", "pfad", "unseen", "mieux", "z", "kat", "wurzelrana"]
    got = model.word_scores(words)
    for k, w in enumerate(words):
        line = "\x01" * (langid.ORDER - 1) + w + "\x02"
        for j, x in enumerate(model.labels):
            want = sum(math.log(plain[x].p(line[i - langid.ORDER + 1 : i + 1])) for i in range(langid.ORDER - 1, len(line)))
            assert got[k, j] == pytest.approx(want, abs=2e-3)


def test_probabilities_sum_to_one():
    words = Counter(w for t in texts("aa", 5) for w in langid.letters(t))
    alphabet = sorted({c for w in words for c in w} | {"\x02", "?"})
    model = langid.KneserNey(words, len(alphabet))
    for context in ("\x01\x01\x01k", "ata\x01"[:4], "rana", ""):
        assert sum(model.probability(context + c) for c in alphabet) == pytest.approx(1, abs=1e-6)


def test_predictions_of_all_rows(spark):
    rows = [(100 + k, t) for k, t in enumerate(texts("aa", 20))]
    docs = frame(spark, ROWS + rows)
    model = langid.train(docs)
    out = langid.predict(docs, model)
    assert ids(out) == want_ids(ROWS + rows)
    for r in out.collect():
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (3, 4, 5, 6):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert langid.predict(frame(spark, []), model).count() == 0
    none = langid.predict(docs, langid.train(docs.where("lang = 'no such'"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_held_out_is_crc32_of_the_id(spark):
    import zlib

    docs = frame(spark, [(k, "x") for k in range(200)])
    for r in docs.select("doc_id", langid.held_out().alias("h")).collect():
        assert r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.predict(docs, langid.train(docs.where(~langid.held_out()))).where("held_out")
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.95


def test_rejection_keeps_clean_texts_and_drops_foreign_ones(spark):
    rows = [(k, t) for k, t in enumerate(texts("aa", 40) + texts("bb", 40, 1))]
    docs = frame(spark, rows).selectExpr("doc_id", "text", "if(doc_id < 40, 'aa', 'bb') as lang")
    model = langid.train(docs)
    assert langid.keep_identified(docs, model).count() >= 78
    strange = frame(spark, [(1, "xqzvj wwyyq jjxxq qvqvx"), (2, "12 34"), (3, None)], clash=False)
    assert langid.keep_identified(strange, model).count() == 0


def test_scores_equal_models_by_definition(spark):
    rows = ROWS + [(50 + k, t) for k, t in enumerate(texts("aa", 6) + texts("bb", 6))]
    docs = frame(spark, rows)
    wanted = {1, 50, 51, 52, 53}
    target = spark.createDataFrame([(k,) for k in [*wanted, 50]], "doc_id long")
    got = lmscore.score(docs, target, tokenizer_path(), START_OF_TEXT).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == want_ids(rows)
    own = bpe.encoder(tokenizer_path())
    tokens = [(i, np.frombuffer(own.encode(t or ""), "<u4").tolist()) for i, t in rows]
    size = len(own.tokens)

    def model(chosen):
        one, two = Counter(), Counter()
        docs_with = 0
        for line in chosen:
            docs_with += bool(line)
            one.update(line)
            two.update(zip([START_OF_TEXT, *line[:-1]], line))
        total = sum(one.values())

        def loss(a, b):
            p1 = (one[b] + lmscore.ADD) / (total + lmscore.ADD * size)
            seen = one[a] + (docs_with if a == START_OF_TEXT else 0)
            return -math.log((two[a, b] + lmscore.WEIGHT * p1) / (seen + lmscore.WEIGHT))

        return loss

    background, good = model([t for _, t in tokens]), model([t for i, t in tokens if i in wanted])
    want = {}
    for i, line in tokens:
        if line:
            pairs = list(zip([START_OF_TEXT, *line[:-1]], line))
            want.setdefault((i, len(line)), tuple(sum(f(*p) for p in pairs) / len(line) for f in (good, background)))
    for r in got:
        if not r["n_tokens"]:
            assert r["score"] is None and r["loss_target"] is None
            continue
        t, b = want[r["doc_id"], r["n_tokens"]]
        assert r["loss_target"] == pytest.approx(t, abs=2e-3) and r["loss_background"] == pytest.approx(b, abs=2e-3)
        assert r["score"] == pytest.approx(t - b, abs=4e-3)


def test_lm_scores_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long")
    assert lmscore.score(frame(spark, []), empty, tokenizer_path(), START_OF_TEXT).count() == 0
    assert lmscore.score(frame(spark), empty, tokenizer_path(), START_OF_TEXT).count() == len(ROWS)


def test_bigrams_keep_their_own_counts(spark):
    """Losses are exact however many bigrams there are."""
    own = bpe.encoder(tokenizer_path())
    rng = np.random.default_rng(12)
    words = ["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (60 * 1500, 5))]
    rows = [(k, " ".join(words[k * 1500 : (k + 1) * 1500])) for k in range(60)]
    lines = [np.frombuffer(own.encode(t), "<u4").tolist() for _, t in rows]
    one, two = Counter(), Counter()
    for line in lines:
        one.update(line)
        two.update(zip([START_OF_TEXT, *line[:-1]], line))
    total, size = sum(one.values()), len(own.tokens)
    want = {}
    for (i, _), line in zip(rows, lines):
        seen = lambda a: one[a] + (len(lines) if a == START_OF_TEXT else 0)
        p1 = lambda b: (one[b] + lmscore.ADD) / (total + lmscore.ADD * size)
        want[i] = sum(-math.log((two[a, b] + lmscore.WEIGHT * p1(b)) / (seen(a) + lmscore.WEIGHT)) for a, b in zip([START_OF_TEXT, *line[:-1]], line)) / len(line)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lmscore.score(df, df.select("doc_id"), tokenizer_path(), START_OF_TEXT).collect()
    assert len(got) == len(rows) and len(two) > 20_000
    for r in got:
        assert r["loss_background"] == pytest.approx(want[r["doc_id"]], abs=1e-9) and r["loss_target"] == pytest.approx(want[r["doc_id"]], abs=1e-9)
