"""Language identification by interpolated Kneser-Ney character models.

One model for each label, over the letters of words between word marks, of order
ORDER. All n-grams of one order, of all languages, stand in one sorted array of
hashes; beside it a matrix holds each language's interpolated log probability. A
word's letters are looked up from the longest order down, whole blocks of words at
once; back-off weights come from the same kind of table over contexts. A text gets
the language of the lowest cross-entropy for each letter (its length normalises
it). Rejection is calibrated: a share of the sample is kept from the counts, and a
text is rejected if its cross-entropy lies beyond what those texts show.

Training reads a bounded sample: about SAMPLE rows of each label (by the hash of
the text, alike on every run), each with its whole text.

Rows: a null text or one without a letter is `und` with score 0 and rejected; a
null label is not learned from; without any labelled row all is `und`. Repeated
rows get the same result each; ties go to the first label in order.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import KEPT, U64, map_rows, powers, prepare, release

ORDER = 5
#: Labelled rows of each language that a model is fitted on, at about.
SAMPLE = 250
#: Of the sample, each KEPT_OUTth text calibrates; beyond their worst cross-entropy by MARGIN a text is rejected.
KEPT_OUT, MARGIN = 5, 1.6
#: Entries in a worker's memory of words.
WORDS = 300_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_START, _END = "\x01", "\x02"


def letters(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return [w for w in _WORD.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]


def _hash(gram: str) -> int:
    out = 0
    for c in gram:
        out = (out * 0x9E3779B97F4A7C15 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return out


class KneserNey:
    """Counts of one language; probability(gram) interpolates down to a uniform start."""

    def __init__(self, words: Counter, alphabet: int):
        count = [Counter() for _ in range(ORDER + 1)]
        for word, times in words.items():
            line = _START * (ORDER - 1) + word + _END
            for k in range(ORDER - 1, len(line)):
                count[ORDER][line[k - ORDER + 1 : k + 1]] += times
        for n in range(ORDER - 1, 0, -1):  # below the top: how many letters go before a gram
            for gram in count[n + 1]:
                count[n][gram[1:]] += 1
        self.count, self.alphabet = count, alphabet
        self.total: list[Counter] = [Counter() for _ in range(ORDER + 1)]
        self.kinds: list[Counter] = [Counter() for _ in range(ORDER + 1)]
        self.discount = [0.0] * (ORDER + 1)
        for n in range(1, ORDER + 1):
            once = twice = 0
            for gram, c in count[n].items():
                self.total[n][gram[:-1]] += c
                self.kinds[n][gram[:-1]] += 1
                once += c == 1
                twice += c == 2
            self.discount[n] = once / (once + 2 * twice) if once and twice else 0.5
        self.known: dict[str, float] = {}

    def backoff(self, context: str) -> float:
        n = len(context) + 1
        total = self.total[n].get(context)
        return self.discount[n] * self.kinds[n][context] / total if total else 1.0

    def probability(self, gram: str) -> float:
        if not gram:
            return 1 / self.alphabet
        p = self.known.get(gram)
        if p is None:
            n, total = len(gram), self.total[len(gram)].get(gram[:-1])
            lower = self.probability(gram[1:]) if n > 1 else 1 / self.alphabet
            p = lower if not total else max(self.count[n].get(gram, 0) - self.discount[n], 0) / total + self.backoff(gram[:-1]) * lower
            self.known[gram] = p
        return p


@dataclass
class Model:
    """Sorted hash arrays: grams[n] and contexts[n] with a row of log values for each language."""

    labels: list[str]
    grams: list[np.ndarray]
    log_p: list[np.ndarray]
    contexts: list[np.ndarray]
    log_back: list[np.ndarray]
    floor: np.ndarray
    limit: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        pad = _START * (ORDER - 1)
        line = pad.join(["", *(w + _END for w in words)])
        codes = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(U64) + U64(1)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        first = np.cumsum(size + ORDER - 1) - size
        at = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        p = powers(ORDER, 0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            hashes = [np.zeros(len(at), U64)]
            shorter = [np.zeros(len(at), U64)]
            for n in range(1, ORDER + 1):
                hashes.append(hashes[-1] + codes[at - n + 1] * p[n - 1])
                shorter.append(shorter[-1] + codes[at - n] * p[n - 1] if n < ORDER else shorter[-1])
        out = np.zeros((len(at), len(self.labels)), np.float32)
        open_ = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            if not len(open_):
                break
            found, row = _look(self.grams[n], hashes[n][open_])
            out[open_[found]] += self.log_p[n][row[found]]
            open_ = open_[~found]
            if len(open_):
                found, row = _look(self.contexts[n], shorter[n - 1][open_])
                out[open_[found]] += self.log_back[n][row[found]]
        out[open_] += self.floor
        return np.add.reduceat(out, np.cumsum(size) - size) if len(words) else out


def _look(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return (keys[row] == wanted if len(keys) else np.zeros(len(wanted), bool)), row


def fit(samples: dict[str, list[str]]) -> Model:
    """Models of all labels from their texts."""
    labels = sorted(samples)
    counted, held = {}, {}
    for label in labels:
        texts = sorted(set(samples[label]))
        held[label] = texts[::KEPT_OUT] if len(texts) >= KEPT_OUT else []
        kept = [t for k, t in enumerate(texts) if k % KEPT_OUT] if held[label] else texts
        counted[label] = Counter(w for t in kept for w in letters(t))
    alphabet = len({c for words in counted.values() for w in words for c in w}) + 2
    models = [KneserNey(counted[label], alphabet) for label in labels]
    empty = np.zeros(0, U64)
    made = Model(labels, [empty] * (ORDER + 1), [None] * (ORDER + 1), [empty] * (ORDER + 1), [None] * (ORDER + 1), np.full(len(labels), np.log(1 / alphabet), np.float32), np.full(len(labels), np.inf))
    for n in range(1, ORDER + 1):
        for names, keys, rows, value in ((sorted({g for m in models for g in m.count[n]}), made.grams, made.log_p, KneserNey.probability), (sorted({c for m in models for c in m.total[n]}), made.contexts, made.log_back, KneserNey.backoff)):
            hashes = np.array([_hash(g) for g in names], U64)
            order = np.argsort(hashes)
            keys[n] = hashes[order]
            rows[n] = np.log(np.array([[value(m, g) for m in models] for g in names]).reshape(len(names), len(models))).astype(np.float32)[order]
    for k, label in enumerate(labels):
        seen = [score(made, [t])[0] for t in held[label]]
        worst = [x[2] for x in seen if x[0] == label]
        made.limit[k] = MARGIN * max(worst) if worst else np.inf
    return made


class _Words(dict):
    """Words seen lately and the rows of their scores."""

    def __init__(self, model: Model):
        self.model, self.rows = model, np.zeros((0, len(model.labels)), np.float32)

    def learn(self, words: set[str]) -> None:
        if len(self) + len(words) > WORDS:
            self.clear()
            self.rows = self.rows[:0]
        new = list(words.difference(self))
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            self.update(zip(part, range(len(self.rows), len(self.rows) + len(part))))
            self.rows = np.concatenate((self.rows, self.model.word_scores(part)))


def score(model: Model, texts: list[str | None], memory: _Words | None = None) -> list[tuple[str, float, float, bool]]:
    """Label, score, cross-entropy and rejection of each text.

    The score is the posterior of the label with the evidence of at most 20 letters.
    """
    memory = memory if memory is not None else _Words(model)
    found = [letters(t) for t in texts]
    if model.labels:
        memory.learn({w for words in found for w in words})
    out = []
    for words in found:
        if not words or not model.labels:
            out.append((UNKNOWN, 0.0, float("nan"), True))
            continue
        n = sum(map(len, words)) + len(words)
        loss = -memory.rows[np.fromiter(map(memory.__getitem__, words), np.int64, len(words))].sum(0, dtype=np.float64) / n
        k = int(loss.argmin())
        posterior = 1 / np.exp((loss[k] - loss) * min(n, 20)).sum()
        out.append((model.labels[k], float(posterior), float(loss[k]), bool(loss[k] > model.limit[k])))
    return out


def train(df: DataFrame, text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from about `sample` rows of each label."""
    labelled = df.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).cast("string").alias("_label"), F.col(text_col).alias("_text"))
    counts = {r["_label"]: r["count"] for r in labelled.groupBy("_label").count().collect()}  # a row for each language
    if not counts:
        return fit({})
    place = F.pmod(F.xxhash64("_text"), F.lit(1 << 30))
    share: Column | None = None
    for label, n in counts.items():
        hit = (F.col("_label") == label) & (place < int(min(1.0, sample / n) * (1 << 30)))
        share = hit if share is None else share | hit
    samples: dict[str, list[str]] = defaultdict(list)
    for row in labelled.where(share).dropDuplicates().orderBy(place, "_text").collect():  # about `sample` rows of each label
        samples[row["_label"]].append(row["_text"])
    for label, n in counts.items():  # a rare label whose few texts the hash missed
        if not samples[label]:
            samples[label] = [r["_text"] for r in labelled.where(F.col("_label") == label).dropDuplicates().orderBy(place, "_text").limit(sample).collect()]
    return fit(samples)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's id, as text, has remainder 2 modulo 4 by crc32; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """held_out, lang_pred, score, cross_entropy and rejected of every text."""
    names = [id_col, "held_out", "lang_pred", "score", "cross_entropy", "rejected"]
    kinds = [df.schema[id_col].dataType, T.BooleanType(), T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()]
    shared = df.sparkSession.sparkContext.broadcast(model)  # as large as the sample's n-grams

    def make():
        memory = _shared_memory(shared)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = score(memory.model, batch.column(2).to_pylist(), memory)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.float64(), pa.float64(), pa.bool_())))], names=names)

        return step

    source = df.select(F.col(id_col).alias("_id"), held_out(id_col).alias("_held"), F.col(text_col).alias("_text"))
    return map_rows(source, ["_id", "_held", "_text"], make, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]), keeps="langid")


_memories: dict[int, _Words] = KEPT.setdefault("langid", {})


def _shared_memory(shared) -> _Words:
    """One memory for each model and worker process."""
    key = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) else id(shared)
    model = shared.value
    release("langid")
    if key not in _memories or _memories[key].model is not model:
        _memories.clear()
        _memories[key] = _Words(model)
    return _memories[key]


def keep_identified(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows and columns of df whose text has a language and is not rejected."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.BooleanType())
    def accepted(texts):
        import pandas as pd

        memory = _shared_memory(shared)
        return pd.Series([not x[3] for x in score(memory.model, texts.where(texts.notna(), None).tolist(), memory)], dtype=bool)

    prepare(df.sparkSession)
    return df.where(accepted(F.col(text_col)))
