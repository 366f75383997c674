"""BPE encoding and decoding by forced-boundary splitting.

A merge can only build tokens of the vocabulary, so two neighbouring bytes that
stand side by side inside no token are never joined: the place between them is a
certain cut. Each pre-token is cut at all such places, the fragments are encoded
on their own (each distinct fragment once, from a bounded memory) and their ids
are concatenated.

Rows: a null text counts as empty and has no tokens; every row, repeated ids
included, gives one row; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import KEPT, map_rows

#: Entries that the memories of chunks and of fragments may hold before they start anew.
PIECES, FRAGMENTS = 450_000, 150_000
#: Pre-tokens whose ids are put together at a time; rows and bytes of text that are encoded together at most.
_RUNS, GATHER_ROWS, GATHER_BYTES = 1 << 20, 1024, 4 << 20
#: What sends a text the slow way: letters beyond U+024F, blanks other than these, the one letter that grows in lower case, and what may begin a special token.
_ODD = "[^\t\n\r -~¡-įı-ɏ]|<[|]"
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The normaliser and the pre-tokenizer that the quick way knows, as their files state them.
_NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PIECES = regex.compile(_CUT)
#: Printable characters below U+0250 are stable under NFC and have no white space among them.
_PLAIN = re.compile("[!-~¡-ɏ]+")
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]
_BLANKS = re.compile("[ \n\t\r]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class _Memory(dict):
    """A bounded memory: what a full young generation holds grows old, and goes unless it is asked for again."""

    def __init__(self, make, limit):
        self.make, self.limit, self.old = make, limit // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """A byte-level BPE with a mark at word ends, read from a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.library = Tokenizer.from_file(path)
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.vocab = vocab
        self.closing = models.BPE(vocab, merges, end_of_word_suffix=self.suffix) if self.suffix else models.BPE(vocab, merges)
        self.inner = models.BPE(vocab, merges)
        self.letters = byte_letters()
        self.tokens = [""] * (max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        inside = set()
        for token in vocab:
            body = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) and token != self.suffix else token
            inside.update(zip(body, body[1:]))
        self.inside = {a + b for a, b in inside}
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        shown = json.dumps(spec.get("pre_tokenizer") or {})
        self.known = spec.get("normalizer") == _NORMALISER and json.dumps(_CUT)[1:-1] in shown and all("<|" in t for t in self.special)
        self.pieces = _Memory(self._known_piece, PIECES)
        self.fragments = _Memory(self._fragment, FRAGMENTS)

    def cuts(self, letters: str) -> list[str]:
        """Fragments of a pre-token between its certain cuts."""
        pairs = list(map(add, letters, letters[1:]))
        if self.inside.issuperset(pairs):
            return [letters]
        out, at = [], 0
        for k, pair in enumerate(pairs, 1):
            if pair not in self.inside:
                out.append(letters[at:k])
                at = k
        out.append(letters[at:])
        return out

    def _fragment(self, key: str) -> bytes:
        """Ids of a fragment; a key that ends in a blank stands at the end of its word."""
        found = self.closing.tokenize(key[:-1]) if key[-1] == " " else self.inner.tokenize(key)
        return _PACK[len(found)](*[t.id for t in found]) if len(found) < len(_PACK) else np.array([t.id for t in found], "<u4").tobytes()

    def _known_piece(self, piece: str) -> bytes:
        return self._piece(piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()]))

    def _piece(self, letters: str) -> bytes:
        """Ids of a pre-token, given as the letters of its bytes."""
        if len(letters) == 1:
            return self.fragments[letters + " "]
        parts = self.cuts(letters)
        parts[-1] += " "
        return b"".join([self.fragments[p] for p in parts])

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run without blanks and without special tokens."""
        if not chunk:
            return b""
        if self.known and _PLAIN.fullmatch(chunk):
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(chunk.lower())))
        shown = self.library.normalizer.normalize_str(chunk) if self.library.normalizer else chunk
        return b"".join(self._piece(p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(shown))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.special_at is not None and (parts := self.special_at.split(text))[1:]:
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._chunk, _BLANKS.split(text) if self.known else [text]))

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """encode of every text (null: empty).

        Texts of common letters are lowered and cut into pre-tokens by Arrow, all
        together, and each distinct pre-token is looked up once; others go one by one.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) if self.known else np.ones(len(texts), bool)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(plain), _CUT, r"\0 "))
        coded = lists.flatten().dictionary_encode()
        runs = list(map(self.pieces.__getitem__, coded.dictionary.to_pylist()))
        size = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(runs), "<u4")
        which = coded.indices.to_numpy()
        parts = []
        for at in range(0, len(which), _RUNS):
            own = which[at : at + _RUNS]
            n = size[own]
            parts.append(flat[np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        ids = np.concatenate([np.zeros(0, "<u4"), *parts])
        words = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
        edge = np.concatenate(([0], np.cumsum(size[which])))[words].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(edge, edge[1:])]
        for k in np.flatnonzero(odd).tolist():
            out[k] = self.encode(texts[k].as_py())
        return out

    def decode(self, ids: bytes) -> str:
        """The tokens joined by blanks, as the file's model without a decoder does."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[str, Encoder] = KEPT.setdefault("bpe", {})


def encoder(path: str) -> Encoder:
    """One encoder for each file and process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text: id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids also ids and decoded."""
    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields += [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("decoded", T.StringType())]

    def make():
        own = encoder(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = own.encode_all(batch.column(1))
            texts = list(map(own.decode, ids))
            out = [
                batch.column(0),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts]),
            ]
            if keep_ids:
                out += [pa.array([np.frombuffer(x, "<u4").astype(np.int64).tolist() for x in ids], pa.list_(pa.int64())), pa.array(texts)]
            return pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

        return step

    return map_rows(df, [id_col, text_col], make, T.StructType(fields), keeps="bpe", gather=(GATHER_ROWS, GATHER_BYTES))
