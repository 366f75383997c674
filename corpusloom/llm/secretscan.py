"""Secret scans with structural confirmation.

The base patterns give spans as they are. Beyond them, runs of base64, base64url
or hex are decoded and read: nested DER lengths must fill the bytes (private
keys, with or without PEM armour), length-prefixed fields must name an SSH key,
and a signed token must have a JSON header with an algorithm and a JSON payload.
Only what reads to its end is reported.

Rows: a null text counts as empty and has no spans; repeated rows get the same
result each; an empty table gives an empty table. Texts are scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_rows, prepare, release

KINDS = ("assign", "access", "hex", "der", "jwt", "pem", "ssh")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
_KEYWORDS = ("passw", "secret", "token", "api")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s\\]+?)-----END \1-----")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")
_SSH = (b"ssh-rsa", b"ssh-ed25519", b"ssh-dss", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")


def decoded(run: str) -> bytes | None:
    """The bytes of a base64 or base64url run, padded or not."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of consecutive DER items that fill data exactly, else None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or at + more > len(data):
                return None
            size = int.from_bytes(data[at : at + more], "big")
            at += more
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE that fills data and holds what a private key holds: a small version and then key parts."""
    outer = der_items(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    items = der_items(outer[0][1])
    if not items or len(items) < 2 or items[0][0] != 0x02 or items[0][1] not in (b"\0", b"\1"):
        return False
    tags = [t for t, _ in items[1:]]
    if tags[:2] == [0x30, 0x04]:  # PKCS 8: algorithm, wrapped key
        algorithm = der_items(items[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06
    if tags and tags[0] == 0x04:  # SEC 1: key bytes
        return len(items[1][1]) in (28, 32, 48, 66)
    return len(tags) >= 5 and all(t == 0x02 for t in tags)  # PKCS 1: integers


def is_ssh_key(data: bytes) -> bool:
    """OpenSSH's private container, or length-prefixed fields that fill data and begin with a key type."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    at, fields = 0, []
    while at + 4 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        at += 4
        if n > len(data) - at:
            return False
        fields.append(data[at : at + n])
        at += n
    return at == len(data) and len(fields) >= 2 and fields[0] in _SSH


def is_token(head: str, body: str) -> bool:
    """A signed token: its header is a JSON object with a text `alg`, its payload a JSON object."""
    parts = [decoded(head), decoded(body)]
    if None in parts:
        return False
    try:
        header, payload = (json.loads(p) for p in parts)
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three base patterns, kind by kind."""
    out = []
    low = text.lower()
    if any(map(low.__contains__, _KEYWORDS)):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans that only their structure shows to be keys or tokens."""
    out = []
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            data = decoded(re.sub(r"\\n|\\r|\s", "", m[2]))
            if data and (is_der_key(data) or is_ssh_key(data) or ("ENCRYPTED" in m[1] and data[:1] == b"\x30" and der_items(data) is not None)):
                out.append(("pem", *m.span()))
    if "eyJ" in text:
        out += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_token(m[1], m[2])]
    for m in _B64.finditer(text):
        data = decoded(m[0])
        if data and (is_der_key(data) or is_ssh_key(data)):
            out.append(("der" if data[:1] == b"\x30" else "ssh", *m.span()))
    for m in _HEX_KEY.finditer(text):
        data = bytes.fromhex(m[0])
        if is_der_key(data) or is_ssh_key(data):
            out.append(("der" if data[:1] == b"\x30" else "ssh", *m.span()))
    inside = [(s, e) for k, s, e in out if k == "pem"]
    return [x for x in out if x[0] == "pem" or not any(s <= x[1] and x[2] <= e for s, e in inside)]


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans by start, then kind."""
    return sorted(set(base_spans(text) + confirmed_spans(text)), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each (merged) span replaced by [secret]; of an assignment the name stays."""
    parts = sorted((ASSIGN.match(text, s).start(2) if k == "assign" else s, e) for k, s, e in spans)
    out, at = [], 0
    for k, (start, end) in enumerate(parts):
        if k and start < at:  # overlaps what is already replaced
            at = max(at, end)
            continue
        out += [text[at:start], "[secret]"]
        at = end
    return "".join(out) + text[at:]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_assign, n_access, n_hex, base_sha256 and all spans of every text."""
    names = [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    kinds = [df.schema[id_col].dataType, *[T.LongType()] * 3, *[T.StringType()] * 2]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch.column(1).to_pylist():
                found = find(text or "")
                base = [x for x in found if x[0] in KINDS[:3]]
                count = [sum(x[0] == k for x in base) for k in KINDS[:3]]
                rows.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
            cols = list(zip(*rows)) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names=names)

        return step

    return map_rows(df, [id_col, text_col], make, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with secrets in the text replaced; a null text stays null."""

    @F.pandas_udf(T.StringType())
    def clean(texts):
        release()
        return texts.map(lambda t: redacted(t, s) if t and (s := find(t)) else t)

    prepare(df.sparkSession)
    return df.withColumn(text_col, clean(F.col(text_col)))
