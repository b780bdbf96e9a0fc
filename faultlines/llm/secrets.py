"""Secret scans: base patterns, then structural confirmation of encoded candidates.

Base kinds are ``assign``, ``access`` and ``hex``. The confirmation decodes base64 and hexadecimal runs and adds

- ``jwt``: a signed-token triple whose header and payload decode to JSON objects and whose header names ``alg``;
- ``pem``: an armoured block whose body decodes to a well-nested key encoding, or whose headers name a cipher and its
  start value and whose body decodes to whole cipher blocks; line ends may be escaped, as in JSON strings;
- ``key``: a bare run that decodes to a key: nested DER lengths that fill their parents exactly, or the
  length-prefixed strings of an OpenSSH key;
- ``wrapped``: a run that decodes to printable ASCII which itself holds an assign or access secret.

Spans are code-point offsets, end exclusive. Null and empty texts give no spans; repeated rows are scanned each on
its own; texts of any length are scanned whole. Only the id and text columns are read; extra columns are ignored by
``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlines.llm.common import bounded_batches, trimmed

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "jwt", "pem", "key", "wrapped")
RANK = {k: i for i, k in enumerate(KINDS)}

_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:(?<=\\)[nrt])?([A-Za-z0-9+/_-]{24,}={0,2})")  # an escaped line end is not part of a run
_HEXRUN = re.compile(r"(?<![0-9A-Za-z])(?:0[xX])?((?:[0-9A-Fa-f]{2}){16,})(?![0-9A-Za-z])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]*)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*KEY[A-Z0-9 ]*)-----((?:[^-]|-(?!----))*+)-----END \1-----")
_ESCAPED = re.compile(r"\\+(?:[nrt]|u000[AaDd9])")
_HEADER = re.compile(
    r"\s*(?:Proc-Type:[\x20\t]*[0-9]+,[A-Z-]+(?=\s)|DEK-Info:[\x20\t]*([A-Z0-9-]+),([0-9A-Fa-f]+)(?=\s)|[A-Za-z][A-Za-z0-9-]*:[^\r\n]*[\r\n])"
)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base kind that are long enough."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def _decode(run: str) -> bytes:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _nested(data: bytes, depth: int = 0) -> bool:
    """DER elements fill data exactly; constructed ones are filled by their own elements."""
    at = 0
    while at < len(data):
        if at + 2 > len(data):
            return False
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or at + more > len(data):
                return False
            size = int.from_bytes(data[at : at + more], "big")
            at += more
        if at + size > len(data):
            return False
        if tag & 0x20 and (depth > 12 or not _nested(data[at : at + size], depth + 1)):
            return False
        at += size
    return True


def _ssh(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    at = len(magic) if data.startswith(magic) else 0
    parts = 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            break
        parts += 1
        if parts == 1 and not at and not data[4 : 4 + size].startswith((b"ssh-", b"ecdsa-", b"sk-")):
            return False
        at += 4 + size
    return parts >= 2


def is_key(data: bytes) -> bool:
    """A key encoding: an outer DER sequence that starts with an integer or a sequence and nests exactly, or an
    OpenSSH blob."""
    if len(data) >= 24 and data[0] == 0x30 and _nested(data):
        head = 2 + (data[1] & 0x7F if data[1] & 0x80 else 0)
        return data[head : head + 1] in (b"\x02", b"\x30")
    return len(data) >= 24 and (data.startswith(b"openssh-key-v1\0") or data[:3] == b"\0\0\0") and _ssh(data)


def is_armoured(body: str) -> bool:
    """The body of an armoured block holds a key encoding, or an encrypted one under headers that say how."""
    body = _ESCAPED.sub("\n", body).replace("\\/", "/")
    at, cipher = 0, None
    while m := _HEADER.match(body, at):
        cipher = m.groups() if m[1] else cipher
        at = m.end()
    data = _decode("".join(body[at:].replace("\\", " ").split()))
    if cipher:
        size = len(cipher[1]) // 2
        return len(data) >= 24 and size in (8, 16) and (not cipher[0].endswith("CBC") or len(data) % size == 0)
    return is_key(data)


def is_token(header: str, payload: str) -> bool:
    try:
        head, body = json.loads(_decode(header)), json.loads(_decode(payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def _wrapped(data: bytes) -> bool:
    if len(data) < 12 or not data.isascii() or any(b < 32 and b not in (9, 10, 13) or b == 127 for b in data):
        return False
    text = data.decode("ascii")
    return any(k != "hex" for k, _, _ in base_spans(text))


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Encoded candidates whose decoded structure holds."""
    found = []
    if "eyJ" in text:
        found += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_token(m[1], m[2])]
    if "-----BEGIN " in text:
        found += [("pem", *m.span()) for m in _PEM.finditer(text) if is_armoured(m[2])]
    for m in _B64.finditer(text):
        data = _decode(m[1])
        if is_key(data):
            found.append(("key", *m.span(1)))
        elif _wrapped(data):
            found.append(("wrapped", *m.span(1)))
    for m in _HEXRUN.finditer(text):
        data = bytes.fromhex(m[1])
        if is_key(data):
            found.append(("key", *m.span(1)))
        elif _wrapped(data):
            found.append(("wrapped", *m.span(1)))
    return found


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All spans by start, then kind in the order of KINDS, then end."""
    return sorted(set(base_spans(text) + confirmed_spans(text)), key=lambda s: (s[1], RANK[s[0]], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, mark: str) -> str:
    """The text with every maximal run of covered code points replaced by mark."""
    out, at = [], 0
    for _, a, b in spans_of(text):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, all spans as an array of (kind, start, end)."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                spans = [[dict(zip(("kind", "start", "end"), s)) for s in spans_of(t or "")] for t in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(spans, kind)], [id_col, "spans"])

    return bounded_batches(docs).select(id_col, text_col).mapInArrow(trimmed(run), schema)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All columns and rows, each secret replaced by mark; null texts stay null."""
    names = docs.columns
    where = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                texts = [None if t is None else redacted(t, mark) for t in piece.column(where).to_pylist()]
                columns = list(piece.columns)
                columns[where] = pa.array(texts, piece.schema.field(where).type)
                yield pa.RecordBatch.from_arrays(columns, schema=piece.schema)

    return bounded_batches(docs).mapInArrow(trimmed(run), docs.schema)


def digests(spans: DataFrame) -> DataFrame:
    """Counts and joined spans of the rows of ``scan``."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return spans.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
    )


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
