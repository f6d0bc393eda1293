"""Secret scans confirmed by structure.

Three plain rules give the base spans (assignments, access ids, long hex runs). Beyond them
a candidate is reported only after its bytes were decoded and parsed: DER private keys whose
nested lengths fit exactly (PKCS#8, PKCS#1, SEC 1), OpenSSH private keys with their length-prefixed
fields, and signed tokens whose header, payload and signature agree.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import slices

ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("private_key", "signed_token")
KINDS = BASE_KINDS + ADDED_KINDS

PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([^-]*)-----END \1-----")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}(?:\r?\n[A-Za-z0-9+/_-]+)*={0,2}")
HEX_ANY = re.compile(r"(?:[0-9a-f]{2}){24,}|(?:[0-9A-F]{2}){24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")

# Rows that may hold any span; a superset of what the patterns above find.
MAYBE = r"(?i)password|passwd|secret|token|api_?key|akia|[0-9a-f]{24}|[a-z0-9+/_-]{40}|-----begin|eyj"

SPAN = "struct<kind:string,start:int,end:int>"

# Signature bytes of each signing algorithm; RSA signatures are as long as the key.
SIGNATURE_BYTES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
RSA_ALGORITHMS = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of the consecutive DER values that fill `data` exactly, else None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size = int.from_bytes(data[at : at + width], "big")
            if size < 0x80 or (width > 1 and not data[at]):
                return None
            at += width
        if at + size > len(data):
            return None
        items.append((tag, data[at : at + size]))
        at += size
    return items


def is_private_der(data: bytes) -> bool:
    """True for a complete PKCS#8, encrypted PKCS#8, PKCS#1 or SEC 1 private key."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    items = der_items(outer[0][1])
    if not items:
        return False
    tags = [tag for tag, _ in items]
    if tags[:2] == [0x30, 0x04] and len(items) == 2:  # encrypted: algorithm, data
        inner = der_items(items[0][1])
        return bool(inner) and inner[0][0] == 0x06 and len(items[1][1]) >= 32
    if tags[0] != 0x02 or len(items[0][1]) != 1:
        return False
    version = items[0][1][0]
    if tags[1:3] == [0x30, 0x04] and version in (0, 1):
        algorithm, key = der_items(items[1][1]), der_items(items[2][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and bool(key) and len(items[2][1]) >= 16
    if version == 0 and tags == [0x02] * 9:
        return len(items[1][1]) >= 32
    if version == 1 and tags[1:2] == [0x04] and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return 20 <= len(items[1][1]) <= 66
    return False


def is_private_openssh(data: bytes) -> bool:
    """True if the length-prefixed fields of an OpenSSH private key file fit."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, fields = len(magic), []

    def take() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    for _ in range(3):  # cipher, key derivation, its options
        if at + 4 > len(data) or (field := take()) is None:
            return False
        fields.append(field)
    if at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16:
        return False
    for _ in range(keys + 1):  # public keys, then the private section
        if at + 4 > len(data) or (field := take()) is None:
            return False
    return at == len(data) and len(field) >= 16


def decode64(text: str) -> bytes | None:
    body = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_private_key(data: bytes | None) -> bool:
    return bool(data) and (is_private_der(data) or is_private_openssh(data))


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    parts = [decode64(part) for part in (header, payload, signature)]
    if None in parts:
        return False
    try:
        head, body = json.loads(parts[0]), json.loads(parts[1])
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict):
        return False
    algorithm = head.get("alg")
    if algorithm in RSA_ALGORITHMS:
        return len(parts[2]) >= 128
    return isinstance(algorithm, str) and SIGNATURE_BYTES.get(algorithm) == len(parts[2])


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m.group()) >= 20]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    keys: list[tuple[int, int]] = []
    for m in PEM.finditer(text):
        # Old armour may carry header lines with a colon, and then an encrypted, opaque body.
        body = "\n".join(line for line in m.group(2).splitlines() if ":" not in line)
        data = decode64(body)
        if is_private_key(data) or (data and ":" in m.group(2) and len(data) % 8 == 0 and len(data) >= 64):
            keys.append(m.span())
    for m in BASE64.finditer(text):
        # A DER sequence or the OpenSSH magic fixes the first character.
        if m.group()[0] in "Mb" and not any(a <= m.start() < b for a, b in keys):
            first = re.match(r"[A-Za-z0-9+/_-]+={0,2}", m.group())
            whole = is_private_key(decode64(m.group()))
            if whole or is_private_key(decode64(first.group())):
                keys.append((m.start(), m.end() if whole else m.start() + first.end()))
    for m in HEX_ANY.finditer(text):
        if is_private_key(bytes.fromhex(m.group())):
            keys.append(m.span())
    spans += [("private_key", a, b) for a, b in keys]
    spans += [("signed_token", *m.span()) for m in TOKEN.finditer(text) if is_signed_token(*m.groups())]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _spans_of(texts: pa.Array) -> list[list[tuple[str, int, int]]]:
    maybe = pc.fill_null(pc.match_substring_regex(texts, MAYBE), False).to_numpy(zero_copy_only=False)
    found: list[list[tuple[str, int, int]]] = [[] for _ in range(len(texts))]
    for i in np.flatnonzero(maybe).tolist():
        found[i] = find_secrets(texts[i].as_py())
    return found


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (array of kind, start, end).

    Null and empty texts have no spans. Texts are scanned whole; two kinds may cover the same
    characters; repeated rows and null ids stay rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches, "text"):
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in _spans_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id long, spans array<{SPAN}>")


def joined(spans: Column) -> Column:
    """The spans as kind:start:end, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the base spans, and all spans as a string."""
    spans = F.col("spans")
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return scanned.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one marker."""
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, start, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1][1] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[at:start], f"[{kind}]"]
        at, k = end, k + 1
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """`docs` with the secrets in `text_col` replaced by markers and `length_col`, if there, kept true.

    Rows without secrets, null texts among them, stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = batch.column(text_col)
            found = _spans_of(texts)
            if any(found):
                values = texts.to_pylist()
                changed = [redacted(v, s) if s else v for v, s in zip(values, found, strict=True)]
                names = batch.schema.names
                batch = batch.set_column(names.index(text_col), batch.schema.field(text_col), pa.array(changed, texts.type))
                if length_col in names:
                    old = batch.column(length_col)
                    sizes = [len(c) if s else o for c, s, o in zip(changed, found, old.to_pylist(), strict=True)]
                    batch = batch.set_column(names.index(length_col), batch.schema.field(length_col), pa.array(sizes, old.type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
