"""Secrets in texts: pattern matches, and candidates confirmed by their structure.

Three kinds are patterns alone: ``assign`` (a value given to a password-like name),
``access`` (access key ids) and ``hex`` (long runs of hex digits). Three kinds are only
reported once their bytes parse:

- ``token``: a signed token whose first two parts decode to JSON objects, the first
  with an ``alg``, and whose third part decodes to a signature;
- ``pem``: a private key between BEGIN and END lines whose body decodes and parses;
- ``key``: base64 or hex digits, in one run or wrapped over lines of equal length, that
  decode to a private key or to a text that holds a PEM key.

A private key parses if it is DER whose nested lengths fill their parents exactly and
whose elements are those of a known key type, or an OpenSSH key whose length-prefixed
fields fill it exactly.

Matching is a function of one text; nothing is shuffled. Whole texts are searched, in
time that grows with their length: marks, runs and lines are found in one pass each and a
body ends at the next mark, so no part of a text is decoded more than a few times.

Edge cases: a null text has no spans and stays null when redacted; an empty one has
none. Spans count code points, end exclusive, sorted by start and then kind. Repeated
rows each get their result. Other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KINDS = ("assign", "access", "hex", "token", "pem", "key")
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]{16,}")
_MARK = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
#: The shortest key that parses takes 27 bytes of DER, so 36 digits of base64.
_RUN = 36
_BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{_RUN},}}={{0,2}}")
_LINE = re.compile(r"^[ \t]*([A-Za-z0-9+/]+={0,2})[ \t\r]*$", re.MULTILINE)
#: The shortest signed token that its pattern takes, dots included.
_SIGNED_LENGTH = 32
_HEX_BYTES = re.compile(r"(?:[0-9a-f]{2})+|(?:[0-9A-F]{2})+")
_PEM_HEADER = re.compile(r"^[A-Za-z-]+: .*$", re.MULTILINE)

_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30


def _decode64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) elements that fill ``data`` exactly, or None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length == 0x80 or length > 0x84:
            return None
        if length > 0x80:
            n = length & 0x7F
            if at + n > len(data) or data[at] == 0:
                return None
            length = int.from_bytes(data[at : at + n], "big")
            if length < 0x80:
                return None
            at += n
        if at + length > len(data):
            return None
        out.append((tag, data[at : at + length]))
        at += length
    return out


def is_der_private_key(data: bytes) -> bool:
    """PKCS#8 (plain or encrypted), PKCS#1, SEC1 or DSA private keys."""
    outer = der_elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != _SEQUENCE:
        return False
    parts = der_elements(outer[0][1])
    if not parts:
        return False
    tags = [tag for tag, _ in parts]

    def algorithm(content: bytes) -> bool:
        inner = der_elements(content)
        return bool(inner) and inner[0][0] == _OID

    if tags[:3] == [_INTEGER, _SEQUENCE, _OCTETS]:
        return parts[0][1] in (b"\0", b"\1") and algorithm(parts[1][1])
    if tags == [_SEQUENCE, _OCTETS]:
        return algorithm(parts[0][1]) and len(parts[1][1]) >= 32
    if set(tags) == {_INTEGER} and parts[0][1] in (b"\0", b"\1"):
        return len(tags) >= 9 or len(tags) == 6
    if tags[:2] == [_INTEGER, _OCTETS] and parts[0][1] == b"\1":
        return len(parts[1][1]) >= 20 and all(tag in (0xA0, 0xA1) for tag in tags[2:])
    return False


def is_openssh_private_key(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        length = int.from_bytes(data[at : at + 4], "big")
        at += 4 + length
        return data[at - length : at] if at <= len(data) else None

    if any(field() is None for _ in range(3)) or at + 4 > len(data):
        return False
    n_keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= n_keys <= 16 or any(field() is None for _ in range(n_keys + 1)):
        return False
    return at == len(data)


def is_private_key(data: bytes | None) -> bool:
    return data is not None and (is_der_private_key(data) or is_openssh_private_key(data))


def is_signed_token(text: str) -> bool:
    header, payload, signature = (_decode64(part) for part in text.split("."))
    if header is None or payload is None or signature is None or len(signature) < 16:
        return False
    try:
        head, body = json.loads(header), json.loads(payload)
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def _is_pem_key(body: str) -> bool:
    body = _PEM_HEADER.sub("", body.replace("\\n", "\n").replace("\\r", ""))
    return is_private_key(_decode64("".join(body.split())))


def _pem_spans(text: str) -> list[tuple[int, int]]:
    """Keys between a BEGIN mark and an END mark of its name, without a mark between them."""
    found, begin = [], None
    for mark in _MARK.finditer(text):
        if mark[1] == "BEGIN":
            begin = mark
        elif begin and begin[2] == mark[2] and _is_pem_key(text[begin.end() : mark.start()]):
            found.append((begin.start(), mark.end()))
            begin = None
    return found


def _holds_key(data: bytes | None) -> bool:
    """A private key, or a text with a PEM key in it."""
    if data is None:
        return False
    return is_private_key(data) or (b"-----BEGIN " in data and bool(_pem_spans(data.decode("latin-1"))))


def _is_bare_key(run: str) -> bool:
    if _HEX_BYTES.fullmatch(run) and is_private_key(bytes.fromhex(run)):
        return True
    return _holds_key(_decode64(run))


def _wrapped(text: str) -> list[list[re.Match]]:
    """Blocks of lines of base64: of equal length, but for a last one that may be shorter."""
    blocks: list[list[re.Match]] = []
    for line in _LINE.finditer(text):
        last = blocks[-1][-1] if blocks else None
        follows = last is not None and text[last.end() : line.start()] == "\n"
        if follows and len(blocks[-1][0][1]) == len(last[1]) >= len(line[1]):
            blocks[-1].append(line)
        else:
            blocks.append([line])
    return [block for block in blocks if len(block) > 1 and len(block[0][1]) >= _RUN]


def _wrapped_keys(text: str) -> list[tuple[int, int]]:
    found = []
    for block in _wrapped(text):
        ends = [len(block)]
        if len(block[-1][1]) < len(block[0][1]):  # the last line may belong to what follows
            ends.append(len(block) - 1)
        for end in ends:
            if _is_bare_key("".join(line[1] for line in block[:end])):
                found.append((block[0].start(1), block[end - 1].end(1)))
                break
    return found


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """All secrets of a text as (kind, start, end)."""
    if not text:
        return []
    found = [("hex", *m.span()) for m in _HEX.finditer(text)]
    lower = text.lower()
    if any(name in lower for name in _NAMES):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    if "-----BEGIN " in text:
        found += [("pem", *span) for span in _pem_spans(text)]
    if max(map(len, text.split()), default=0) >= _SIGNED_LENGTH:
        found += [("token", *m.span()) for m in _SIGNED.finditer(text) if is_signed_token(m[0])]
        runs = [m for m in _BASE64.finditer(text)]
        found += [("key", *m.span()) for m in runs if _is_bare_key(m[0])]
        if runs:
            alone = {span[1:] for span in found if span[0] in ("key", "pem")}
            found += [
                ("key", a, b) for a, b in _wrapped_keys(text)
                if not any(x <= a and b <= y for x, y in alone)
            ]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str | None) -> str | None:
    """The text with every stretch that secrets cover replaced by a mark of its first kind."""
    spans = spans_of(text)
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _spans_udf() -> Column:
    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("kind", "start", "end"), s)) for s in spans_of(t)])

    return spans


def find_secrets(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """One row per document: ``row`` (as it was) and ``spans``, sorted."""
    out = docs.select(F.struct("*").alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    spans = _spans_udf()(F.coalesce("text", F.lit("")))
    return out.select("row", spans.alias("spans"))


def redact(docs: DataFrame, *, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents without their secrets, other columns as they were."""

    @F.pandas_udf("string")
    def redact_all(texts: pd.Series) -> pd.Series:
        return texts.map(redacted)

    out = docs.select(
        F.struct("*").alias("row"), redact_all(F.col(f"`{text}`").cast("string")).alias("clean")
    )
    replaced = {text: F.col("clean"), n_chars: F.length("clean").cast("long")}
    return out.select(*[replaced.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select(
        "row.doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
