r"""Secret scans with structural confirmation.

Three plain rules give base spans: assignments to a secret's name, access key ids and long hex runs. Structure adds spans
for what plain rules can't tell from noise, and only reports what decodes:

* `jwt`: three base64url fields, the first a JSON header with `alg`, the second JSON (signed), or five fields with `enc`;
* `der`: base64 or hex whose bytes are ASN.1 with nested lengths that add up to the whole, holding the integers of an RSA,
  DSA or EC private key or the version, algorithm and octets of PKCS #8;
* `ssh`: base64 of an openssh-key-v1 container whose length-prefixed fields parse;
* `pem`: a private key armour around one of these.

A candidate is decoded whole; a text is searched whole. Of dotted fields the first three or five are tried, so a token may end a
sentence. An armour may have header lines (Proc-Type, DEK-Info) and its line breaks may be escaped, as in JSON. Each row is handled
on its own, so there is no shuffle and nothing grows but the row itself; spans become code points in one pass over the text.

Defined cases: a null or empty text has no spans; repeated rows each get their own result; further columns are ignored; a very long
text takes memory of a few times its bytes, beside batches of about 2 MB of other texts.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.common import materialize, table, tidy


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The name is spelled out in both cases rather than matched with IGNORECASE, which would fold letters beyond ASCII.
ASSIGN = re.compile(rf"""({_any_case("password")}|{_any_case("passwd")}|{_any_case("secret")}|{_any_case("token")}|{_any_case("api")}_?{_any_case("key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(rb"[0-9a-f]{24}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

SIGNED = re.compile(rb"(?<![A-Za-z0-9_.-])ey[A-Za-z0-9_-]{6,}+(?:\.[A-Za-z0-9_-]*+){2,4}")
#: A candidate of at least this many characters of base64 or hex of either case.
ENCODED = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+={0,2}")
#: An armour's body: header lines of a name and a value, then base64; line breaks may be escaped.
_BREAK = rb"(?:\s|\\r|\\n)"
ARMOUR = re.compile(rb"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----" + _BREAK + rb"*((?:[A-Z][A-Za-z-]*: [^\r\n\\]*" + _BREAK + rb"+)*)((?:[A-Za-z0-9+/=]|" + _BREAK + rb")+?)-----END \1-----")
BREAKS = re.compile(_BREAK)
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh", "pem")


def base64_bytes(s: bytes) -> bytes | None:
    """Decoded base64 of either alphabet, padded or not."""
    s = s.rstrip(b"=").translate(bytes.maketrans(b"-_", b"+/"))
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + b"=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def decodings(s: bytes):
    """Bytes that a candidate may stand for."""
    if len(s) % 2 == 0 and re.fullmatch(rb"[0-9a-fA-F]+", s):
        yield bytes.fromhex(s.decode())
    if (b := base64_bytes(s)) is not None:
        yield b


def der_items(b: bytes, depth: int = 0) -> list[tuple[int, bytes | list]] | None:
    """All elements of b if their lengths add up to b exactly, constructed ones parsed in turn; else None."""
    out: list[tuple[int, bytes | list]] = []
    at = 0
    while at < len(b):
        if at + 2 > len(b):
            return None
        tag, n = b[at], b[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(b):
                return None
            n, at = int.from_bytes(b[at : at + k], "big"), at + k
        if at + n > len(b):
            return None
        body: bytes | list | None = b[at : at + n]
        if tag & 0x20:
            if depth > 8 or (body := der_items(body, depth + 1)) is None:
                return None
        out.append((tag, body))
        at += n
    return out


def is_private_key(b: bytes) -> bool:
    """PKCS #1, DSA, SEC 1 or PKCS #8 (plain, or encrypted by a scheme that takes a password)."""
    top = der_items(b) if b[:1] == b"\x30" else None
    if not top or len(top) != 1 or not isinstance(top[0][1], list):
        return False
    tags = [t for t, _ in top[0][1]]
    version = top[0][1][0][1] if tags and tags[0] == 2 else None
    if version in (b"\x00", b"\x01"):
        if len(tags) in (6, 9) and set(tags) == {2}:  # DSA, RSA
            return True
        if tags[:2] == [2, 4] and version == b"\x01" and 16 <= len(top[0][1][1][1]) <= 72:  # EC
            return True
        return tags[:3] == [2, 0x30, 4] and _algorithm(top[0][1][1][1])
    return tags == [0x30, 4] and _algorithm(top[0][1][0][1], PASSWORD_ARCS) and len(top[0][1][1][1]) >= 8


#: The object identifiers of PKCS #5 (1.2.840.113549.1.5) and PKCS #12 (1.2.840.113549.1.12.1) schemes, without their last number.
PASSWORD_ARCS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _algorithm(items: list, arcs: tuple[bytes, ...] = (b"",)) -> bool:
    """Whether items begin with an object identifier, one number below one of the arcs where such are given."""
    return bool(items) and items[0][0] == 6 and any(items[0][1].startswith(a) and (not a or len(items[0][1]) == len(a) + 1) for a in arcs)


def is_ssh_key(b: bytes) -> bool:
    """openssh-key-v1: cipher, kdf and kdf options, the number of keys, a public key and the private section."""
    if not b.startswith(b"openssh-key-v1\x00"):
        return False
    at, fields = 15, []
    for _ in range(3):
        n = int.from_bytes(b[at : at + 4], "big")
        fields.append(b[at + 4 : at + 4 + n])
        at += 4 + n
    keys, at = int.from_bytes(b[at : at + 4], "big"), at + 4
    for _ in range(keys + 1 if keys <= 16 else 0):
        at += 4 + int.from_bytes(b[at : at + 4], "big")
    return fields[0].isascii() and 1 <= keys <= 16 and at <= len(b) and len(fields[0]) > 0


def key_kind(s: bytes) -> str | None:
    """der or ssh if a candidate decodes to a private key."""
    for b in decodings(s):
        if is_private_key(b):
            return "der"
        if is_ssh_key(b):
            return "ssh"
    return None


def _json(s: bytes):
    b = base64_bytes(s)
    try:
        return json.loads(b) if b and b[:1] == b"{" else None
    except (ValueError, RecursionError):
        return None


def is_signed_token(s: bytes) -> bool:
    parts = s.split(b".")
    head = _json(parts[0])
    if not isinstance(head, dict) or not isinstance(head.get("alg"), str):
        return False
    if len(parts) == 5:
        return isinstance(head.get("enc"), str) and all(base64_bytes(p) is not None for p in parts[1:])
    return len(parts) == 3 and isinstance(_json(parts[1]), dict) and (head["alg"] == "none" or bool(base64_bytes(parts[2])))


def base_spans(raw: bytes, low: bytes) -> list[tuple[str, int, int]]:
    """Base spans of a text (low: in lower case), in code points."""
    named, access, hexed = any(n in low for n in NAMES), b"AKIA" in raw, LONG_HEX.search(raw) is not None
    if not (named or access or hexed):
        return []
    text = raw.decode("utf-8", "surrogatepass")
    out = []
    if named:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if access:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    if hexed:
        out += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return out


def signed_end(s: bytes) -> int | None:
    """How much of a run of dotted fields is a signed token: its first five fields or its first three."""
    parts = s.split(b".")
    for n in (5, 3):
        if len(parts) >= n and is_signed_token(head := b".".join(parts[:n])):
            return len(head)
    return None


def armoured_key(headers: bytes, body: bytes) -> bool:
    """Whether an armour's body decodes to a private key; with headers that say it is encrypted, to whole blocks."""
    data = BREAKS.sub(b"", body)
    if b"ENCRYPTED" in headers and b"DEK-Info" in headers:
        plain = base64_bytes(data)
        return bool(plain) and len(plain) >= 32 and len(plain) % 8 == 0
    return key_kind(data) is not None


def code_points(raw: bytes, places: list[int]) -> dict[int, int]:
    """The number of code points before each of the byte places."""
    if raw.isascii():
        return {p: p for p in places}
    out, at, n = {}, 0, 0
    for p in sorted(set(places)):
        n += len(raw[at:p].decode("utf-8", "surrogatepass"))
        out[p], at = n, p
    return out


def confirmed_spans(raw: bytes) -> list[tuple[str, int, int]]:
    """Spans that decode to a key or a signed token, in code points."""
    found = [("pem", *m.span()) for m in ARMOUR.finditer(raw) if armoured_key(m[2], m[3])] if b"PRIVATE KEY-----" in raw else []
    if b"ey" in raw and b"." in raw:
        found += [("jwt", m.start(), m.start() + n) for m in SIGNED.finditer(raw) if (n := signed_end(m[0]))]
    covered = sorted((s, e) for _, s, e in found)
    k = reach = 0
    for m in ENCODED.finditer(raw):
        while k < len(covered) and covered[k][0] <= m.start():
            reach, k = max(reach, covered[k][1]), k + 1
        if m.start() >= reach and (kind := key_kind(m[0])):
            found.append((kind, *m.span()))
    point = code_points(raw, [p for _, s, e in found for p in (s, e)])
    return [(k, point[s], point[e]) for k, s, e in found]


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_confirmed", pa.int64())])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed (spans that structure added)."""

    def scan(batches):
        line = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            cols: list[list] = [[] for _ in OUT]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                raw = text.as_py() or b""
                base, more = base_spans(raw, raw.lower()), confirmed_spans(raw)
                base = ordered(base)
                counts = [sum(s[0] == k for s in base) for k in KINDS[:3]]
                row = (doc_id, *counts, hashlib.sha256(line(base).encode()).hexdigest() if base else none, line(ordered(base + more)), len(more))
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, OUT, strict=True)], schema=OUT)

    ddl = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"
    return materialize(docs.select("doc_id", "text").mapInArrow(tidy(scan), ddl), "secrets")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
