"""Secrets in audited files: pattern spans, and spans confirmed by decoding what they hold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The kinds in reporting order; the first three are the base patterns.
KINDS = ("assign", "access", "hex", "pem", "token", "key64", "keyhex", "wrapped")
BASE = KINDS[:3]
FINDING = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """(content start, content end) of the element whose tag stands at ``at``."""
    if at + 2 > len(data):
        return None
    n, at = data[at + 1], at + 2
    if n >= 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > len(data):
            return None
        n, at = int.from_bytes(data[at:at + size], "big"), at + size
    return (at, at + n) if at + n <= len(data) else None


def der_private_key(data: bytes) -> bool:
    """A SEQUENCE filled exactly by nested elements: a version, then key material (PKCS#1, PKCS#8, SEC 1)."""
    if len(data) < 24 or data[0] != 0x30 or not (whole := der_length(data, 0)) or whole[1] != len(data):
        return False
    at, tags, sizes, version = whole[0], [], [], None
    while at < whole[1]:
        inner = der_length(data, at)
        if not inner or inner[1] > whole[1]:
            return False
        if version is None:
            version = data[inner[0]:inner[1]]
        tags.append(data[at])
        sizes.append(inner[1] - inner[0])
        at = inner[1]
    if not tags or tags[0] != 0x02 or version not in (b"\x00", b"\x01"):
        return False
    rsa = len(tags) >= 9 and set(tags[:9]) == {0x02} and sizes[1] >= 32
    pkcs8 = tags[1:3] == [0x30, 0x04] and sizes[2] >= 16
    return rsa or pkcs8 or (tags[1:2] == [0x04] and sizes[1] >= 16)


def openssh_key(data: bytes) -> bool:
    """Magic, then length-prefixed cipher, function and options, key count, and a public part inside the data."""
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at:at + 4], "big")
    if at + 8 > len(data) or not 1 <= int.from_bytes(data[at:at + 4], "big") <= 16:
        return False
    return at + 8 + int.from_bytes(data[at + 4:at + 8], "big") <= len(data)


def _scanner():
    """The function that lists a text's findings; patterns are compiled once per worker."""
    import base64
    import binascii
    import json
    import re

    # Base patterns.
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    access = re.compile(r"AKIA[A-Z0-9]+")
    hexes = re.compile(r"[0-9a-f]{24,}")
    pem = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
    token = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
    # The shortest text with a base finding has 12 characters: 16 in base64, 24 hex digits.
    coded = re.compile(r"[A-Za-z0-9+/_-]{16,}+={0,2}")
    folded = re.compile(r"[A-Za-z0-9+/_-]{16,}+(?:\r?\n[A-Za-z0-9+/_-]{4,}+={0,2})+")
    coded_hex = re.compile(r"[0-9a-fA-F]{24,}+")
    plain = re.compile(rb"[\x20-\x7e]{12,}+")

    def unbase(s: str) -> bytes | None:
        body = s.rstrip("=").replace("-", "+").replace("_", "/")
        if len(body) % 4 == 1:
            return None
        try:
            return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
        except (binascii.Error, ValueError):
            return None

    def record(s: str) -> dict | None:
        try:
            got = json.loads((unbase(s) or b"").decode("utf-8"))
        except (ValueError, RecursionError):
            return None
        return got if isinstance(got, dict) else None

    def signed(m) -> bool:
        head = record(m[1])
        return head is not None and isinstance(head.get("alg"), str) and (record(m[2]) is not None or "enc" in head)

    def base(text: str) -> list[tuple[str, int, int]]:
        out = []
        if ":" in text or "=" in text:
            out += [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            out += [("access", *m.span()) for m in access.finditer(text) if m.end() - m.start() >= 20]
        return out

    def tells(inner: str) -> bool:
        return bool(base(inner) or any(map(signed, token.finditer(inner))))

    def held(data: bytes | None, kind: str) -> str | None:
        """The kind of finding that decoded bytes are: a key, bytes with a text that has a base finding or signed token, or none."""
        if not data:
            return None
        if der_private_key(data) or openssh_key(data):
            return kind
        return "wrapped" if any(tells(m[0].decode("ascii")) for m in plain.finditer(data)) else None

    def held_coded(run: str) -> str | None:
        """A run may begin before its code: each of the four shifts is decoded."""
        body = run.rstrip("=")
        for shift in range(4):
            part = body[shift:]
            if kind := held(unbase(part[:len(part) - (len(part) % 4 == 1)]), "key64"):
                return kind
        return None

    def held_hex(run: str) -> str | None:
        return next((k for shift in (0, 1) if (k := held(bytes.fromhex(run[shift:len(run) - (len(run) - shift) % 2]), "keyhex"))), None)

    def scan(text: str | None) -> list[tuple[str, int, int]]:
        text = text or ""
        out = base(text) + [("hex", *m.span()) for m in hexes.finditer(text)]
        if "PRIVATE KEY-----" in text:
            for m in pem.finditer(text):
                data = unbase("".join(m[2].split()))
                if data and (der_private_key(data) or openssh_key(data) or m[1].startswith("ENCRYPTED") and data[0] == 0x30 and (der_length(data, 0) or (0, 0))[1] == len(data)):
                    out.append(("pem", *m.span()))
        if "eyJ" in text:
            out += [("token", *m.span()) for m in token.finditer(text) if signed(m)]
        out += [(kind, *m.span()) for m in coded_hex.finditer(text) if (kind := held_hex(m[0]))]
        out += [(kind, *m.span()) for m in coded.finditer(text) if (kind := held_coded(m[0]))]
        if "\n" in text:
            inside = [f[1:] for f in out]
            for m in folded.finditer(text):
                # Lines that tell nothing alone are decoded together.
                if not any(m.start() <= a and b <= m.end() for a, b in inside) and (kind := held_coded("".join(m[0].split()))):
                    out.append((kind, *m.span()))
        rank = {k: i for i, k in enumerate(KINDS)}
        return sorted(set(out), key=lambda f: (f[1], rank[f[0]], f[2]))
    return scan


@F.pandas_udf(FINDING)
def find_secrets(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    scan = _scanner()
    for texts in parts:
        yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] for t in texts], dtype=object)


def confirm_secrets(files: DataFrame, text: str = "text", findings: str = "findings") -> DataFrame:
    """Audited files (``path``, ``text``) with ``findings``: kind, start and end of each secret.

    Positions are code points of the whole text, ends exclusive; findings are sorted by
    start and then by kind. ``assign``, ``access`` and ``hex`` are pattern spans. The others are reported only
    after their content was decoded and its structure parsed: ``pem``
    blocks and base64 (``key64``, also over several lines) or hex (``keyhex``) runs that hold a private key whose nested
    lengths fill it exactly, wherever in the run the code begins; ``token``: three parts whose header is a JSON object
    with an algorithm; ``wrapped``: coded text that holds an assignment, access key or signed token.
    A projection, row by row: copies, ties and repeated rows change nothing; null counts as empty and has no finding; a column named like
    ``findings`` is replaced.
    """
    return files.withColumn(findings, find_secrets(F.col(text).cast("string")))
