"""Secret scan with structural confirmation.

Plain patterns give the base spans. Beyond them a candidate is reported only after it has been decoded and its inner
structure parsed: ASN.1 encodings of private keys (certificates and public keys are none) whose nested lengths add up, SSH
key blobs and private key files whose length-prefixed fields fill them, and signed tokens whose header is a JSON object that
names an algorithm. Hex of either case and base64 in one line or many are decoded.

Nulls and empty texts have no spans. Texts are scanned whole, however long. Rows are independent, so repeated rows, ties and
hot sources need no care; other columns are ignored by the scan and kept as they are by `redact`. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table

KINDS = ("assign", "access", "hex", "der", "ssh", "jwt")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ANY_HEX = re.compile(r"[0-9A-Fa-f]{24,}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{24,}+(?:\r?\n[A-Za-z0-9+/]{24,}+)*+(?:\r?\n[A-Za-z0-9+/]++)?={0,2}")
_WORDS = ("password", "passwd", "secret", "token", "api")


def der_lengths(data: bytes, at: int, end: int, depth: int = 0) -> int:
    """Number of ASN.1 elements in data[at:end], -1 if a length does not fit exactly."""
    found = 0
    while at < end:
        if end - at < 2 or depth > 12:
            return -1
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return -1
            size = int.from_bytes(data[at : at + n], "big")
            at += n
        if at + size > end:
            return -1
        found += 1
        if tag & 0x20:
            inner = der_lengths(data, at, at + size, depth + 1)
            if inner < 0:
                return -1
            found += inner
        at += size
    return found


def elements(data: bytes) -> list[tuple[int, bytes]]:
    """Tags and contents of the elements in a run of ASN.1 that der_lengths has found sound."""
    out, at = [], 0
    while at < len(data):
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        out.append((tag, data[at : at + size]))
        at += size
    return out


INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def is_key(data: bytes) -> bool:
    """One ASN.1 SEQUENCE that fills the data and holds a private key: a version, then an algorithm and octets, or octets, or
    at least five further numbers; or, encrypted, an algorithm and octets."""
    if len(data) < 16 or data[0] != SEQUENCE or der_lengths(data, 0, len(data)) < 3:
        return False
    top = elements(data)
    if len(top) != 1:
        return False
    inner = elements(top[0][1])
    tags = [tag for tag, _ in inner]
    if tags[0] == INTEGER and len(inner[0][1]) == 1:
        return tags[1:3] == [SEQUENCE, OCTETS] or tags[1:2] == [OCTETS] or (len(tags) >= 6 and set(tags[1:6]) == {INTEGER})
    return tags == [SEQUENCE, OCTETS] and inner[0][1][:1] == bytes([OID])


MAGIC = b"openssh-key-v1\0"


def prefixed(data: bytes, at: int) -> int:
    """End of the length-prefixed field at this place, -1 if it reaches beyond the data."""
    end = at + 4 + int.from_bytes(data[at : at + 4], "big")
    return end if at + 4 <= len(data) and end <= len(data) else -1


def file_size(data: bytes) -> int:
    """Bytes of the private key file that the data starts with: three names, a number of keys, each public key with fields of
    its own, and the private part; -1 if its lengths don't fit."""
    at = len(MAGIC)
    for _ in range(3):
        at = prefixed(data, at)
        if at < 0:
            return -1
    n = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= n <= 16:
        return -1
    for _ in range(n):
        end = prefixed(data, at)
        if end < 0 or not is_ssh(data[at + 4 : end]):
            return -1
        at = end
    return prefixed(data, at)


def is_ssh(data: bytes) -> bool:
    """Length-prefixed fields that fill the data, the first a key type; or a whole private key file."""
    if data.startswith(MAGIC):
        return file_size(data) == len(data)
    at, names = 0, []
    while at + 4 <= len(data) and len(names) < 16:
        end = prefixed(data, at)
        if end < 0:
            return False
        names.append(data[at + 4 : end])
        at = end
    return at == len(data) and len(names) >= 2 and names[0].startswith((b"ssh-", b"ecdsa-"))


def decoded(run: str) -> bytes:
    core = re.sub(r"[\r\n=]", "", run)
    try:
        return base64.b64decode(core + "=" * (-len(core) % 4))
    except (binascii.Error, ValueError):
        return b""


def key_sizes(head: bytes, data: Callable[[], bytes]) -> list[int]:
    """Sizes in bytes that a key with these first 12 bytes can have, longest first; data() gives all that may belong to it."""
    if head[:1] == b"\x30" and len(head) == 12:
        n = head[1] & 0x7F if head[1] & 0x80 else 0
        return [2 + n + int.from_bytes(head[2 : 2 + n], "big") if n else 2 + head[1]] if n <= 4 else []
    if MAGIC.startswith(head) and len(head) == 12:
        size = file_size(data())
        return [size] if size > 0 else []
    if not head[4:].startswith((b"ssh-", b"ecdsa-")):
        return []
    every, at, out = data(), 0, []
    while at + 4 <= len(every) and len(out) < 16:
        at += 4 + int.from_bytes(every[at : at + 4], "big")
        out.append(at)
    return out[:0:-1]


def keys_in_run(run: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the keys in lines of base64. A key starts with a line and ends with one, not always the
    run's first and last: lines of other text may be joined to it."""
    lines = [(m.start(), m.end()) for m in re.finditer(r"[^\r\n]+", run)]
    flat = re.sub(r"[\r\n=]", "", run)
    at, where = [0], {}
    for i, (a, b) in enumerate(lines):
        at.append(at[-1] + len(run[a:b].rstrip("=")))
        where[at[-1]] = i
    out, i = [], 0
    while i < len(lines):
        a, c, after = lines[i][0], at[i], i + 1
        if run[a] in "MAb":
            for size in key_sizes(decoded(flat[c : c + 16]), lambda c=c: decoded(flat[c : len(flat) - ((len(flat) - c) % 4 == 1)])):
                last = where.get(c + (size * 4 + 2) // 3, -1)
                if last >= i:
                    data = decoded(flat[c : at[last + 1]])
                    kind = 3 if is_key(data) else 4 if is_ssh(data) else -1
                    if kind > 0:
                        out.append((a, kind, lines[last][1]))
                        after = last + 1
                        break
        i = after
    return out


def token_header(token: str) -> bool:
    """Is the first part of a dotted token a JSON object that names its algorithm, and the second JSON too?"""
    try:
        parts = [json.loads(base64.urlsafe_b64decode(p + "=" * (-len(p) % 4))) for p in token.split(".")[:2]]
    except (binascii.Error, ValueError, RecursionError):
        return False
    return isinstance(parts[0], dict) and isinstance(parts[0].get("alg"), str) and isinstance(parts[1], dict)


def find_base(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the plain patterns' spans."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def confirm(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that only decoding confirms."""
    out = []
    if "eyJ" in text:
        out += [(m.start(), 5, m.end()) for m in JWT.finditer(text) if token_header(m.group())]
    for start, end in sorted({(a, b) for a, kind, b in base if kind == 2} | {m.span() for m in ANY_HEX.finditer(text)}):
        if text.startswith("30", start) and (start, 3) not in (x[:2] for x in out) and is_key(bytes.fromhex(text[start : end - (end - start) % 2])):
            out.append((start, 3, end))
    for m in BASE64.finditer(text):
        out += [(m.start() + a, kind, m.start() + b) for a, kind, b in keys_in_run(m.group())]
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, kinds, starts and ends of all spans, and the digest columns of the base spans."""

    def scan(batches):
        for batch in batches:
            rows = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for value in batch.column(1).to_pylist():
                base = find_base(value or "")
                every = sorted(base + confirm(value or "", base))
                for i, c in enumerate(("n_assign", "n_access", "n_hex")):
                    rows[c].append(sum(k == i for _, k, _ in base))
                rows["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
                rows["spans"].append(listed(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[c], pa.int64() if c[:2] == "n_" else pa.string()) for c in rows)], [id_col, *rows])

    src = docs.select(F.col(id_col), F.col(text).alias("__text"))
    kind = src.schema[id_col].dataType.simpleString()
    return src.mapInArrow(scan, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every found span of `text` replaced by the mask; other columns, nulls and clean texts stay as they are."""
    at = docs.columns.index(text)

    def clean(batches):
        for batch in batches:
            values = batch.column(at).to_pylist()
            for i, value in enumerate(values):
                if value:
                    base = find_base(value)
                    if spans := merged((a, b) for a, _, b in base + confirm(value, base)):
                        parts, last = [], 0
                        for a, b in spans:
                            parts += [value[last:a], mask]
                            last = b
                        values[i] = "".join([*parts, value[last:]])
            yield batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
        give_back()

    return docs.mapInArrow(clean, docs.schema)


def merged(spans) -> list[tuple[int, int]]:
    """Sorted spans with overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
