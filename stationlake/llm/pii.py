"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation finds how reliable each is,
and a span classifier learns from the resulting posteriors.

Plain patterns give the base spans, which always stay. Further candidates (identity numbers, account numbers, local phone
numbers, names with a title or a listed first name) are shown to five labelers: format, checksum, gazetteer, context and neighbourhood, each
voting for, against or not at all. Candidates of all documents are counted by kind, votes and shape; these counts, a bounded
number of rows whatever the input, are all the EM and the classifier need. Spans with a probability of at least one half are
added.

Nulls and empty texts have no spans; texts are scanned whole, however long. Rows, repeated or not, are independent but for the
learned reliabilities, to which each row counts. Without candidates nothing is added. Other columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "local", "name")
LABELERS = 5
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,5}\)\x20?|0[0-9]{1,4}[\x20/-])[0-9]{2,4}(?:[\x20-]?[0-9]{2,4}){1,3}(?![0-9])")
_NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Madame|Monsieur|Señor|Señora)\b\.?\x20[A-ZÀ-Þ][a-zà-ÿ]{1,20}(?:\x20[A-ZÀ-Þ][a-zà-ÿ]{1,20})?")
_CAPITALS = re.compile(r"\b([A-Z][a-z]{2,10})(?=\x20([A-ZÀ-Þ][a-zà-ÿ]{1,20}))")
#: Cue words by kind (gazetteer).
CUES = {
    4: ("ssn", "social security", "identity number", "national id"),
    5: ("iban", "account", "bank", "konto", "cuenta", "compte"),
    6: ("tel", "phone", "call", "mobile", "fax", "fon", "appel", "llama"),
    7: ("name", "contact", "signed", "dear", "regards", "hello"),
}
FIRST_NAMES = frozenset("james mary john patricia robert jennifer michael linda william elizabeth david susan maria anna peter thomas paul julia marie jean pierre sophie carlos juan jose carmen hans klaus ursula sabine".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outward, so long runs of letters cost nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(index of kind, start, end), by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, code): further spans and, as anchors for the labelers, the base spans; code packs the votes."""
    found = []
    if "-" in text:
        found += [(4, m) for m in _SSN.finditer(text)]
    found += [(5, m) for m in _IBAN.finditer(text)]
    found += [(6, m) for m in _LOCAL_PHONE.finditer(text)]
    found = [(k, m.start(), m.end()) for k, m in found]
    titled = [m.span() for m in _NAME.finditer(text)]
    listed_names = [(m.start(), m.end(2)) for m in _CAPITALS.finditer(text) if m.group(1).lower() in FIRST_NAMES]
    found += [(7, a, b) for a, b in titled + [x for x in listed_names if not any(x[0] < q and p < x[1] for p, q in titled)]]
    taken = [(a, b) for _, a, b in base]
    out = []
    for kind, a, b in found:
        s = text[a:b]
        left = text[max(0, a - 48) : a].lower()
        digits = _NOT_DIGIT.sub("", s)
        votes = [0] * LABELERS
        votes[0] = 1 if kind != 6 or 7 <= len(digits) <= 12 else -1
        if kind == 4:
            votes[1] = 1 if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000" else -1
        elif kind == 5:
            votes[1] = 1 if mod97(s) else -1
        votes[2] = (1 if any(w in FIRST_NAMES for w in s.lower().split()) else 0) if kind == 7 else (1 if any(c in left for c in CUES[kind]) else 0)
        votes[3] = 1 if re.search(r"(?:[:#=]|\bis|\bno\.?)\s*\Z", left) else (-1 if re.search(r"[A-Za-z0-9]\Z", left) else 0)
        votes[4] = 1 if any(abs(a - y) <= 120 or abs(x - b) <= 120 for x, y in taken) else 0
        if any(x < b and a < y for x, y in taken):
            continue  # the base span already covers it
        out.append((kind, a, b, pack(kind, votes, b - a)))
    out += [(k, a, b, pack(k, [1, 1 if k in (1, 2) else 0, 0, 0, 0], b - a)) for k, a, b in base]
    return out


def pack(kind: int, votes: list[int], size: int) -> int:
    code = kind
    for v in votes:
        code = code * 3 + v + 1
    return code * 4 + min(3, size // 8)


def unpack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes (-1, 0, 1) and size classes."""
    size, codes = codes % 4, codes // 4
    votes = np.zeros((len(codes), LABELERS), np.int64)
    for i in range(LABELERS - 1, -1, -1):
        votes[:, i], codes = codes % 3 - 1, codes // 3
    return codes, votes, size


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Dawid-Skene EM over counted vote patterns: P(vote | class) as (labelers, classes, votes), posteriors, prior."""
    post = 1 / (1 + np.exp(-votes.sum(1).astype(float)))
    table = np.zeros((LABELERS, 2, 3))
    prior = 0.5
    for _ in range(rounds):
        weight = np.stack((counts * (1 - post), counts * post))
        prior = (weight[1].sum() + 1) / (weight.sum() + 2)
        for j in range(LABELERS):
            for v in (-1, 0, 1):
                table[j, :, v + 1] = weight[:, votes[:, j] == v].sum(1) + 0.5
            table[j] /= table[j].sum(1, keepdims=True)
        odds = np.log(prior / (1 - prior)) + sum(np.log(table[j, 1, votes[:, j] + 1] / table[j, 0, votes[:, j] + 1]) for j in range(LABELERS))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return table, post, prior


def features(kinds: np.ndarray, votes: np.ndarray, size: np.ndarray) -> np.ndarray:
    x = np.zeros((len(kinds), 1 + len(KINDS) + 2 * LABELERS + 4))
    x[:, 0] = 1
    x[np.arange(len(kinds)), 1 + kinds] = 1
    x[:, 1 + len(KINDS) : 1 + len(KINDS) + LABELERS] = votes > 0
    x[:, 1 + len(KINDS) + LABELERS : 1 + len(KINDS) + 2 * LABELERS] = votes < 0
    x[np.arange(len(kinds)), 1 + len(KINDS) + 2 * LABELERS + size] = 1
    return x


def span_model(codes: np.ndarray, counts: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Probability of each code: logistic regression (Newton steps) on the posteriors, weighted by counts."""
    kinds, votes, size = unpack(codes)
    _, post, _ = reliabilities(votes, counts)
    x = features(kinds, votes, size)
    w = np.zeros(x.shape[1])
    weight = counts / max(1.0, counts.mean() if len(counts) else 1.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (p - post)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_personal(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, numbers of base spans, digest of the base spans, and all spans."""
    src = docs.select(F.col(id_col), F.col(text).alias("__text"))
    kind = src.schema[id_col].dataType.simpleString()
    spot = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("code", pa.int32())])

    def look(batches):
        for batch in batches:
            counts, digest, found = [[] for _ in range(4)], [], []
            for value in batch.column(1).to_pylist():
                base = base_spans(value or "")
                for k in range(4):
                    counts[k].append(sum(x[0] == k for x in base))
                digest.append(hashlib.sha256(listed(base).encode()).hexdigest())
                found.append([{"kind": k, "start": a, "end": b, "code": c} for k, a, b, c in candidates(value or "", base)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(found, pa.list_(spot))], [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "found"])

    seen = stored(src.mapInArrow(look, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, found array<struct<kind:int,start:int,end:int,code:int>>"), "candidates")
    tally = seen.select(F.explode("found.code").alias("code")).groupBy("code").count().orderBy("code").collect()
    codes, counts = np.array([r[0] for r in tally], np.int64), np.array([r[1] for r in tally], float)
    good = {int(c) for c, p in zip(codes, span_model(codes, counts) if len(codes) else []) if p >= 0.5}

    def settle(batches):
        for batch in batches:
            spans = [listed(sorted((x["kind"], x["start"], x["end"]) for x in row if x["kind"] < 4 or x["code"] in good)) for row in batch.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(spans, pa.string())], [*batch.schema.names[:6], "spans"])

    return seen.mapInArrow(settle, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents"))
