"""Byte-pair encoding as a bounded-lookahead streaming transducer, and decoding as an incremental byte-to-text machine.

Encoding rests on two facts about rank-ordered merges. (1) A token sequence is the encoding of its bytes exactly if each token
encodes itself and each adjacent pair encodes to itself, so the last token of each prefix fixes that prefix's whole encoding.
(2) Further input can only move a boundary through a chain of merges of falling rank that runs from the new bytes back to it,
and the merge list bounds the bytes that such a chain spans: its sufficient lookahead (`Merges.lookahead`). The transducer
keeps the last token of each prefix, emits the tokens that end further back than the lookahead, and forgets them: its memory
is the lookahead and the longest token, however long a run of letters is.

Every pre-token is encoded by the transducer. Pieces between single spaces repeat, so results of short pieces and pre-tokens
are kept in bounded tables (`pieces`); longer ones go through the transducer each time. Nulls are empty texts; empty texts
have no tokens. Rows, repeated or not, are independent of each other; columns of the input that clash with those returned are
replaced or ignored. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import codecs
import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, table
from .pieces import Remembered, column_ids

KEPT_PAIRS, KEPT_PIECES, BLOCK_BYTES = 300_000, 150_000, 3 << 20  # pairs; pieces, twice; bytes of text encoded at once

def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files, by the usual rule: visible Latin-1 characters
    stand for themselves, the others take the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """Vocabulary, merge ranks and lookahead of a byte-level tokeniser file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut_special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        raw = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"] if t not in special}
        self.ids = {b: spec["model"]["vocab"][t] for t, b in raw.items()}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in special.items()}
        if max(self.bytes) >= 1 << 16:
            raise ValueError(f"{path}: ids of this module take 16 bits")
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        self.longest = max(map(len, self.ids))
        self.made: dict[int, tuple[int, int, int]] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        vocab = spec["model"]["vocab"]
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = vocab[a], vocab[b]
            self.ranks[left, right] = (rank, vocab[a + b])
            self.made.setdefault(vocab[a + b], (rank, left, right))
        self.lookahead = self._lookahead()
        self.pairs: dict[int, bool] = {}
        self.tokens = {b: i for b, i in self.ids.items() if self.merged([self.ids[bytes([x])] for x in b]) == [i]}
        self.matcher = self._matcher()

    def _matcher(self):
        """Automaton that finds all tokens that end at each byte; a character of its text is a byte."""
        import ahocorasick

        out = ahocorasick.Automaton()
        for b, i in self.tokens.items():
            out.add_word(b.decode("latin-1"), (len(b), i))
        out.make_automaton()
        return out

    def _lookahead(self) -> int:
        """Bytes after a boundary that decide whether it stays.

        Two texts merge alike up to where they first differ, unless a merge (u, v) happens in one of them only, because v is
        there in one only. Then the boundary where they differ lies inside v, as the place of one of the merges that make v, or
        at the end of v, where a merge of some right part of v as it was being made took place in the other text. That merge
        has a lower rank, so the bytes that the merge of rank r may depend on follow from those of lower ranks."""
        far: dict[int, list[tuple[int, int]]] = {}  # by left part: (rank, most bytes after the boundary up to that rank)
        reach: dict[tuple[int, int], int] = {}
        inner: dict[int, int] = {}  # by token: most bytes after its start that merges inside it depend on
        most = self.longest
        for (u, v), (rank, made) in self.ranks.items():
            size = len(self.bytes[v])
            best = max(size, inner.get(v, 0))
            for part, gone in self._edge(v, 1):
                known = far.get(part)
                if known:
                    k = bisect.bisect_left(known, (min(rank, gone), 0))
                    if k:
                        best = max(best, size + known[k - 1][1])
            reach[u, v] = best
            row = far.setdefault(u, [])
            row.append((rank, max(best, row[-1][1] if row else 0)))
            left = len(self.bytes[u])
            inner[made] = max(inner.get(made, 0), inner.get(u, 0), left + max(best, inner.get(v, 0)))
            most = max(most, best)
        return most

    def merged(self, tokens: list[int]) -> list[int]:
        """Rank-ordered merging of a short sequence until no pair merges."""
        ranks = self.ranks
        while len(tokens) > 1:
            best = min(((ranks[p][0], i) for i in range(len(tokens) - 1) if (p := (tokens[i], tokens[i + 1])) in ranks), default=None)
            if best is None:
                break
            i = best[1]
            tokens = [*tokens[:i], ranks[tokens[i], tokens[i + 1]][1], *tokens[i + 2 :]]
        return tokens

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stand at one edge of a token while it is built, with the rank at which each goes into the next."""
        known = self.edges[side].get(token)
        if known is None:
            known, rank = [], 1 << 30
            while True:
                known.append((token, rank))
                parts = self.made.get(token)
                if parts is None:
                    break
                rank, token = parts[0], parts[1 + side]
            self.edges[side][known[0][0]] = known
        return known

    def fits(self, a: int, b: int) -> bool:
        """Does the pair of tokens encode to itself? It does unless some merge across the boundary comes before the merges
        that take its two parts away from there; of equal ranks the one further left comes first."""
        known = self.pairs.get(a << 16 | b)
        if known is None:
            ranks = self.ranks
            known = True
            for x, gone_x in self._edge(a, 1):
                for y, gone_y in self._edge(b, 0):
                    r = ranks.get((x, y))
                    if r is not None and r[0] < gone_x and r[0] <= gone_y:
                        known = False
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            self.pairs[a << 16 | b] = known
        return known


class Transducer:
    """Encodes one pre-token fed in parts; feed() returns the tokens that are final by then, finish() the rest."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.peak = 0  # bytes ever held
        self.begin()

    def begin(self) -> None:
        self.size = 0  # bytes held
        self.before = -2  # the last token emitted; -2: none yet
        self.last: list[int] = [-2]  # by prefix length: its last token; -1: no encoding ends there
        self.found = None

    def feed(self, part: bytes, step: int = 256) -> list[int]:
        """Any length: it is taken in steps, so the window stays as small as the lookahead allows."""
        out: list[int] = []
        for at in range(0, len(part), step):
            self._extend(part[at : at + step])
            if self.size > self.peak:
                self.peak = self.size
            if self.size > self.m.lookahead + self.m.longest:
                out += self._settle()
        return out

    def _extend(self, part: bytes) -> None:
        text, pairs, fits = part.decode("latin-1"), self.m.pairs, self.m.fits
        if self.found is None:
            self.found = self.m.matcher.iter(text)
            self.seen = 0
        else:
            self.found.set(text)
        skip = self.size - self.seen  # the automaton counts bytes from the pre-token's start, last from what is held
        last = self.last + [-1] * len(part)
        for end, (size, t) in self.found:
            end += skip + 1
            if last[end] == -1 and (prior := last[end - size]) != -1:
                ok = prior == -2 or pairs.get(prior << 16 | t)
                if ok or (ok is None and fits(prior, t)):
                    last[end] = t
        self.last = last
        self.size += len(part)
        self.seen += len(part)

    def _back(self, end: int) -> list[int]:
        out = []
        while end:
            t = self.last[end]
            out.append(t)
            end -= len(self.m.bytes[t])
        return out[::-1]

    def _settle(self) -> list[int]:
        """Tokens that end more than the lookahead before the end of what was fed: no further input can change them."""
        final, out, size = self.size - self.m.lookahead - 1, [], 0
        for t in self._back(self.size):
            if size + len(self.m.bytes[t]) > final:
                break
            size += len(self.m.bytes[t])
            out.append(t)
        if out:
            self.before = out[-1]
            self.last = [self.before, *self.last[size + 1 :]]
            self.size -= size
        return out

    def finish(self) -> list[int]:
        out = self._back(self.size)
        self.begin()
        return out


class Encoder:
    """Encodes whole texts with bounded memory for what it remembers of other texts."""

    def __init__(self, path: str):
        self.m = Merges(path)
        self.t = Transducer(self.m)
        self.pieces = Remembered(self._piece, KEPT_PIECES)

    def forget(self) -> None:
        """Gives back the memory of all that is remembered: a worker goes on to other stages' tasks."""
        self.pieces = Remembered(self._piece, KEPT_PIECES)
        self.m.pairs = {}

    def _word(self, pre: bytes) -> bytes:
        """Ids of one pre-token, through the transducer."""
        return array("H", self.t.feed(pre) + self.t.finish()).tobytes()

    def _piece(self, piece: bytes) -> bytes:
        pres = self.m.pattern.findall(piece.decode())
        return self._word(piece) if len(pres) == 1 else b"".join([self.pieces(pre.encode()) for pre in pres])

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian 16-bit integers."""
        return b"".join([ids.tobytes() for ids, _ in self.column(pa.array([text]))])

    def _around(self, text: str) -> bytes:
        """Ids of a text that holds special tokens: what lies between them is encoded apart."""
        out, last = [], 0
        for hit in self.m.cut_special.finditer(text):
            out += [self.encode(text[last : hit.start()]), array("H", [self.m.special[hit.group()]]).tobytes()]
            last = hit.end()
        return b"".join([*out, self.encode(text[last:])])

    def column(self, column: pa.Array):
        """Blocks of (ids, number of each row), as `column_ids` gives them."""
        return column_ids(column, self.pieces, self.m.cut_special, self._around, BLOCK_BYTES)


class Decoder:
    """Ids to text, in parts: bytes of a character that is not yet whole wait in the machine's state."""

    def __init__(self, merges: Merges):
        self.bytes = [merges.bytes.get(i, b"") for i in range(max(merges.bytes) + 1)]
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.machine.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def finish(self) -> str:
        out = self.machine.decode(b"", True)
        self.machine.reset()
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """docs with columns `ids` (little-endian 16-bit integers) and `n_tokens`; clashing columns of docs are replaced."""
    path = path or default_path()
    src = docs.drop("ids", "n_tokens")
    names = src.columns
    at = names.index(text)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            ids = [x.tobytes() for flat, n in enc.column(batch.column(at)) for x in np.split(flat, np.cumsum(n)[:-1])] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array([len(x) // 2 for x in ids], pa.int64())], [*names, "ids", "n_tokens"])

    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]))


def round_trip(docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str | None = None, part: int = 65536, keep_ids: bool = False) -> DataFrame:
    """Per document: its number of tokens, digests of its ids and of the text decoded from them, and whether that is the text;
    with keep_ids also the ids as little-endian 16-bit integers."""
    path = path or default_path()
    src = docs.select(F.col(id_col), F.col(text).alias("__text"))

    def run(batches):
        enc = encoder(path)
        dec = Decoder(enc.m)
        for batch in batches:
            n, a, b, kept = [], [], [], []
            for flat, sizes in enc.column(batch.column(1)):
                end = 0
                for size in sizes.tolist():
                    ids, end = flat[end : end + size], end + size
                    digest, sha = hashlib.sha256(), hashlib.sha256()
                    for at in range(0, size, part):
                        some = ids[at : at + part]
                        sha.update(some.astype("<u4").tobytes())
                        digest.update(dec.feed(some.tolist()).encode())
                    digest.update(dec.finish().encode())
                    n.append(size)
                    kept.append(ids.tobytes() if keep_ids else b"")
                    a.append(sha.hexdigest())
                    b.append(digest.hexdigest())
            same = [hashlib.sha256((x or "").encode()).hexdigest() == y for x, y in zip(batch.column(1).to_pylist(), b)]
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(same, pa.bool_()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns if keep_ids else columns[:5], names)
        enc.forget()
        give_back()

    kind = src.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "exact", *(["ids"] if keep_ids else [])]
    return src.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean" + (", ids binary" if keep_ids else ""))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
