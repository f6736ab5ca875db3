"""Token ids as canonical length-limited Huffman code, in files of independent blocks with bit-offset checkpoints.

Texts are dealt out by ranges of doc_id and sorted, so files hold ids in ascending order of doc_id (null first; rows of equal
id by the first characters of their text, then as the table has them). A segment is one row of a file: ids and lengths of its documents, the number of ids before it in its file, the
bit stream, and the bit offset of each block of BLOCK ids. Any block can be decoded alone; a segment decodes all its blocks
at once, one table lookup per id. Nulls and empty texts are documents of just the end id; a text longer than a segment is a
segment of its own. Other columns are ignored. An empty table gives files without segments.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_letters, default_path
from .common import blocks, deleted, shared_folder, table, text_bytes
from .pieces import Remembered, column_ids

LIMIT = 20  # longest code in bits
BLOCK = 512  # ids between checkpoints
SEGMENT = 1 << 20  # ids in a segment, but for a longer document
PART_BYTES = 16_000_000  # of text in a file
HEAD_CHARS = 32  # of a text that order rows of equal id


# --- code ------------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for all symbols with a count, by package-merge; 0 for the others."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(symbols)
    if n <= 1:
        lengths[symbols] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit in codes of {limit} bits")
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    weights = counts[order].astype(np.int64)
    levels = []
    row, leaf = weights, np.ones(n, bool)
    for _ in range(limit):
        levels.append(leaf)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((weights, pairs))
        at = np.argsort(both, kind="stable")
        row, leaf = both[at], at < n
    take = 2 * n - 2
    for leaf in levels[::-1]:
        used = int(leaf[:take].sum())
        lengths[order[:used]] += 1
        take = 2 * (take - used)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for s in order[lengths[order] > 0].tolist():
        size = int(lengths[s])
        code <<= size - last
        codes[s] = code
        code, last = code + 1, size
    return codes


def lookup(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length for every value of the next `bits` bits."""
    bits = int(lengths.max(initial=1))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    widths = 1 << (bits - lengths[order].astype(np.int64))
    symbols = np.zeros(1 << bits, np.uint16)
    sizes = np.ones(1 << bits, np.uint8)
    full = int(widths.sum())
    symbols[:full] = np.repeat(order, widths)
    sizes[:full] = np.repeat(lengths[order], widths)
    return symbols, sizes, bits


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bit stream, and the bit offset of each block."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = lengths[ids].astype(np.int64)
    at = np.cumsum(size) - size
    total = int(at[-1] + size[-1])
    words = np.zeros(total // 64 + 2, np.uint64)
    word, off = at >> 6, at & 63
    left = 64 - off - size
    code = codes[ids]
    here = np.where(left >= 0, code << np.maximum(left, 0).astype(np.uint64), code >> np.maximum(-left, 0).astype(np.uint64))
    heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    words[word[heads]] = np.add.reduceat(here, heads)
    over = np.flatnonzero(left < 0)
    words[word[over] + 1] += code[over] << (64 + left[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (total + 7) // 8], at[::BLOCK].copy()


def unpack(stream: bytes, checkpoints: np.ndarray, n: int, tables: tuple[np.ndarray, np.ndarray, int], block: int | None = None) -> np.ndarray:
    """All n ids, or those of one block."""
    symbols, sizes, bits = tables
    raw = np.frombuffer(stream + b"\0" * 16, np.uint8)
    view = np.ndarray(len(raw) - 7, ">u8", raw, strides=(1,))
    at = np.array(checkpoints if block is None else checkpoints[block : block + 1], np.int64)
    out = np.zeros((BLOCK, len(at)), np.uint16)
    shift, last = np.uint64(64 - bits), len(view) - 1
    for i in range(min(BLOCK, n)):
        key = (view[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint64)) >> shift
        out[i] = symbols[key]
        at += sizes[key]
    flat = out.T.reshape(-1)
    return flat[:n] if block is None else flat[: min(BLOCK, n - block * BLOCK)]


# --- tokens ----------------------------------------------------------------------------------------------------------


#: Letters below U+0180, in which all versions of Unicode agree.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_SIMPLE = re.compile("(?: (?!\n))?[\n!-~\u00c0-\u017f]+")
_PARTS = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{_LETTER}]+| ?[0-9]+| ?[^ \n0-9{_LETTER}]+|\n+(?![^\n])|\n")


class Tokens:
    """Ids by the tokenizers library. A piece of simple characters is cut into pre-tokens here, and the library's model encodes those not yet known; any other piece goes through the whole library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_padding()
        self.t.no_truncation()
        if self.t.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path}: ids of this module take 16 bits")
        special = "|".join(re.escape(x.content) for x in self.t.get_added_tokens_decoder().values())
        self.special = re.compile(special) if special else None
        spec = json.loads(self.t.to_str())
        cut = spec["pre_tokenizer"] or {}
        usual = spec["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"] and spec["model"]["type"] == "BPE"
        self.model, self.simple = self.t.model.tokenize, _SIMPLE.fullmatch if usual else lambda piece: None
        self.letters = {b: letter for letter, b in byte_letters().items()}
        self.pieces = Remembered(self._piece)

    def _library(self, text: str) -> bytes:
        return np.array(self.t.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2").tobytes()

    def _word(self, pre: bytes) -> bytes:
        """Ids of one pre-token."""
        return array("H", [x.id for x in self.model(pre.decode("latin-1").translate(self.letters))]).tobytes()

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode()
        if not self.simple(text):
            return self._library(text)
        parts = _PARTS.findall(text)
        return self._word(piece) if len(parts) == 1 else b"".join([self.pieces(x.encode()) for x in parts])

    def column(self, column: pa.Array):
        """Blocks of (ids, number of each row), as `column_ids` gives them."""
        return column_ids(column, self.pieces, self.special, self._library)


_TOKENS: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each row's ids."""
    out = np.full(len(ids) + len(sizes), end_id, np.uint16)
    ends = np.cumsum(sizes + 1) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = ids
    return out, sizes + 1


def sparse(counts: np.ndarray) -> bytes:
    """Ids with a count, then their counts, both as 64-bit integers."""
    at = np.flatnonzero(counts)
    return np.concatenate((at, counts[at])).astype("<i8").tobytes()


def token_segments(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 2) -> DataFrame:
    """Encoded documents in ascending order of id_col: rows (part, before, doc_ids, lens, ids, counts), parts by ranges.

    Rows of one id follow by the first characters of their text, then in the order of the table; ranges are cut by all three,
    so no id, however common, has to fit in one task."""
    path = path or default_path()
    parts = blocks(text_bytes(docs, text), PART_BYTES)
    order = [F.col("id").asc_nulls_first(), "head", "row"]
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumns({"head": F.substring("text", 1, HEAD_CHARS), "row": F.monotonically_increasing_id()})
    src = src.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text", F.spark_partition_id().alias("part"))

    def run(batches):
        enc, before, part = tokens_of(path), 0, 0
        names = ["part", "before", "doc_ids", "lens", "ids", "counts"]
        held: list = []
        size = 0

        def segment():
            ids = np.concatenate([x[2] for x in held])
            lens = np.concatenate([x[1] for x in held])
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([pa.concat_arrays([x[0] for x in held])], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())), pa.array([ids.tobytes()], pa.binary()), pa.array([sparse(np.bincount(ids, minlength=1 << 16))], pa.binary())], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            part, at = batch.column(2)[0].as_py(), 0
            for ids, sizes in enc.column(batch.column(1)):
                ids, sizes = with_end(ids, sizes, end_id)
                ends = np.cumsum(sizes)
                a = 0
                while a < len(sizes):  # a row that passes SEGMENT ends its segment
                    base = ends[a] - sizes[a]
                    b = min(len(sizes), int(np.searchsorted(ends, base + SEGMENT - size)) + 1)
                    held.append((batch.column(0).slice(at + a, b - a), sizes[a:b], ids[base : ends[b - 1]]))
                    size += int(ends[b - 1] - base)
                    a = b
                    if size >= SEGMENT:
                        yield segment()
                        before, held, size = before + size, [], 0
                at += len(sizes)
        if held:
            yield segment()

    return src.mapInArrow(run, "part int, before long, doc_ids array<long>, lens array<long>, ids binary, counts binary")


def count_ids(segments: DataFrame) -> np.ndarray:
    """Global count of each id; what reaches the driver is a row per id at most."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column(0):
                at, n = np.frombuffer(x.as_buffer(), "<i8").reshape(2, -1)
                total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["id", "n"])

    counts = np.zeros(1 << 16, np.int64)
    for r in segments.select("counts").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    return counts


# --- files -----------------------------------------------------------------------------------------------------------


def write_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 2) -> None:
    """Writes `folder`/code (the code's lengths) and `folder`/data (segments)."""
    spark = docs.sparkSession
    token_segments(docs, id_col, text, path, end_id).write.option("compression", "zstd").parquet(f"{folder}/ids")
    segments = spark.read.parquet(f"{folder}/ids")  # counts are read alone, ids without them
    lengths = code_lengths(count_ids(segments))
    spark.createDataFrame([(bytearray(lengths.tobytes()), BLOCK)], "lengths binary, block int").coalesce(1).write.parquet(f"{folder}/code")

    def run(batches):
        codes = canonical(lengths)
        for batch in batches:
            stream, marks = [], []
            for x in batch.column(4):
                s, m = pack(np.frombuffer(x.as_buffer(), "<u2"), codes, lengths)
                stream.append(s)
                marks.append(m)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(stream, pa.binary()), pa.array(marks, pa.list_(pa.int64()))], ["part", "before", "doc_ids", "lens", "stream", "checkpoints"])

    coded = segments.drop("counts").mapInArrow(run, "part int, before long, doc_ids array<long>, lens array<long>, stream binary, checkpoints array<long>")
    coded.write.option("compression", "uncompressed").parquet(f"{folder}/data")
    deleted(spark, f"{folder}/ids")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded documents: doc_id, start, n_tokens, ids_crc32, one row each."""
    head = spark.read.parquet(f"{folder}/code").first()
    lengths = np.frombuffer(bytes(head.lengths), np.uint8)
    data = spark.read.parquet(f"{folder}/data")
    sizes = {r.part: r.n for r in data.select("part", F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect()}
    starts, total = {}, 0
    for part in sorted(sizes):
        starts[part], total = total, total + sizes[part]

    def run(batches):
        tables = lookup(lengths)
        for batch in batches:
            for part, before, doc_ids, lens, stream, marks in zip(*(c for c in batch.columns)):
                size = lens.values.to_numpy()
                ids = unpack(stream.as_py(), marks.values.to_numpy(), int(size.sum()), tables).astype("<u4")
                ends = np.cumsum(size)
                begins = ends - size
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(begins + (starts[part.as_py()] + before.as_py()), pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return data.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    write_files(table(spark, sf_dir, "documents", 8 << 20), folder)  # distinct pieces are found per batch
    return read_files(spark, folder)
