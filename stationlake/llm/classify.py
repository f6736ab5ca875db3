"""Two document classifiers: counterfactually regularised toxicity, and quality by Bradley-Terry pairwise ranking.

Both learn on the driver from at most SAMPLE labelled rows (those with the smallest hash of their id; a documented bound) and
score every whole text on the executors, in blocks of bounded size, with a model of fixed size. Labels, language, source and
id are no features, nor are other columns. Null and empty texts get the score of no features; they count as texts to learn
from too. Without usable labels (none, or of one kind only) all scores are 0.5. Rows of one id and text count once for
learning however often they are repeated; all are scored. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, remainder, table
from .textkit import ALNUM_WORDS, Words, hash_words, mix, row_blocks

SAMPLE = 8000  # labelled rows to learn from
SPACE = 22  # bits of the hashed feature space
PREFIXES = (5, 6, 7, 8)  # word beginnings in bytes, besides whole words
#: Identity terms that count as neutral mentions of a group (gazetteer, lower case).
IDENTITY = (
    "women men woman man girls boys gay lesbian straight transgender muslim muslims christian christians jewish jews hindu hindus buddhist atheist "
    "black white asian african european american mexican immigrants refugees disabled elderly young femmes hommes musulmans chrétiens juifs noirs "
    "frauen männer muslime christen juden schwarze mujeres hombres musulmanes cristianos judíos negros"
).split()


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text: str, sample: int) -> DataFrame:
    """(text, y, id, h) of the labelled rows of `sample` ids at most, rows equal in id and text once."""
    use = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("__id").isNotNull() & (remainder(F.col("__id"), 5) != 0)).distinct()
    use = use.orderBy(F.xxhash64(F.col("__id")), "__id", "y").limit(sample)
    found = docs.select(F.col(id_col).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(use), F.col("__key") == F.col("__id"))
    return found.groupBy(F.col("__id").cast("string").alias("id"), "y", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).select("text", "y", "id", "h")


def gathered(features: DataFrame, sample: int) -> pa.Table:
    """Features of `sample` rows at most, in an order that does not depend on how they were dealt out; only these reach the
    driver, however many texts an id has."""
    return features.orderBy(F.xxhash64("id"), "id", "y", "h").limit(sample).toArrow()


# --- toxicity --------------------------------------------------------------------------------------------------------


_TERM = re.compile("(?i)(?<![0-9A-Za-z\x80-\U0010ffff])(?:" + "|".join(sorted(IDENTITY, key=len, reverse=True)) + ")(?![0-9A-Za-z\x80-\U0010ffff])")


def swapped(text: str) -> str:
    """The counterfactual text: each identity term replaced by another one, which the term, its turn and the text's length
    choose; a text without any starts with one."""
    seed = zlib.crc32(str(len(text)).encode())
    other = lambda word, turn: IDENTITY[(IDENTITY.index(word) + 1 + zlib.crc32(f"{seed} {word} {turn}".encode()) % (len(IDENTITY) - 1)) % len(IDENTITY)]
    parts, last = [], 0
    for turn, hit in enumerate(_TERM.finditer(text)):
        word = hit.group().lower()
        parts += [text[last : hit.start()], other(word, turn) if word in IDENTITY else hit.group()]
        last = hit.end()
    return "".join([*parts, text[last:]]) if parts else f"{IDENTITY[seed % len(IDENTITY)]} {text}"


def hashed(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of whole words and word beginnings, with repeats. Identity terms have no beginnings, so that all that a
    term adds to a score is one weight."""
    words = Words(data, offs, ALNUM_WORDS)
    whole = words.hashes()
    feats, rows = [whole >> np.uint64(64 - SPACE)], [words.rows]
    size = words.ends - words.starts
    other = ~np.isin(whole, hash_words(IDENTITY))
    for p in PREFIXES:
        long = (size > p) & other
        feats.append(mix(words.hashes(p)[long] + np.uint64(p)) >> np.uint64(64 - SPACE))
        rows.append(words.rows[long])
    return np.concatenate(rows), np.concatenate(feats).astype(np.int64)


def feature_lists(texts: pa.Array) -> list[np.ndarray]:
    """Distinct features of each text."""
    out = []
    for a, b, data, offs in row_blocks(texts):
        row, feat = hashed(data, offs)
        both = np.unique(row << SPACE | feat)
        ends = np.searchsorted(both >> SPACE, np.arange(b - a + 1))
        out += [both[x:y] & ((1 << SPACE) - 1) for x, y in zip(ends[:-1], ends[1:])]
    return out


def change(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features that only the first has, and only the second."""
    return np.setdiff1d(own, other), np.setdiff1d(other, own)


def exchanged(features: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of identity terms and those that take their place; one is added where there are none."""
    own = np.intersect1d(features, group)
    shift = 1 + (len(features) * 7919 + int(features.sum() if len(features) else 0)) % (len(group) - 1)
    return own, group[(np.searchsorted(group, own) + shift) % len(group)] if len(own) else group[[shift]]


class Toxicity:
    """Sparse logistic model. Each text comes with its counterfactual, and what the swap changes in the score is penalised."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, int]], changes: list[tuple[np.ndarray, np.ndarray]] | None = None, penalty: float = 20.0, ridge: float = 0.3, rounds: int = 400) -> Toxicity:
        """rows: features of a text and its label; changes: features that its counterfactual text lacks, and that it has
        besides. Without these, features of identity terms are exchanged for other ones."""
        dim = 1 << SPACE
        y = np.array([r[1] for r in rows], float)
        if not len(y) or y.min() == y.max():
            return cls(np.zeros(dim, np.float32), 0.0)
        n, share = len(y), y.mean()
        group = np.unique((hash_words(IDENTITY) >> np.uint64(64 - SPACE)).astype(np.int64))
        changes = [exchanged(x, group) for x, _ in rows] if changes is None else changes

        def flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            return np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in lists]), np.concatenate([np.zeros(0, np.int32), *lists])

        row, feat = flat([x for x, _ in rows])
        total = np.bincount(feat, minlength=dim)
        often = np.flatnonzero(total >= 4)
        total, pos = total[often], np.bincount(feat, y[row], minlength=dim)[often]
        z = (pos - total * share) / np.sqrt(total * share * (1 - share) + 1)
        # Features that a swap changes are all in the model, so nothing that it changes escapes the penalty.
        keep = np.union1d(often[z >= 3.5], group)

        def kept(r: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(keep, f), len(keep) - 1)
            use = keep[at] == f
            return r[use], at[use]

        row, col = kept(row, feat)
        (gone_row, gone), (new_row, new) = (kept(*flat([c[i] for c in changes])) for i in (0, 1))
        w, b = np.zeros(len(keep)), float(np.log(share / (1 - share)))
        g2, b2 = np.full(len(keep), 1e-8), 1e-8
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], minlength=n) + b, -30, 30)))
            moved = np.bincount(new_row, w[new], minlength=n) - np.bincount(gone_row, w[gone], minlength=n)
            grad = np.bincount(col, (p - y)[row], minlength=len(keep)) + ridge * w
            grad += penalty * (np.bincount(new, moved[new_row], minlength=len(keep)) - np.bincount(gone, moved[gone_row], minlength=len(keep)))
            g2 += grad**2
            w -= 0.3 * grad / np.sqrt(g2)
            gb = (p - y).sum()
            b2 += gb**2
            b -= 0.3 * gb / np.sqrt(b2)
        out = np.zeros(dim, np.float32)
        out[keep] = w
        return cls(out, b)

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        row, feat = hashed(data, offs)
        hit = self.weights[feat] != 0
        both = np.unique(row[hit] << SPACE | feat[hit])
        sums = np.bincount(both >> SPACE, self.weights[both & ((1 << SPACE) - 1)], minlength=len(offs) - 1)
        return 1 / (1 + np.exp(-np.clip(sums + self.bias, -30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE, penalty: float = 20.0) -> Toxicity:
    def run(batches):
        packed = lambda lists: pa.array([x.astype("<i4").tobytes() for x in lists], pa.binary())
        for whole in batches:
            for a, b, _, _ in row_blocks(whole.column(0), 1 << 19):  # a few texts at a time, whatever a batch holds
                batch = whole.slice(a, b - a)
                own = feature_lists(batch.column(0))
                changes = [change(x, y) for x, y in zip(own, feature_lists(pa.array([swapped(t) for t in batch.column(0).to_pylist()], pa.string())))]
                yield pa.RecordBatch.from_arrays([packed(own), packed([c[0] for c in changes]), packed([c[1] for c in changes]), *batch.columns[1:]], ["x", "gone", "new", "y", "id", "h"])
        give_back()

    rows = gathered(labelled(docs, labels, "toxic", id_col, text, sample).mapInArrow(run, "x binary, gone binary, new binary, y int, id string, h long"), sample)
    own, gone, new = ([np.frombuffer(v.as_buffer(), "<i4") for chunk in rows.column(i).chunks for v in chunk] for i in range(3))  # views, not copies
    return Toxicity.fit(list(zip(own, rows.column(3).to_pylist())), list(zip(gone, new)), penalty)


# --- quality ---------------------------------------------------------------------------------------------------------

BINS = 12
PAIRS = 40_000
_CLASSES = {"|": "|", "odd": "#$%&*<>{}[]=~^@\\/_", "digit": "0123456789", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "line": "\n", "stop": ".!?", "comma": ",;:", "space": " "}


def measures(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Surface measures of each text: length, character classes, repetition of words, word pairs and lines."""
    n = len(offs) - 1
    size = np.diff(offs)
    words = Words(data, offs, ALNUM_WORDS)
    h = words.hashes()
    count = np.maximum(words.counts, 1)
    length = words.ends - words.starts
    rows = np.repeat(np.arange(n), size)
    share = [np.bincount(rows[np.isin(data, np.frombuffer(c.encode(), np.uint8))], minlength=n) / np.maximum(size, 1) for c in _CLASSES.values()]
    share.append(np.bincount(rows[data >= 0x80], minlength=n) / np.maximum(size, 1))

    def distinct(keys: np.ndarray, of: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct share and share of the commonest."""
        if not len(keys):
            return np.ones(n), np.zeros(n)
        order = np.lexsort((keys, of))
        k, r = keys[order], of[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])))
        at = np.flatnonzero(new)
        runs = np.diff(np.concatenate((at, [len(k)])))
        top = np.zeros(n)
        np.maximum.at(top, r[at], runs)
        return np.bincount(r[at], minlength=n) / per, top / per

    pair = np.flatnonzero(words.rows[1:] == words.rows[:-1]) if len(h) else np.zeros(0, np.int64)
    lines = Words(data, offs, np.arange(256) != 10)
    u1, t1 = distinct(h, words.rows, count)
    u2, t2 = distinct(mix(h[pair] * np.uint64(31) + h[pair + 1]) if len(pair) else h[:0], words.rows[pair], np.maximum(words.counts - 1, 1))
    u3, t3 = distinct(lines.hashes(), lines.rows, np.maximum(lines.counts, 1))
    mean = np.bincount(words.rows, length, minlength=n) / count
    dev = np.sqrt(np.maximum(np.bincount(words.rows, length.astype(float) ** 2, minlength=n) / count - mean**2, 0))
    short = np.bincount(words.rows[length <= 3], minlength=n) / count
    per_line = words.counts / np.maximum(lines.counts, 1)
    return np.stack([np.log1p(words.counts), np.log1p(size), mean, dev, short, np.log1p(per_line), u1, t1, u2, t2, u3, t3, *share], 1)


class Quality:
    """Score from binned measures; learnt from preference pairs, cut at a quantile of the scores."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, cut: float):
        self.edges, self.weights, self.cut = edges, weights, cut

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Number of each measure's bin in the weight vector."""
        return np.stack([np.searchsorted(self.edges[j], x[:, j], "right") + j * (BINS + 1) for j in range(x.shape[1])], 1)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-4, rounds: int = 300) -> Quality:
        dims = x.shape[1] if x.ndim == 2 else 0
        order = np.lexsort((y, *x.T)) if len(x) else np.zeros(0, np.int64)
        x, y = x[order], y[order]
        if not len(x) or y.min() == y.max():
            return cls(np.zeros((dims, BINS)), np.zeros(dims * (BINS + 1)), 0.0)
        q = np.linspace(0, 1, BINS + 2)[1:-1]
        both = np.concatenate((x[y == 1], np.repeat(x[y == 0], max(1, int((y == 1).sum() // max(1, (y == 0).sum()))), axis=0)))
        self = cls(np.quantile(both, q, axis=0).T, np.zeros(dims * (BINS + 1)), 0.0)
        f = self.binned(x)
        rng = np.random.default_rng(5)
        good, bad = rng.choice(np.flatnonzero(y == 1), pairs), rng.choice(np.flatnonzero(y == 0), pairs)
        w, g2 = self.weights, np.full(len(self.weights), 1e-8)
        for _ in range(rounds):
            s = w[f].sum(1)
            miss = 1 / (1 + np.exp(np.clip(s[good] - s[bad], -30, 30)))  # 1 - P(good beats bad)
            push = np.bincount(good, miss, minlength=len(y)) - np.bincount(bad, miss, minlength=len(y))
            grad = ridge * w * pairs - np.bincount(f.ravel(), np.repeat(push, dims), minlength=len(w))
            g2 += grad**2
            w -= 0.1 * grad / np.sqrt(g2)
        s = w[f].sum(1)
        cuts = np.quantile(s, np.linspace(0.005, 0.995, 199))
        right = [((s >= c) == (y == 1)).mean() + 0.25 * ((s < c)[y == 0]).mean() for c in cuts]
        self.cut = float(cuts[int(np.argmax(right))])
        return self

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        s = self.weights[self.binned(measures(data, offs))].sum(1) - self.cut
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)) * (0.7 / 0.3))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Quality:
    def run(batches):
        for batch in batches:
            x = [measures(data, offs) for _, _, data, offs in row_blocks(batch.column(0))]
            x = np.concatenate(x) if x else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), *batch.columns[1:]], ["x", "y", "id", "h"])

    t = gathered(labelled(docs, labels, "quality", id_col, text, sample).mapInArrow(run, "x array<double>, y int, id string, h long"), sample)
    width = measures(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    return Quality.fit(np.array(t.column(0).to_pylist(), float).reshape(-1, width), t.column(1).to_numpy().astype(int))


# --- scoring ---------------------------------------------------------------------------------------------------------


def scored(docs: DataFrame, model, column: str, text: str = "text") -> DataFrame:
    """docs with the model's score in `column`, which replaces one of that name."""
    src = docs.drop(column) if column != text else docs
    names = src.columns
    at = names.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = [sent.value.scores(data, offs) for _, _, data, offs in row_blocks(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *s]))], [*names, column])
        give_back()

    from pyspark.sql import types as T

    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(column, T.DoubleType())]))


def judged(docs: DataFrame, model, threshold: float, id_col: str = "doc_id") -> DataFrame:
    out = scored(docs.select(id_col, "text"), model, "score")
    return out.select(id_col, (remainder(F.col(id_col), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")), 0.5)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, fit_quality(docs, table(spark, sf_dir, "labels")), 0.3)


def crc(doc_id) -> int:
    """crc32 of an id as text, as the split uses it."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
