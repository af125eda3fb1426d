"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each whole text becomes a row of numbers (shares of character classes, word and line statistics, repetition), counted
by numpy over the bytes of a batch. Trees are fitted on a bounded sample of labelled rows (SAMPLE_ROWS rows of
numbers; no text reaches the driver) with logistic loss: features are cut into at most BINS bins at quantiles,
gradients are summed by node, feature and bin, and every level's best cut is taken. All trees lie flattened in five
arrays, through which a batch walks level by level.

Defined results: a null text counts as empty and is scored like any other; without labelled rows of both kinds every
score is the mean label (0.5 without any); repeated rows stay repeated; other columns don't take part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that the trees are fitted on, about; they are chosen by a hash of the id.
SAMPLE_ROWS = 20_000
BINS, TREES, DEPTH, RATE, LEAST_ROWS, RIDGE = 64, 80, 4, 0.15, 8, 1.0
#: A score from here on predicts label 1.
CUT = 0.3

_CLASSES = {
    "lower": range(97, 123),
    "upper": range(65, 91),
    "digit": range(48, 58),
    "blank": (32, 9),
    "newline": (10, 13),
    "high": range(128, 256),
    "stop": (46,),
    "comma": (44,),
    "bang": (33,),
    "pipe": (124,),
    "percent": (37, 36, 38, 42, 35),
    "quote": (34, 39),
    "bracket": (40, 41, 60, 62, 91, 93, 123, 125),
    "other": (43, 45, 47, 58, 59, 61, 63, 64, 92, 94, 95, 96, 126),
}
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _k, _bytes in enumerate(_CLASSES.values()):
    _CLASS[list(_bytes)] = _k
FEATURES = [
    "log_bytes",
    "log_words",
    "bytes_per_word",
    *_CLASSES,
    "distinct_words",
    "top_word",
    "distinct_shingles",
    "top_shingle",
    "log_lines",
    "distinct_lines",
    "words_per_line",
    "words_per_stop",
    "upper_words",
    "marked_words",
]


def _distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the share of distinct values and the share of the most frequent one; 1 and 0 for empty rows."""
    n = len(offsets) - 1
    share, top = np.ones(n), np.zeros(n)
    for k in range(n):
        part = values[offsets[k] : offsets[k + 1]]
        if len(part):
            part = np.sort(part)
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            share[k], top[k] = (len(edges) - 1) / len(part), np.diff(edges).max() / len(part)
    return share, top


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n, sizes = len(offsets) - 1, np.diff(offsets).astype(np.float64)
    out = np.zeros((n, len(FEATURES)), np.float64)
    col = {name: k for k, name in enumerate(FEATURES)}
    shares = np.zeros((n, len(_CLASSES) + 1))
    for k in range(n):
        shares[k] = np.bincount(_CLASS[raw[offsets[k] : offsets[k + 1]]], minlength=len(_CLASSES) + 1)
    words, at = common.word_hashes(raw, offsets)
    count = np.diff(at).astype(np.float64)
    shingles, where = common.shingle_hashes(words, at)
    out[:, col["log_bytes"]], out[:, col["log_words"]] = np.log1p(sizes), np.log1p(count)
    out[:, col["bytes_per_word"]] = sizes / np.maximum(count, 1)
    out[:, 3 : 3 + len(_CLASSES)] = shares[:, :-1] / np.maximum(sizes, 1)[:, None]
    out[:, col["distinct_words"]], out[:, col["top_word"]] = _distinct(words, at)
    out[:, col["distinct_shingles"]], out[:, col["top_shingle"]] = _distinct(shingles, where)
    lines = [[zlib.crc32(x) for x in raw[offsets[k] : offsets[k + 1]].tobytes().split(b"\n") if x] for k in range(n)]
    line_at = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
    flat = np.array([h for x in lines for h in x], np.int64)
    out[:, col["distinct_lines"]] = _distinct(flat, line_at)[0]
    n_lines = np.diff(line_at)
    out[:, col["log_lines"]], out[:, col["words_per_line"]] = np.log1p(n_lines), np.log1p(count / np.maximum(n_lines, 1))
    out[:, col["words_per_stop"]] = np.log1p(count / (1 + shares[:, list(_CLASSES).index("stop")]))
    # words of capitals only, and words that end with a mark other than a stop or comma
    if len(raw):
        solid = ~common._IS_SPACE[raw]
        last = solid & np.concatenate([~solid[1:], [True]])
        ends = offsets[1:-1] - 1
        last[ends[ends >= 0]] |= solid[ends[ends >= 0]]
        before = np.concatenate([[0], np.cumsum(last & ((raw < 48) | ((raw > 57) & (raw < 65)) | ((raw > 90) & (raw < 97)) | ((raw > 122) & (raw < 128))) & (raw != 46) & (raw != 44))])
        out[:, col["marked_words"]] = (before[offsets[1:]] - before[offsets[:-1]]) / np.maximum(count, 1)
        capital = (raw >= 65) & (raw <= 90)
        pair = np.concatenate([capital[:-1] & capital[1:], [False]])
        seen = np.concatenate([[0], np.cumsum(pair)])
        out[:, col["upper_words"]] = (seen[offsets[1:]] - seen[offsets[:-1]]) / np.maximum(sizes, 1)
    return out


@dataclass
class Forest:
    """Node k of all trees: feature, threshold (left if not above), left and right child (a leaf is its own), value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.roots) and len(x):
            node = np.repeat(self.roots[None, :], len(x), axis=0)
            rows = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boosts trees of regression on the logistic loss."""
    mean = float(y.mean()) if len(y) else 0.5
    base = float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6)))
    none = np.zeros(0)
    if len(y) == 0 or mean in (0.0, 1.0):
        return Forest(none, none, none, none, none, np.zeros(0, np.int64), base, 0)
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(m)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(m)], axis=1)
    slots = np.arange(m) * BINS
    total = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        k = len(feature)
        for a, v in ((feature, 0), (threshold, 0.0), (left, k), (right, k), (value, 0.0)):
            a.append(v)
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        roots.append(node())
        where, open_nodes = np.zeros(n, np.int64), [roots[-1]]  # where: the index into open_nodes, -1 once in a leaf
        leaf = np.full(n, roots[-1])
        for level in range(depth + 1):
            if not open_nodes:
                break
            rows = np.flatnonzero(where >= 0)
            w = where[rows]
            sums = [np.bincount(w, a[rows], len(open_nodes)) for a in (g, h)]
            if level == depth:
                for k, at in enumerate(open_nodes):
                    value[at] = -RATE * sums[0][k] / (sums[1][k] + RIDGE)
                break
            key = (w[:, None] * (m * BINS) + slots[None, :] + binned[rows]).ravel()
            size = len(open_nodes) * m * BINS
            gh = [np.bincount(key, np.repeat(a[rows], m), size).reshape(len(open_nodes), m, BINS).cumsum(axis=2) for a in (g, h)]
            cn = np.bincount(key, minlength=size).reshape(len(open_nodes), m, BINS).cumsum(axis=2)
            G, H, C = gh[0][:, :, -1:], gh[1][:, :, -1:], cn[:, :, -1:]
            gain = gh[0] ** 2 / (gh[1] + RIDGE) + (G - gh[0]) ** 2 / (H - gh[1] + RIDGE) - G**2 / (H + RIDGE)
            gain[(cn < LEAST_ROWS) | (C - cn < LEAST_ROWS)] = 0
            after, moved = [], np.full(n, -1, np.int64)
            for k, at in enumerate(open_nodes):
                f, b = divmod(int(gain[k].argmax()), BINS)
                if gain[k, f, b] <= 1e-6 or b >= len(cuts[f]):
                    value[at] = -RATE * sums[0][k] / (sums[1][k] + RIDGE)
                    continue
                feature[at], threshold[at], left[at], right[at] = f, float(cuts[f][b]), node(), node()
                mine = rows[w == k]
                low = binned[mine, f] <= b
                moved[mine[low]], moved[mine[~low]] = len(after), len(after) + 1
                leaf[mine[low]], leaf[mine[~low]] = left[at], right[at]
                after += [left[at], right[at]]
            where, open_nodes = moved, after
        total += np.array(value)[leaf]
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), base, depth)


def _featured(docs: DataFrame, id_cols: tuple[str, ...], text_col: str, forest) -> DataFrame:
    """id_cols and, without a forest, the array of features; else the score."""
    common.tune(docs.sparkSession)
    # the text is sent once, also where it is kept
    text_at = id_cols.index(text_col) if text_col in id_cols else len(id_cols)
    rows = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(id_cols)], *([] if text_at < len(id_cols) else [docs[text_col].alias("t")]))
    keys = ", ".join(f"`k{i}` {rows.schema[i].dataType.simpleString()}" for i in range(len(id_cols)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = statistics(*common.utf8(batch.column(text_at)))
            made = pa.array(list(x), pa.list_(pa.float64())) if forest is None else pa.array(forest.value.score(x), pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(id_cols))], made], [*[f"k{i}" for i in range(len(id_cols))], "made"])

    return rows.mapInArrow(common.lean(run), f"{keys}, made {'array<double>' if forest is None else 'double'}").toDF(*id_cols, "features" if forest is None else "score")


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Trains on about sample_rows of the labelled rows (where `learn` holds on docs, if given).

    Labels are thinned by a hash of the id before the join, so what is joined and featured is bounded too.
    """
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("y")).filter(F.col("y").isNotNull() & F.col("label_id").isNotNull())
    known = known.groupBy("label_id").agg(F.max("y").alias("y"))  # a repeated label counts once
    n = known.count()
    if not n:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0))
    draw = F.pmod(F.xxhash64(F.col("label_id").cast("string")), F.lit(1_000_003)) / 1_000_003.0
    known = known.filter(draw < min(1.0, sample_rows / n))
    rows = docs if learn is None else docs.filter(learn)
    joined = rows.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("d_text")).join(F.broadcast(known), F.col("d_id") == F.col("label_id"))
    got = _featured(joined, ("y",), "d_text", None).limit(2 * sample_rows).toPandas()
    if not len(got):
        return train(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.stack(got["features"].to_numpy()), got["y"].to_numpy()
    order = np.lexsort((*x.T, y))  # reruns see the same order
    return train(x[order], y[order])


def score(docs: DataFrame, forest: Forest, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """id_cols, score (0 to 1), predicted (1 from CUT on)."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)
    return _featured(docs, id_cols, text_col, sent).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
