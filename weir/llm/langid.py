"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is its byte n-grams of 2 to 4 bytes (A-Z lower-cased, white space folded to a blank), hashed into buckets; its
vector is the mean of their embeddings, and a linear layer with softmax gives languages. Embeddings and layer are
trained together by stochastic gradient descent in numpy on a bounded sample of labelled rows (SAMPLE_ROWS), each
seen whole and as short snippets, so that short texts are in the training as well. Because the mean is linear, a
trained model is used as one table of bucket by language, and a batch of whole texts is scored by gathers and sums.

Calibration: a fifth of the sample isn't trained on; it fixes the softmax temperature (least log loss). Rejection goes
by the margin, the best language's logit less the second's, before the temperature. What texts in no learned language
score is learned from the sample: for each of the LEFT_OUT most frequent languages a small model is trained without it
and judges its held-out texts, and held-out texts are judged with their bytes shuffled. The threshold is the margin that
REJECTED of these stay below, but not more than what LOST of the held-out texts in learned languages stay below.

Defined results: a null text, or one without a letter, is `und` with score 0 and rejected; without any labelled row
all are; rows with a null language teach nothing; repeated rows stay repeated; other columns don't take part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled documents that the classifier is fitted on, about, and their bytes; they are chosen by a hash of the id.
SAMPLE_ROWS, SAMPLE_BYTES = 2400, 24 << 20
#: Longer texts (bytes) aren't learned from: few of them would fill the sample. They are judged whole like any other.
LONGEST = 96 << 10
#: With more learned languages than this, fitting is refused (the table has a quarter MB for each).
MOST_LANGUAGES = 1000
BUCKETS, DIM, ORDERS = 1 << 16, 16, (2, 3, 4)
EPOCHS, RATE, SNIPPETS = 3, 4.0, 3
LEFT_OUT, REJECTED, LOST = 4, 0.99, 0.002
UND = "und"

_FOLD = common._LOWER.copy()
_FOLD[common._IS_SPACE] = 32
_MUL = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def ngram_buckets(raw: np.ndarray) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram at each place of the bytes."""
    b = _FOLD[raw].astype(np.uint32)
    out, gram = [], b
    for n in range(2, max(ORDERS) + 1):
        if len(b) < n:
            gram = np.zeros(0, np.uint32)
        else:
            gram = gram[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :]
        if n in ORDERS:
            k = ORDERS.index(n)
            out.append(((gram * _MUL[k]) >> np.uint32(16)).astype(np.int64) & (BUCKETS - 1))
    return out


def has_letter(raw: bytes) -> bool:
    return re.search(rb"[A-Za-z]", raw) is not None or any(c.isalpha() for c in raw.decode("utf-8", "ignore"))


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows of mean table entries plus bias; long batches go in parts, so that memory stays bounded."""
        n = len(offsets) - 1
        sums, grams = np.zeros((n, len(self.langs))), np.zeros(n)
        reach = max(ORDERS) - 1
        for lo in range(0, len(raw), common.SEGMENT_BYTES):
            hi = min(lo + common.SEGMENT_BYTES, len(raw))
            part = raw[lo : min(hi + reach, len(raw))]
            a, z = int(np.searchsorted(offsets, lo, side="right")) - 1, int(np.searchsorted(offsets, hi, side="left"))
            starts, ends = np.maximum(offsets[a:z] - lo, 0), np.minimum(offsets[a + 1 : z + 1] - lo, hi - lo + reach)
            total = np.zeros((hi - lo, len(self.langs)), np.float32)
            for order, buckets in zip(ORDERS, ngram_buckets(part)):
                buckets = buckets[: hi - lo]
                # an n-gram that would end behind its row's end counts nowhere
                over = ends[:, None] - np.arange(1, order)[None, :]
                over = over[(over >= starts[:, None]) & (over < len(buckets))]
                values = self.table[buckets]
                values[over] = 0
                total[: len(buckets)] += values
                grams[a:z] += np.clip(np.minimum(ends - order + 1, hi - lo) - starts, 0, None)
            full = np.flatnonzero((ends > starts) & (starts < hi - lo))
            if len(full):
                sums[a + full] += np.add.reduceat(total, starts[full], axis=0, dtype=np.float64)
        return sums / np.maximum(grams, 1)[:, None] + self.bias

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best language's index, its calibrated probability and its margin over the second one."""
        z = self.logits(raw, offsets)
        p = softmax(z / self.temperature)
        best = p.argmax(axis=1) if p.shape[1] else np.zeros(len(p), int)
        return best, p[np.arange(len(p)), best] if p.shape[1] else np.zeros(len(p)), margins(z)


def softmax(z: np.ndarray) -> np.ndarray:
    if not z.shape[1]:
        return z
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def margins(z: np.ndarray) -> np.ndarray:
    """Best less second best; without a second one nothing can be doubted."""
    if z.shape[1] < 2:
        return np.full(len(z), np.inf)
    top = np.partition(z, -2, axis=1)
    return top[:, -1] - top[:, -2]


def _joined(raws: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.uint8), *raws]), np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)


def _bag(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate(ngram_buckets(raw))
    ids, counts = np.unique(every, return_counts=True)
    return ids, (counts / max(1, len(every))).astype(np.float32)


def _descend(bags: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, epochs: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent over the bags; returns the table of bucket by language and the bias."""
    table = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
    layer, bias = (rng.standard_normal((DIM, n_langs)) * 0.3).astype(np.float32), np.zeros(n_langs, np.float32)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            ids, share, y = bags[k]
            rows = table[ids]
            v = share @ rows
            z = v @ layer + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y] -= 1
            done += 1
            if np.abs(g).max() < 1e-3:
                continue  # learned: the step would change next to nothing
            rate = np.float32(RATE * (1 - (done - 1) / steps))
            back = layer @ g
            layer -= (rate * 0.1) * np.outer(v, g)
            bias -= (rate * 0.01) * g
            # the share of an n-gram in a long text is small, so its row gets the square root's boost
            table[ids] = rows - np.outer(rate * share * np.float32(np.sqrt(len(ids))), back)
    return (table @ layer).astype(np.float32), bias.astype(np.float64)


def train(texts: list[str], langs: list[str], seed: int = 5) -> Model:
    """Fits embeddings and softmax layer; the texts are whole."""
    names = sorted(set(langs))
    if len(names) < 2:
        return Model(names, np.zeros((BUCKETS, len(names)), np.float32), np.zeros(len(names)))
    rng = np.random.default_rng(seed)
    order = np.argsort([zlib.crc32(t.encode()) for t in texts], kind="stable")
    raws = [np.frombuffer(texts[k].encode(), np.uint8) for k in order]
    ys = np.array([names.index(langs[k]) for k in order])
    cut = max(1, len(raws) // 5)
    held, held_y = raws[:cut], ys[:cut]
    whole = [(*_bag(raw), int(y)) for raw, y in zip(raws[cut:], ys[cut:])]
    snippets: list[tuple[np.ndarray, np.ndarray, int]] = []
    for raw, y in zip(raws[cut:], ys[cut:]):
        for _ in range(SNIPPETS):
            size = int(rng.integers(12, 160))
            at = int(rng.integers(0, max(1, len(raw) - size)))
            snippets.append((*_bag(raw[at : at + size]), int(y)))
    model = Model(names, *_descend(whole + snippets, len(names), EPOCHS, rng))
    z = model.logits(*_joined(held + [r[:80] for r in held]))
    y2 = np.concatenate([held_y, held_y])
    loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(y2)), y2], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.05, 20, 61), key=loss))
    unlearned = [margins(model.logits(*_joined([r[rng.permutation(len(r))] for r in held])))]
    if len(names) > 2:
        for out in np.argsort(-np.bincount(ys), kind="stable")[:LEFT_OUT]:
            others = [(ids, share, y - (y > out)) for ids, share, y in whole if y != out]
            strange = [r for r, y in zip(held, held_y) if y == out]
            if others and strange:
                unlearned.append(margins(Model(names[1:], *_descend(others, len(names) - 1, 1, rng)).logits(*_joined(strange))))
    known = margins(z[: len(held)])
    model.threshold = float(min(np.quantile(known, LOST), max(np.quantile(m, REJECTED) for m in unlearned)))
    return model


def fit(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Trains on about sample_rows of the rows with a text and a language (where `learn` holds, if given).

    Each language has an equal part of the sample's rows and bytes, so that a rare one isn't lost in it.
    """
    size = F.octet_length(F.col(text_col))
    rows = docs.filter(F.col(lang_col).isNotNull() & (size <= LONGEST))
    rows = rows if learn is None else rows.filter(learn)
    found = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if not found:
        return train([], [])
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: raise MOST_LANGUAGES or map them first")
    each, each_bytes = sample_rows / len(found), SAMPLE_BYTES // len(found)
    share = F.element_at(F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, each / r["n"], each_bytes / max(1, r["bytes"])))]), F.col(lang_col))
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.crc32(F.encode(F.col(text_col), "UTF-8"))), F.lit(1_000_003)) / 1_000_003.0
    got = rows.filter(draw < share).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).limit(2 * sample_rows).collect()
    got.sort(key=lambda r: (r["t"], r["l"]))
    return train([r["t"] for r in got], [r["l"] for r in got])


def identify(docs: DataFrame, model: Model, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """id_cols, lang_pred, score, rejected; the text column is read but not returned unless it is among id_cols."""
    spark = docs.sparkSession
    common.tune(spark)
    sent = spark.sparkContext.broadcast(model)
    # the text is sent once, also where it is kept
    text_at = id_cols.index(text_col) if text_col in id_cols else len(id_cols)
    rows = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(id_cols)], *([] if text_at < len(id_cols) else [docs[text_col].alias("t")]))
    keys = ", ".join(f"`k{i}` {rows.schema[i].dataType.simpleString()}" for i in range(len(id_cols)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, offsets = common.utf8(batch.column(text_at))
            letters = np.concatenate([[0], np.cumsum(_LETTER[raw])])
            some = letters[offsets[1:]] > letters[offsets[:-1]]
            for k in np.flatnonzero(~some):
                some[k] = has_letter(raw[offsets[k] : offsets[k + 1]].tobytes())
            some &= bool(m.langs)
            best, p, margin = m.predict(raw, offsets)
            pred = [m.langs[b] if ok else UND for b, ok in zip(best, some)]
            p = np.where(some, np.clip(p, 0.0, 1.0), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(id_cols))], pa.array(pred, pa.string()), pa.array(p, pa.float64()), pa.array(~some | (margin < m.threshold))],
                [*[f"k{i}" for i in range(len(id_cols))], "lang_pred", "score", "rejected"],
            )

    out = rows.mapInArrow(common.lean(run), f"{keys}, lang_pred string, score double, rejected boolean")
    return out.toDF(*id_cols, "lang_pred", "score", "rejected")

