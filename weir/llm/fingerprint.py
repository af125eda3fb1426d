"""Document fingerprints: threshold-scaled sketches of word shingles.

Every five-word shingle hash below a fixed fraction of the hash range (1 / SCALE) is kept. Sketches of a union are
unions of sketches, and because the threshold is the same for all texts, the share of one sketch in another estimates
containment even between very unequal documents. A fingerprint is the hex of a digest of the whole text, a colon, and
the kept hashes in ascending order, 8 hex digits each (the top 32 of their remaining bits).

Likeness of two fingerprints: Jaccard estimate, shared hashes by hashes of either; where neither kept a hash, 1 if the
digests are equal, else 0. Containment: shared hashes by those of the smaller sketch.

A text of n shingles keeps none of them with probability (7/8)^n: a third of the texts of 12 words, one in 400 of 50
words. Below that the likeness of a near copy is often 0, as if it were another text; equal texts have likeness 1 always.

Defined results: a null text counts as empty; an empty text keeps no hash; repeated ids are ordered by xxhash64 of the
text and the text; null ids come last; a single document is its own next one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE = 8
_LIMIT = np.uint64((1 << 64) // SCALE)
_SHIFT = np.uint64(64 - 32 - (SCALE.bit_length() - 1))


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The sorted kept hashes of every text, as uint32."""
    raw, offsets = common.utf8(pa.array(texts, pa.large_string()))
    words, at = common.word_hashes(raw, offsets)
    values, where = common.shingle_hashes(words, at)
    keep = values < _LIMIT
    count = np.concatenate([[0], np.cumsum(keep)])[where]
    kept = (values[keep] >> _SHIFT).astype(np.uint32)
    return [np.unique(kept[count[k] : count[k + 1]]) for k in range(len(texts))]


def fingerprint(text: str, sketch: np.ndarray) -> str:
    return hashlib.blake2b(text.encode(), digest_size=8).hexdigest() + ":" + sketch.astype(">u4").tobytes().hex()


def parse(text: str) -> tuple[str, np.ndarray]:
    digest, _, hashes = text.partition(":")
    return digest, np.frombuffer(bytes.fromhex(hashes), ">u4").astype(np.uint32)


def compare(a: str, x: np.ndarray, b: str, y: np.ndarray) -> tuple[float, float]:
    """Likeness and containment of two fingerprints, given as digest or text and sketch."""
    if not len(x) and not len(y):
        return (1.0, 1.0) if a == b else (0.0, 0.0)
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared), shared / max(1, min(len(x), len(y)))


def merge(prints: list[str]) -> np.ndarray:
    """The sketch of all the texts together."""
    return np.unique(np.concatenate([np.zeros(0, np.uint32), *[parse(p)[1] for p in prints]]))


def fingerprints(docs: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """id_cols and the fingerprint of every whole text."""
    common.tune(docs.sparkSession)
    rows = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(id_cols)], docs[text_col].alias("t"))
    keys = ", ".join(f"`k{i}` {rows.schema[i].dataType.simpleString()}" for i in range(len(id_cols)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(id_cols)).to_pylist()]
            made = [fingerprint(t, s) for t, s in zip(texts, sketches(texts))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(id_cols))], pa.array(made, pa.string())], [*[f"k{i}" for i in range(len(id_cols))], "fingerprint"])

    return rows.mapInArrow(common.lean(run), f"{keys}, fingerprint string").toDF(*id_cols, "fingerprint")


def _judged(pairs: list[tuple[tuple, tuple]]) -> list[tuple]:
    """pairs of (id, text, sketch) and the next document's (text, sketch): the rows of results."""
    edited = [text[: len(text) - len(text) // 3] + after[: len(text) // 3] for (_, text, _), (after, _) in pairs]
    return [
        (key, len(text), hashlib.sha256(new.encode()).hexdigest(), fingerprint(text, sketch), fingerprint(new, new_sketch))
        + compare(text, sketch, new, new_sketch)
        + compare(text, sketch, after, after_sketch)
        for ((key, text, sketch), (after, after_sketch)), new, new_sketch in zip(pairs, edited, sketches(edited))
    ]


_NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "held_edited", "near_next", "held_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
_SCHEMA = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, held_edited double, near_next double, held_next double"
DONE, HEAD, TAIL = 0, 1, 2


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint and the likenesses to the edited text and the next document.

    The edited text has the last third (code points, rounded down) replaced by as much of the start of the next document
    in descending order of the id. Texts are shuffled once, by Spark's range partitioning of the id, and sorted there.
    Each task judges its documents but the last, which is written with its text beside the task's first one; these few
    rows (two for each task) are then joined by the tasks' numbers. Nothing is gathered on the driver.
    """
    common.tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(max(1, docs.rdd.getNumPartitions()), *order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def made(kind: int, rows: list[tuple], texts: list[str | None]) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]
            return pa.RecordBatch.from_arrays([pa.array([task] * len(rows), pa.int64()), pa.array([kind] * len(rows), pa.int32()), pa.array(texts, pa.string()), *columns], ["task", "kind", "text", *_NAMES])

        def edge(kind: int, row: tuple) -> pa.RecordBatch:
            return made(kind, [(row[0], *[None] * (len(_NAMES) - 1))], [row[1]])

        last = None  # (id, text, sketch) of the row that still waits for its next one
        for batch in batches:
            texts = batch.column(1).to_pylist()
            pairs = []
            for row in zip(batch.column(0).to_pylist(), texts, sketches(texts)):
                if last is None:
                    yield edge(HEAD, row)
                else:
                    pairs.append((last, row[1:]))
                last = row
            if pairs:
                yield made(DONE, _judged(pairs), [None] * len(pairs))
        if last is not None:
            yield edge(TAIL, last)

    work = common.written(dealt.mapInArrow(common.lean(run), f"task long, kind int, text string, {_SCHEMA}"), "fingerprints")
    heads = work.filter(F.col("kind") == HEAD).select(F.col("task").alias("h_task"), F.col("text").alias("after"))
    tails = work.filter(F.col("kind") == TAIL).select("task", "id", "text")
    follows = common.next_numbers(heads, "h_task").select(F.col("h_task").alias("f_task"), "next")
    met = tails.join(follows, F.col("task") == F.col("f_task")).join(heads, F.col("next") == F.col("h_task")).select("id", "text", "after")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, texts, afters = (batch.column(k).to_pylist() for k in range(3))
                got = _judged(list(zip(zip(ids, texts, sketches(texts)), zip(afters, sketches(afters)))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), _TYPES)], _NAMES)

    done = work.filter(F.col("kind") == DONE).select(*_NAMES)
    return done.unionByName(met.mapInArrow(common.lean(close), _SCHEMA)).withColumnRenamed("id", id_col)
