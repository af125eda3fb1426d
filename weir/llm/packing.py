"""Best-fit packing of tokenised documents into sequences of a fixed length.

A document's ids (with the end id) form one piece if they fit; longer ones are cut into full-length pieces behind a
first piece of the remainder. Pieces are packed by bounded-space online best-fit: at most `open_bins` bins are open, a
bitset has a bit for each amount of free space that some open bin has, and the lowest bit from the piece's length on
gives the fullest bin that takes it. If none does, a bin is opened; if all are open then, the fullest closes first.

Packing is dealt out in groups of about PIECES_PER_GROUP pieces by a hash, so that bins left open at a group's end
weigh little; pieces of full length need no bin. A group's pieces come in rounds of about ROUND pieces, the longest of a
round first, so that short ones fill what long ones left; bins stay open from round to round. Each row is placed as it
comes, so memory is bounded by the open bins. Groups and rounds follow from the number of pieces: other rows may be
packed beside one another at other sizes, but the same rules hold at every size.

Defined results: a null text is the end id alone; repeated rows are packed each; an empty table gives no sequence;
null ids are kept as they are; other columns don't take part, but columns named sequence_id or offset are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

LENGTH, OPEN_BINS, PIECES_PER_GROUP, ROUND, END_ID = 2048, 8192, 400_000, 8192, 0


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, piece, start, length, ids (little-endian unsigned 32-bit) of every piece of every document."""
    common.tune(docs.sparkSession)
    path = tokenizer or tokens.default_path()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.ChunkEncoder.of(path)
        for batch in common.gathered(batches):
            ids, at = encoder.encode_rows(batch.column(1), end_id)
            n = np.diff(at)
            count = -(-n // length)
            which = np.repeat(np.arange(len(n)), count)
            number = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            first = (n - 1) % length + 1
            start = np.where(number == 0, 0, first[which] + (number - 1) * length)
            size = np.where(number == 0, first[which], length)
            # pieces lie one behind another, as the ids do
            bounds = np.concatenate([[0], np.cumsum(size)])
            arrays = [batch.column(0).take(pa.array(which)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), common.binary_rows(ids.astype("<u4"), bounds)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "piece", "start", "length", "ids"])

    return rows.mapInArrow(common.lean(run), f"id {id_type}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


class Bins:
    """The open bins by free space."""

    def __init__(self, length: int, open_bins: int, first_id: int = 0):
        self.length, self.most, self.next_id = length, open_bins, first_id
        self.bits, self.at, self.open = 0, [[] for _ in range(length + 1)], 0

    def _take(self, free: int) -> int:
        stack = self.at[free]
        name = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return name

    def place(self, size: int) -> tuple[int, int]:
        """The bin and the offset in it of a piece of 1 to `length`."""
        higher = self.bits >> size
        if higher:
            free = size + (higher & -higher).bit_length() - 1
            name = self._take(free)
        else:
            free, name = self.length, self.next_id
            self.next_id += 1
            if self.open >= self.most and size < self.length:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        left = free - size
        if left:
            self.at[left].append(name)
            self.bits |= 1 << left
            self.open += 1
        return name, self.length - free


def pack(cut: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """The rows of cut (with a column `length` from 1 to length) plus sequence_id and offset.

    cut is written to the shared folder first: its count decides the number of groups, and tokenising it twice would
    cost far more.
    """
    names = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    plain = [f"c{k}" for k in range(len(names))]
    cut = common.written(cut.select(*[F.col(f"`{c}`") for c in names]).toDF(*plain), "pieces")
    size = plain[names.index("length")]
    n = cut.count()
    groups = max(1, -(-n // per_group))
    rounds = max(1, -(-n // (groups * ROUND)))
    order = [c for c, t in cut.dtypes if not t.startswith(("map", "array", "struct"))]
    deal = cut.withColumn("deal", F.xxhash64(*order)).withColumn("turn", F.pmod(F.shiftright("deal", 20), F.lit(rounds)))
    dealt = deal.repartition(groups, "deal").sortWithinPartitions("turn", F.desc(size), "deal", *order).drop("deal", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(length, open_bins, TaskContext.get().partitionId() << 40)
        for batch in batches:
            put = [bins.place(n) for n in batch.column(size).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in plain], pa.array([p[0] for p in put], pa.int64()), pa.array([p[1] for p in put], pa.int64())], [*plain, "sequence_id", "offset"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return dealt.mapInArrow(common.lean(run), f"{schema}, sequence_id long, offset long").toDF(*names, "sequence_id", "offset")
