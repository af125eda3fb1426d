"""Token-id files: canonical length-limited Huffman coding with global counts.

Counts of all ids give code lengths by package-merge (at most LIMIT bits, or what the number of ids needs), and the
lengths give canonical codes, so a file stores lengths only. A file holds whole documents: a header, the code lengths,
the documents (ids and lengths, as an Arrow stream), and blocks of BLOCK_TOKENS ids. Blocks are independent; each has
the bit length of every run of CHECKPOINT ids, so that decoding starts at any checkpoint, and all runs of a file are
decoded side by side with one table of 2^LIMIT entries.

Layout, little-endian: "WEIRTOK2", u32 header size, header JSON (limit, task, first_token, tokens, documents,
block and checkpoint sizes, section sizes), zlib of the code lengths (u8 each id), documents, block table (u64 offset
of each block's payload), checkpoints (u16 bits of each run), payload, u32 crc32 of all before.

Files go to a folder of the shared file system (any URI that pyarrow.fs opens) under a temporary name and are renamed,
so a task that is run again replaces the same file by the same bytes. Documents are dealt out by Spark's range
partitioning of the id; a task doesn't know how many ids others write, so first_token counts within the task, and the
folder's table `_bases` (Parquet: task, base) has the ids of all tasks before.

Defined results: a null text is the end id alone; null document ids come first; documents of equal id are ordered by
xxhash64 of their ids and by their ids' bytes; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import io
import json
import math
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

MAGIC, LIMIT, BLOCK_TOKENS, CHECKPOINT = b"WEIRTOK2", 16, 1 << 16, 64
#: A file is closed when it holds so many ids (a longer document has a file of its own).
FILE_TOKENS = 1 << 20
#: Ids that one task sorts and writes, about; small corpora have as many tasks as their tokenised table has.
RANGE_TOKENS = 32_000_000
#: Up to so many tasks their bases (16 bytes each) are broadcast to readers.
BROADCAST_BASES = 1_000_000
END_ID = 0
#: A larger cache and larger batches than elsewhere, some 150 MB a worker.
GENERATION, BATCH_BYTES = 400_000, 12 << 20


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for ids that don't occur."""
    lengths = np.zeros(len(counts), np.uint8)
    ids = np.flatnonzero(counts)
    if len(ids) <= 1:
        lengths[ids] = 1
        return lengths
    if len(ids) > 1 << limit:
        raise ValueError("the limit is too low for the number of ids")
    ids = ids[np.lexsort((ids, counts[ids]))]
    leaves = counts[ids].astype(np.float64)
    levels, items = [], leaves
    is_leaf = np.ones(len(leaves), bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        even = len(items) // 2 * 2
        packages = items[0:even:2] + items[1:even:2]
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        items, is_leaf = both[order], order < len(leaves)
    levels.append(is_leaf)
    take = 2 * len(ids) - 2
    for flags in reversed(levels):
        mine = int(flags[:take].sum())
        lengths[ids[:mine]] += 1
        take = 2 * (take - mine)
    return lengths


def limit_for(n_ids: int, limit: int = LIMIT) -> int:
    return max(limit, min(24, math.ceil(math.log2(max(2, n_ids))) + 1))


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    for k in np.lexsort((np.arange(len(lengths)), lengths)):
        n = int(lengths[k])
        if n:
            code <<= n - last
            codes[k], last = code, n
            code += 1
    return codes


class Code:
    """The tables of one set of code lengths."""

    _last: tuple[bytes, int, Code] | None = None

    def __init__(self, lengths: np.ndarray, limit: int):
        self.lengths, self.limit = lengths, limit
        self.codes = canonical_codes(lengths)
        self.wide_codes, self.wide_lengths = self.codes.astype(np.uint64), lengths.astype(np.int64)
        self.symbol = np.zeros(1 << limit, np.uint32)
        self.bits = np.ones(1 << limit, np.uint8)
        used = np.flatnonzero(lengths)
        used = used[np.lexsort((used, lengths[used]))]
        spans = 1 << (limit - lengths[used].astype(np.int64))
        total = int(spans.sum())
        self.symbol[:total], self.bits[:total] = np.repeat(used, spans), np.repeat(lengths[used], spans)

    @classmethod
    def of(cls, packed: bytes, limit: int) -> Code:
        """The last one is kept: all files of a run share their lengths."""
        if cls._last is None or cls._last[:2] != (packed, limit):
            cls._last = (packed, limit, cls(np.frombuffer(zlib.decompress(packed), np.uint8), limit))
        return cls._last[2]

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The packed bits (most significant first) and the bit length of every run of CHECKPOINT ids."""
        if not len(ids):
            return b"", np.zeros(0, np.uint16)
        n = self.wide_lengths[ids]
        end = np.cumsum(n)
        at = end - n
        shifted = self.wide_codes[ids] << (64 - (at & 31) - n).astype(np.uint64)
        word = at >> 5
        size = int(end[-1] + 31) // 32 + 1
        # bits of different ids don't overlap, so sums of 32-bit halves are exact
        high = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), size)
        high += np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), size)[:size] if size > 1 else 0
        data = high.astype(np.uint64).astype(">u4").tobytes()[: (int(end[-1]) + 7) // 8]
        return data, np.add.reduceat(n, np.arange(0, len(ids), CHECKPOINT)).astype(np.uint16)

    def decode(self, payload: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Runs of `sizes` ids that begin at the bits `starts`, side by side; returned in order."""
        if not len(starts):
            return np.zeros(0, np.uint32)
        b = np.concatenate([payload, np.zeros(8, np.uint8)]).astype(np.uint32)
        window = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
        out = np.zeros((int(sizes.max()), len(starts)), np.uint32)
        p, last, mask, room = starts.astype(np.int64), len(window) - 1, np.uint32((1 << self.limit) - 1), 32 - self.limit
        for k in range(len(out)):
            if room < 7:  # a long code may pass the 32 bits behind an odd bit offset
                wide = (window[np.minimum(p >> 3, last)].astype(np.uint64) << np.uint64(8)) | b[np.minimum((p >> 3) + 4, len(b) - 1)]
                index = (wide >> (8 + room - (p & 7)).astype(np.uint64)).astype(np.uint32) & mask
            else:
                index = (window[np.minimum(p >> 3, last)] >> (room - (p & 7)).astype(np.uint32)) & mask
            out[k] = self.symbol[index]
            p += self.bits[index]
        return out.T[np.arange(len(out))[None, :] < sizes[:, None]]


def write_file(documents: pa.RecordBatch, ids: np.ndarray, first_token: int, packed: bytes, limit: int, task: int = 0) -> bytes:
    """documents: doc_id, n_tokens, in file order; ids: theirs, one after another."""
    code = Code.of(packed, limit)
    payload, runs, offsets, at = [], [], [], 0
    for lo in range(0, len(ids), BLOCK_TOKENS):
        data, run = code.encode(ids[lo : lo + BLOCK_TOKENS])
        payload.append(data)
        runs.append(run)
        offsets.append(at)
        at += len(data)
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, documents.schema) as w:
        w.write_batch(documents)
    docs = zlib.compress(sink.getvalue(), 1)
    table = np.array(offsets, "<u8").tobytes()
    marks = (np.concatenate(runs) if runs else np.zeros(0, np.uint16)).astype("<u2").tobytes()
    body = b"".join(payload)
    head = json.dumps({"limit": limit, "task": task, "first_token": first_token, "tokens": len(ids), "documents": documents.num_rows, "block": BLOCK_TOKENS, "checkpoint": CHECKPOINT, "sections": [len(packed), len(docs), len(table), len(marks), len(body)]}).encode()
    whole = b"".join([MAGIC, struct.pack("<I", len(head)), head, packed, docs, table, marks, body])
    return whole + struct.pack("<I", zlib.crc32(whole))


class TokenFile:
    """A file's contents: documents, and ids of any range."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a whole token file")
        n = struct.unpack("<I", data[8:12])[0]
        self.head = json.loads(data[12 : 12 + n])
        at, parts = 12 + n, []
        for size in self.head["sections"]:
            parts.append(data[at : at + size])
            at += size
        self.code = Code.of(parts[0], self.head["limit"])
        self.documents = pa.ipc.open_stream(zlib.decompress(parts[1])).read_all().combine_chunks()
        self.offsets = np.frombuffer(parts[2], "<u8").astype(np.int64)
        self.marks = np.frombuffer(parts[3], "<u2").astype(np.int64)
        self.payload = np.frombuffer(parts[4], np.uint8)

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The ids from lo up to hi, counted in this file; only the blocks in that range are decoded."""
        total, block, every = self.head["tokens"], self.head["block"], self.head["checkpoint"]
        hi = total if hi is None else min(hi, total)
        if lo >= hi:
            return np.zeros(0, np.uint32)
        per = block // every
        first, last = lo // block, (hi - 1) // block
        starts, sizes = [], []
        base = int(self.offsets[first])
        for k in range(first, last + 1):
            run = self.marks[k * per : (k + 1) * per]
            starts.append((self.offsets[k] - base) * 8 + np.cumsum(run) - run)
            n = min(block, total - k * block)
            size = np.full(len(run), every)
            size[-1] = n - every * (len(run) - 1)
            sizes.append(size)
        end = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else len(self.payload)
        got = self.code.decode(self.payload[base:end], np.concatenate(starts), np.concatenate(sizes))
        return got[lo - first * block : hi - first * block]


def tokenize(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids: two bytes each where the vocabulary allows, else four."""
    common.tune(docs.sparkSession)
    path = tokenizer or tokens.default_path()
    width = np.dtype("<u2" if tokens.ChunkEncoder.of(path).vocabulary <= 1 << 16 else "<u4")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.ChunkEncoder.of(path, GENERATION)
        for batch in common.gathered(batches, BATCH_BYTES):
            ids, at = encoder.encode_rows(batch.column(1), end_id)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), common.binary_rows(ids.astype(width), at)], ["doc_id", "n_tokens", "ids"])

    return rows.mapInArrow(common.lean(run), "doc_id long, n_tokens long, ids binary")


def global_counts(tokenised: DataFrame, vocabulary: int, width: int) -> np.ndarray:
    """How often each id occurs in all documents. The driver gets one row for each id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            raw, _ = common.utf8(batch.column(0))
            if len(raw):
                total += np.bincount(raw.view(f"<u{width}") if raw.flags.aligned else raw.copy().view(f"<u{width}"), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for r in tokenised.select("ids").mapInArrow(common.lean(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


def write_corpus(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes all documents into files under `folder` in ascending order of the id; returns the manifest.

    The manifest has path, first_token (ids in all files before), n_tokens, n_docs and bytes, one row for each file.
    """
    spark = docs.sparkSession
    common.make_folder(spark, folder)
    path = tokenizer or tokens.default_path()
    vocabulary = tokens.ChunkEncoder.of(path).vocabulary
    width = 2 if vocabulary <= 1 << 16 else 4
    tokenised = common.written(tokenize(docs, path, end_id, id_col, text_col), "token-ids")
    counts = global_counts(tokenised, vocabulary, width)
    limit = limit_for(int((counts > 0).sum()))
    packed = zlib.compress(code_lengths(counts, limit).tobytes(), 9)
    parts = max(1, tokenised.rdd.getNumPartitions(), -(-int(counts.sum()) // RANGE_TOKENS))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]
    dealt = tokenised.repartitionByRange(parts, *order).sortWithinPartitions(*order, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task, at, number, held, ids, count = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal at, number, held, ids, count
            if held:
                table = pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64())], ["doc_id", "n_tokens"])
                data = write_file(table, np.frombuffer(b"".join(ids), f"<u{width}").astype(np.int64), at, packed, limit, task)
                name = f"{root}/part-{task:08d}-{number:06d}.wtok"
                passing = f"{root}/_passing-{uuid.uuid4().hex}"
                with store.open_output_stream(passing) as f:
                    f.write(data)
                store.move(passing, name)
                yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(name)]), *[pa.array([x], pa.int64()) for x in (task, at, count, len(held), len(data))]], _MANIFEST)
                at, number = at + count, number + 1
                held, ids, count = [], [], 0

        for batch in batches:
            for doc, n, one in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "n_tokens", "ids"))):
                if count and count + n > FILE_TOKENS:
                    yield from close()
                held.append((doc, n))
                ids.append(one)
                count += n
        yield from close()

    made = common.written(dealt.mapInArrow(common.lean(run), "path string, " + ", ".join(f"{c} long" for c in _MANIFEST[1:])), "token-manifest")
    totals = made.groupBy("task").agg(F.sum("n_tokens").alias("total"))
    common.sums_before(totals, "task", "total").withColumnRenamed("before", "base").write.mode("overwrite").parquet(f"{folder}/_bases")
    bases = read_bases(spark, folder)
    return made.join(bases, F.col("task") == F.col("b_task")).select("path", (F.col("first_token") + F.col("base")).alias("first_token"), "n_tokens", "n_docs", "bytes")


_MANIFEST = ["path", "task", "first_token", "n_tokens", "n_docs", "bytes"]


def read_bases(spark: SparkSession, folder: str) -> DataFrame:
    """b_task, base: the ids that tasks before wrote; with a broadcast hint while they are few."""
    bases = spark.read.schema("task long, base long").parquet(f"{folder}/_bases").select(F.col("task").alias("b_task"), "base")
    return F.broadcast(bases) if bases.limit(BROADCAST_BASES + 1).count() <= BROADCAST_BASES else bases


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit), from the folder alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wtok").load(folder).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                f = TokenFile(batch.column(0)[k].as_py())
                ids = f.ids().astype("<u4").tobytes()
                sizes = f.documents.column("n_tokens").to_numpy()
                ends = np.cumsum(sizes)
                starts = ends - sizes
                parts = [ids[4 * a : 4 * z] for a, z in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f.head["task"]] * len(sizes), pa.int64()), pa.array(f.documents.column("doc_id").to_pylist(), pa.int64()), pa.array(starts + f.head["first_token"], pa.int64()), pa.array(sizes, pa.int64()), pa.array(parts, pa.binary())],
                    ["task", "doc_id", "local", "n_tokens", "ids"],
                )

    rows = files.mapInArrow(common.lean(run), "task long, doc_id long, local long, n_tokens long, ids binary")
    return rows.join(read_bases(spark, folder), F.col("task") == F.col("b_task")).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids")
