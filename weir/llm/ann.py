"""Approximate nearest neighbours by inner product: score-aware quantisation, table scans, exact reranking.

What a code can't tell apart, a scan can't either, so vectors are coded relative to their surroundings, whatever rows there
are: each block has up to SPOTS places of its own (k-means on its rows alone), and what remains of a vector beyond the nearest
is turned at random, so that no few dimensions hold it all, and split into its length (the gain) and its direction. Thus
clusters, rays, a common offset and lengths of any range are told apart. Directions are cut into subspaces of two dimensions
with 16 centres each (four-bit codes, two to a byte); with few dimensions what the code misses is coded again, up to LEVELS
times. Centres and codes minimise the score-aware loss |r|^2 + (eta - 1) (r . u)^2, where r is the error and u the direction of the vector:
error parallel to the vector, which changes its largest inner products, weighs eta times as much. eta follows from
the share `least_score` of the norm above which scores matter. Codes and centres are found by coordinate descent,
centres on a bounded sample (SAMPLE_ROWS vectors), codes for every vector. The length of each vector's error is kept.

A search meets blocks of queries with blocks of codes; vectors stay where they are, and neither side is broadcast. For
each query a table of 256 entries for each code byte is filled with (16-bit) partial scores, the block's codes are looked
up and summed, and the best of the block go on: those whose scores may be largest, REACH standard deviations of their errors
above the approximate ones (never more than the errors allow). Rows are dealt to blocks at random, so a block sends its share of the `rerank` best and a
margin (MARGIN standard deviations). The `rerank` best of each query then go, by block, to the blocks' vectors: a second
equi-join, on the number of the block, at which they are scored exactly in double precision. A block that very many
queries ask for is copied, so that each copy has at most about ASKS of them. A query for which a vector that was left out might
still reach the k-th of these scores is asked again: all vectors that might are then scored exactly, however many. Of equal vectors only the k + 1 smallest
ids are indexed, as no other can be among the k nearest; the rest would only crowd out different vectors.

Defined results: vectors that are null, zero, of another length than most (ties: the shorter) or hold a null or
non-finite component take no part; equal scores go to the smaller id; with fewer than k candidates all are returned;
a repeated id is a candidate like any other for queries of a different id, and each of its rows is a query; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Vectors that the centres are fitted on, about; they are chosen by a hash of the id.
SAMPLE_ROWS = 10_000
CENTRES, SUB, SWEEPS, ROUNDS, LEAST_SCORE = 16, 2, 2, 6, 0.2
#: Vectors and queries in a block, and vectors that are scored exactly for each query.
BLOCK, QUERY_BLOCK, RERANK, MARGIN = 8192, 1024, 512, 6
#: Places in a block's numbering; queries that one copy of a block scores, about; blocks whose counts are broadcast (16 bytes each).
SPAN, ASKS, BROADCAST_BLOCKS = 1 << 14, 32768, 1_000_000
#: Parts of codes that are one cell for a block of queries, at most; cells times query blocks that there are at least, before a cell holds several.
CELL, CELLS = 16, 256
#: Places of its own that a block has, rows for each of them at least, rounds of choosing and of moving them; codes on top of each other at most, subspaces in all that they aim at.
SPOTS, SPOT_ROWS, SEEDINGS, MOVES, LEVELS, ALL_SUBSPACES = 256, 32, 8, 5, 4, 32
#: Standard deviations by which a score may differ from its approximation; dimensions that are turned together; scores that are computed at once.
REACH, TURNED, AT_ONCE = 2.5, 512, 1 << 16
#: Merges of a query's hits before the last one.
LANES = 64


@dataclass
class Quantiser:
    dim: int
    eta: float
    centres: np.ndarray  # subspaces x CENTRES x SUB

    @property
    def subspaces(self) -> int:
        return len(self.centres)

    def _padded(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.subspaces * SUB))
        out[:, : self.dim] = x
        return out.reshape(len(x), self.subspaces, SUB)

    def encode(self, x: np.ndarray, sweeps: int = SWEEPS, toward: np.ndarray | None = None) -> np.ndarray:
        """Code numbers, vectors x subspaces, by coordinate descent on the score-aware loss; `toward` are the unit directions (else x's own)."""
        if not len(x):
            return np.zeros((0, self.subspaces), np.uint8)
        p = self._padded(x)
        u = p / np.linalg.norm(p.reshape(len(x), -1), axis=1)[:, None, None] if toward is None else self._padded(toward)
        codes = np.zeros((len(x), self.subspaces), np.uint8)
        along = np.zeros((len(x), self.subspaces))  # parallel part of each subspace's residual
        for m in range(self.subspaces):
            d = p[:, m, None, :] - self.centres[m][None]
            codes[:, m] = (d**2).sum(axis=2).argmin(axis=1)
            along[:, m] = (d[np.arange(len(x)), codes[:, m]] * u[:, m]).sum(axis=1)
        total = along.sum(axis=1)
        for _ in range(sweeps):
            for m in range(self.subspaces):
                d = p[:, m, None, :] - self.centres[m][None]
                part = (d * u[:, m, None, :]).sum(axis=2)
                rest = total - along[:, m]
                loss = (d**2).sum(axis=2) + (self.eta - 1) * (rest[:, None] + part) ** 2
                codes[:, m] = loss.argmin(axis=1)
                along[:, m] = part[np.arange(len(x)), codes[:, m]]
                total = rest + along[:, m]
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.centres[np.arange(self.subspaces)[None, :], codes].reshape(len(codes), -1)[:, : self.dim]

    @staticmethod
    def packed(codes: np.ndarray) -> np.ndarray:
        """Two codes a byte; a row for each byte, so that a scan reads along vectors."""
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
        return np.ascontiguousarray((codes[:, 0::2] | (codes[:, 1::2] << 4)).T)


def fit(sample: np.ndarray, least_score: float = LEAST_SCORE, rounds: int = ROUNDS, seed: int = 11, toward: np.ndarray | None = None) -> Quantiser:
    """Centres by alternating codes and weighted least squares."""
    n, dim = sample.shape
    subspaces = -(-dim // SUB)
    share = min(0.99, least_score) ** 2
    eta = max(1.0, (dim - 1) * share / (1 - share))
    rng = np.random.default_rng(seed)
    q = Quantiser(dim, eta, np.zeros((subspaces, CENTRES, SUB)))
    p = q._padded(sample)
    for m in range(subspaces):
        q.centres[m] = p[rng.choice(n, CENTRES, replace=n < CENTRES), m]
        for _ in range(4):
            near = ((p[:, m, None, :] - q.centres[m][None]) ** 2).sum(axis=2).argmin(axis=1)
            for c in np.unique(near):
                q.centres[m, c] = p[near == c, m].mean(axis=0)
    u = p / np.linalg.norm(p.reshape(n, -1), axis=1)[:, None, None] if toward is None else q._padded(toward)
    for _ in range(rounds):
        codes = q.encode(sample, 1, toward)
        chosen = q.centres[np.arange(subspaces)[None, :], codes]
        along = ((p - chosen) * u).sum(axis=2)
        total = along.sum(axis=1)
        for m in range(subspaces):
            rest, um, pm = total - along[:, m], u[:, m], p[:, m]
            weight = np.eye(SUB)[None] + (eta - 1) * um[:, :, None] * um[:, None, :]
            goal = pm + (eta - 1) * um * (rest + (um * pm).sum(axis=1))[:, None]
            for c in np.unique(codes[:, m]):
                mine = codes[:, m] == c
                q.centres[m, c] = np.linalg.solve(weight[mine].sum(axis=0), goal[mine].sum(axis=0))
            along[:, m] = ((pm - q.centres[m, codes[:, m]]) * um).sum(axis=1)
            total = rest + along[:, m]
    return q


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1)
    return x / np.where(length > 0, length, 1)[:, None]


def spots(x: np.ndarray, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Up to SPOTS places among the rows (four bytes a number), and the number of each row's nearest. Half are chosen far from those before."""
    n, rng = len(x), np.random.default_rng(seed)
    k = min(SPOTS, max(1, n // SPOT_ROWS))
    mean = x.mean(axis=0)
    y = x - mean
    squares, near, chosen = (y**2).sum(axis=1), np.zeros(n), []
    for lo in range(0, k, -(-k // SEEDINGS)):
        far = near.sum()
        weight = 1 / n + near / far if far > 0 else np.ones(n)
        new = rng.choice(n, min(-(-k // SEEDINGS), k - lo), p=weight / weight.sum())
        apart = np.maximum(squares[:, None] + squares[new] - 2 * y @ y[new].T, 0).min(axis=1)
        near, chosen = np.minimum(near, apart) if lo else apart, [*chosen, *new]
    centres = y[chosen]
    for _ in range(MOVES):
        which = ((centres**2).sum(axis=1) - 2 * y @ centres.T).argmin(axis=1)
        order = which.argsort(kind="stable")
        held, starts, counts = np.unique(which[order], return_index=True, return_counts=True)
        centres[held] = np.add.reduceat(y[order], starts, axis=0) / counts[:, None]
    which = ((centres**2).sum(axis=1) - 2 * y @ centres.T).argmin(axis=1)
    return (centres + mean).astype(np.float32), which.astype(np.uint8)


@dataclass
class Block:
    """The codes of a block of vectors, as they are written."""

    scale: float
    spots: np.ndarray
    gain: np.ndarray
    error: np.ndarray
    which: np.ndarray
    codes: np.ndarray

    def tobytes(self) -> bytes:
        return b"".join([np.array([self.scale, len(self.gain), len(self.spots)]).tobytes(), *[x.tobytes() for x in (self.spots, self.gain, self.error, self.which, self.codes)]])

    @classmethod
    def of(cls, data: pa.Buffer, dim: int) -> Block:
        scale, n, k = np.frombuffer(data, np.float64, 3)
        at, out = 24, [float(scale)]
        for kind, count in ((np.float32, int(k) * dim), (np.float32, int(n)), (np.float32, int(n)), (np.uint8, int(n)), (np.uint8, -1)):
            out.append(np.frombuffer(data, kind, count, at))
            at += out[-1].nbytes
        return cls(out[0], out[1].reshape(-1, dim).astype(np.float64), *out[2:5], out[5].reshape(-1, int(n)))


class Coder:
    """Blocks of vectors in codes: places, gains, directions."""

    def __init__(self, sample: np.ndarray, seed: int = 13):
        self.dim = sample.shape[1]
        rng = np.random.default_rng(seed)
        self.order = rng.permutation(self.dim)
        self.turns = [np.linalg.qr(rng.standard_normal((size, size)))[0] for size in (min(TURNED, self.dim - lo) for lo in range(0, self.dim, TURNED))]
        mixed = rng.permutation(len(sample))
        parts = [self._parts(sample[mixed[lo : lo + BLOCK]]) for lo in range(0, len(sample), BLOCK)]
        left, toward = _unit(np.concatenate([p[3] for p in parts])), np.concatenate([p[4] for p in parts])
        self.levels: list[Quantiser] = []
        for _ in range(min(LEVELS, max(1, ALL_SUBSPACES // -(-self.dim // SUB)))):
            q = fit(left, toward=toward)
            self.levels.append(q)
            left = left - q.decode(q.encode(left, 1, toward))
        self.centres = np.concatenate([q.centres for q in self.levels])

    def turn(self, x: np.ndarray) -> np.ndarray:
        x = x[:, self.order]
        return np.concatenate([x[:, lo : lo + TURNED] @ r for lo, r in zip(range(0, self.dim, TURNED), self.turns)], axis=1)

    def _parts(self, x: np.ndarray) -> tuple:
        """Scale, places, numbers of the nearest, what remains, directions."""
        scale = float(np.abs(x).max())
        z = self.turn(x / scale)
        centres, which = spots(z)
        return scale, centres, which, z - centres[which], _unit(z)

    def encode(self, x: np.ndarray) -> Block:
        scale, centres, which, rest, toward = self._parts(x)
        left = _unit(rest)
        made, codes = np.zeros_like(left), []
        for q in self.levels:
            codes.append(q.encode(left, toward=toward))
            part = q.decode(codes[-1])
            made, left = made + part, left - part
        power = (made**2).sum(axis=1)
        gain = ((rest * made).sum(axis=1) / np.where(power > 0, power, 1)).astype(np.float32)
        error = np.linalg.norm(rest - gain[:, None].astype(np.float64) * made, axis=1).astype(np.float32)
        return Block(scale, centres, gain, error, which, Quantiser.packed(np.concatenate(codes, axis=1)))

    def tables(self, turned: np.ndarray) -> tuple[np.ndarray, float, float]:
        """For each pair of subspaces 256 partial scores, in 16 bits; the step of that scale and the sum that 0 stands for."""
        part = (self.centres * np.tile(self.levels[0]._padded(turned[None])[0], (len(self.levels), 1))[:, None, :]).sum(axis=2)
        if len(part) % 2:
            part = np.concatenate([part, np.zeros((1, CENTRES))])
        pairs = (part[0::2, None, :] + part[1::2, :, None]).reshape(len(part) // 2, 256)
        low = pairs.min(axis=1, keepdims=True)
        step = max(float((pairs - low).max()) / (32767 // max(1, len(pairs))), 1e-300)
        return np.rint((pairs - low) / step).astype(np.uint16), step, float(low.sum())

    def scan(self, block: Block, turned: np.ndarray) -> np.ndarray:
        """By the tables, the score that each vector of a block may have with a (turned) query at most."""
        tables, step, low = self.tables(turned)
        total = tables[0][block.codes[0]]
        for m in range(1, len(block.codes)):
            total += tables[m][block.codes[m]]
        reach = min(1.0, REACH / math.sqrt(self.dim)) * float(np.linalg.norm(turned))
        about = (block.spots @ turned)[block.which] + block.gain * (total * step + low)
        return (about + np.abs(block.gain) * (step * math.sqrt(len(block.codes))) + block.error * reach) * block.scale


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """id, v (doubles) of the vectors that take part, and their length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = most["dim"] if most else 0
    return rows.filter(F.size("v") == dim), dim


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _blocks(rows: DataFrame, dim: int, size: int, coder: Coder | None, name: str) -> DataFrame:
    """Every row, in blocks of up to `size`: part, block, ids, short (four bytes hold each number), vectors, codes (none without a coder). Written.

    Parts are numbered from 0; a part has one block, or more if it came out larger than `size`.
    """
    sent = rows.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held, ids, vectors = TaskContext.get().partitionId(), 0, 0, [], []

        def close() -> pa.RecordBatch:
            x = np.concatenate(vectors)
            short = bool((x == x.astype(np.float32)).all())
            codes = sent.value.encode(x).tobytes() if sent.value is not None else b""
            data = [np.concatenate(ids).tobytes(), (x.astype(np.float32) if short else x).tobytes(), codes]
            arrays = [pa.array([part], pa.int64()), pa.array([(part << 20) + block], pa.int64()), pa.array([short]), *[pa.array([d], pa.binary()) for d in data]]
            return pa.RecordBatch.from_arrays(arrays, ["part", "block", "short", "ids", "vectors", "codes"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, size - held)
                ids.append(piece.column(0).to_numpy().astype(np.int64))
                vectors.append(_matrix(piece.column(1), dim))
                at, held = at + piece.num_rows, held + piece.num_rows
                if held == size:
                    yield close()
                    block, held, ids, vectors = block + 1, 0, [], []
        if held:
            yield close()

    dealt = rows.select("id", "v").repartition(max(1, -(-rows.count() // size)))
    return common.written(dealt.mapInArrow(common.lean(run), "part long, block long, short boolean, ids binary, vectors binary, codes binary"), name)


def _numbers(value: pa.Scalar, short: bool, dim: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.float32 if short else np.float64).astype(np.float64).reshape(-1, dim)


def build_index(rows: DataFrame, dim: int, coder: Coder) -> DataFrame:
    return _blocks(rows, dim, BLOCK, coder, "ann-index")


def _meet(index: DataFrame, blocks: DataFrame, n_index: int) -> DataFrame:
    """Every block of queries with every block of codes once, by the numbers of their parts."""
    n_asked = blocks.agg(F.max("part")).first()[0]
    # codes are met by cells of neighbouring parts, and a block of queries is sent once to each cell. The blocks look small
    # to the planner, which doesn't count their copies, so it is told not to broadcast them.
    cell = max(1, min(CELL, (n_index + 1) * (n_asked + 1) // CELLS))
    left = index.select(F.floor(F.col("part") / cell).alias("cell"), "block", "codes", F.explode(F.sequence(F.lit(0), F.lit(n_asked)).cast("array<long>")).alias("q_part"))
    right = blocks.select(F.col("part").alias("q_part"), F.explode(F.sequence(F.lit(0), F.lit(n_index // cell)).cast("array<long>")).alias("cell"), "ids", "short", "vectors")
    return left.join(right.hint("merge"), ["cell", "q_part"]).select("block", "codes", "ids", "short", "vectors")


def _scored(index: DataFrame, asked: DataFrame, spread: DataFrame, dim: int, k: int, name: str) -> DataFrame:
    """q, query_id, place, id, score: of the places asked for in each block, the k best of each query by exact scores, but for its own id."""
    counts = common.written(spread.groupBy(F.col("block").alias("n_block")).agg(F.ceil(F.count("*") / ASKS).cast("int").alias("copies")), name)
    if counts.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS:
        counts = F.broadcast(counts)
    named = asked.select(F.col("q").alias("a_q"), F.col("id").alias("query_id"), F.col("v").alias("q_v"))
    asks = spread.join(named.hint("merge"), F.col("q") == F.col("a_q")).join(counts, F.col("block") == F.col("n_block"))
    none = lambda kind: F.lit(None).cast(kind)
    asks = asks.select("block", F.pmod(F.xxhash64("q"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("kind"), "q", "query_id", "q_v", "places", none("boolean").alias("short"), none("binary").alias("ids"), none("binary").alias("vectors"))
    held = index.join(counts, F.col("block") == F.col("n_block")).select(
        "block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"),
        none("long").alias("q"), none("long").alias("query_id"), none("array<double>").alias("q_v"), none("array<int>").alias("places"), "short", "ids", "vectors",
    )
    dealt = held.unionByName(asks).repartition("block", "copy").sortWithinPartitions("block", "copy", "kind")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = x = block = None
        for batch in batches:
            kinds = np.append(np.flatnonzero(batch.column("kind").to_numpy() == 0), batch.num_rows)
            for lo, hi in zip(np.concatenate([[-1], kinds[:-1]]), kinds):
                if lo >= 0:
                    block = batch.column("block")[lo].as_py()
                    ids = np.frombuffer(batch.column("ids")[lo].as_buffer(), np.int64)
                    x = _numbers(batch.column("vectors")[lo], batch.column("short")[lo].as_py(), dim)
                ends = np.cumsum(batch.column("places").slice(lo + 1, hi - lo - 1).value_lengths().to_numpy()) if hi - lo > 1 else []
                at = 0
                while at < len(ends):
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
                    part = batch.slice(lo + 1 + at, to - at)
                    lists = part.column("places")
                    which = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                    places = lists.flatten().to_numpy().astype(np.int64)
                    products, score = _matrix(part.column("q_v"), dim)[which] * x[places], np.zeros(len(places))
                    for d in range(dim):  # in every row the same order of additions, so equal vectors tie
                        score += products[:, d]
                    order = np.lexsort((ids[places], -score, which))
                    order = order[ids[places[order]] != part.column("query_id").to_numpy()[which[order]]]
                    first = np.searchsorted(which[order], which[order])
                    order = order[np.arange(len(order)) - first < k]
                    taken = [part.column(c).take(pa.array(which[order])) for c in ("q", "query_id")]
                    yield pa.RecordBatch.from_arrays([*taken, pa.array(places[order] + block * SPAN), pa.array(ids[places[order]]), pa.array(score[order])], ["q", "query_id", "place", "id", "score"])
                    at = to

    return dealt.mapInArrow(common.lean(exact), "q long, query_id long, place long, id long, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, rerank: int = RERANK, sample_rows: int = SAMPLE_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id_col, score: the k best of `vectors` for each row of `queries`, but for its own id."""
    spark = vectors.sparkSession
    common.tune(spark)
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    rows, dim = usable(vectors, id_col, vector_col)
    if not dim:
        return empty
    same = W.partitionBy("v").orderBy("id")
    rows = common.written(rows.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= k + 1).select("id", "v"), "ann-vectors")
    n = rows.count()
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0
    sample = rows.filter(draw < min(1.0, sample_rows / n)).limit(2 * sample_rows).toPandas().sort_values("id")
    if not len(sample):
        sample = rows.limit(sample_rows).toPandas()
    coder = Coder(np.stack(sample["v"].to_numpy()).astype(np.float64))
    index = build_index(rows, dim, coder)
    asked, _ = usable(queries, id_col, vector_col)
    # rows of one id may differ in their vectors, so a query is a row, by a number of its own
    asked = common.written(asked.filter(F.size("v") == dim).select(F.monotonically_increasing_id().alias("q"), "id", "v"), "ann-queries")
    blocks = _blocks(asked.select(F.col("q").alias("id"), "v"), dim, QUERY_BLOCK, None, "ann-query-blocks")
    if blocks.isEmpty():
        return empty
    n_index, n_blocks = index.agg(F.max("part"), F.count("*")).first()
    mean = rerank / n_blocks
    most = min(rerank, math.ceil(mean + MARGIN * math.sqrt(mean))) + 1
    sent = spark.sparkContext.broadcast(coder)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block, asking = batch.column("block")[r].as_py(), np.frombuffer(batch.column("ids")[r].as_buffer(), np.int64)
                codes, found, rest = Block.of(batch.column("codes")[r].as_buffer(), dim), [], np.full(len(asking), np.inf)
                for n, turned in enumerate(sent.value.turn(_numbers(batch.column("vectors")[r], batch.column("short")[r].as_py(), dim))):
                    scores = sent.value.scan(codes, turned)
                    near = np.arange(len(scores))
                    if len(scores) > most:
                        near = np.argpartition(scores, len(scores) - most)[len(scores) - most :]
                        rest[n] = -scores[near].min()
                    found.append((near, -scores[near]))
                ends = np.concatenate([[0], np.cumsum([len(near) for near, _ in found])]).astype(np.int32)
                places = np.concatenate([near for near, _ in found]) + block * SPAN
                hits = pa.StructArray.from_arrays([pa.array(np.concatenate([s for _, s in found])), pa.array(places)], ["score", "place"])
                lanes = pa.array([block % LANES] * len(asking), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(asking), lanes, pa.ListArray.from_arrays(pa.array(ends), hits), pa.array(rest)], ["q", "lane", "hits", "rest"])

    # scores with the sign turned; those of the hits that were left out are `rest` at least
    found = _meet(index, blocks, n_index).mapInArrow(common.lean(scan), "q long, lane long, hits array<struct<score double, place long>>, rest double")
    for keys in (["q", "lane"], ["q"]):  # in two steps, so that no list holds a query's hits of all blocks
        found = found.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("all"), F.min("rest").alias("rest"))
        cut = F.when(F.size("all") > rerank + 1, F.col("all")[rerank]["score"])
        found = found.select(*keys, F.slice("all", 1, rerank + 1).alias("hits"), F.least("rest", cut).alias("rest"))
    spread = found.select("q", "rest", F.explode("hits.place").alias("place")).groupBy("q", F.floor(F.col("place") / SPAN).alias("block"))
    spread = spread.agg(F.collect_list(F.pmod("place", F.lit(SPAN)).cast("int")).alias("places"), F.min("rest").alias("rest"))
    spread = common.written(spread, "ann-asks")
    best = W.partitionBy("q").orderBy(F.desc("score"), "id")
    ranks = lambda scored: scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    named = lambda ranked: ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
    ranked = ranks(_scored(index, asked, spread.drop("rest"), dim, k, "ann-copies"))
    if spread.filter(F.col("rest") < float("inf")).isEmpty():
        return named(ranked)

    # queries whose k-th score a vector that was left out may reach: all vectors that may are scored
    ranked = common.written(ranked, "ann-first")
    known = ranked.groupBy("q").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    known = spread.groupBy("q").agg(F.min("rest").alias("rest")).join(known.hint("merge"), "q", "left")
    known = known.select("q", "rest", F.when(F.col("n") >= k, F.col("kth")).otherwise(float("-inf")).alias("kth")).filter((F.col("rest") < float("inf")) & (-F.col("rest") >= F.col("kth")))
    again = asked.join(known.hint("merge"), "q").select(F.col("q").alias("id"), F.concat("v", F.array("kth")).alias("v"))
    blocks = _blocks(common.written(again, "ann-open"), dim + 1, QUERY_BLOCK, None, "ann-open-blocks")
    if blocks.isEmpty():
        return named(ranked)

    def scan_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block, asking = batch.column("block")[r].as_py(), np.frombuffer(batch.column("ids")[r].as_buffer(), np.int64)
                codes, x = Block.of(batch.column("codes")[r].as_buffer(), dim), _numbers(batch.column("vectors")[r], batch.column("short")[r].as_py(), dim + 1)
                for q, turned, kth in zip(asking, sent.value.turn(x[:, :dim]), x[:, dim]):
                    places = np.flatnonzero(sent.value.scan(codes, turned) >= kth).astype(np.int32)
                    if len(places):
                        yield pa.RecordBatch.from_arrays([pa.array([q]), pa.array([block]), pa.array([places], pa.list_(pa.int32()))], ["q", "block", "places"])

    spread = common.written(_meet(index, blocks, n_index).mapInArrow(common.lean(scan_all), "q long, block long, places array<int>"), "ann-open-asks")
    more = _scored(index, asked, spread, dim, k, "ann-open-copies").unionByName(ranked.drop("rank")).dropDuplicates(["q", "place"])
    return named(ranks(more))
