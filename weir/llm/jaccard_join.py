"""N-gram Jaccard join by a token-group matrix.

Documents are sets of hashed five-word shingles; two link at 100 * shared >= threshold * union. Equal sets are one
class, of which only the smallest document goes on. The rest:

1. Groups. Classes with the same smallest hash under a seed are sorted by further ones and cut into groups of at most
   GROUP classes, so similar ones mostly share a group. All pairs within a group are compared exactly (a product of its
   class-by-token matrix, in column blocks), which gives local components.
2. Bridges. For other seeds the same is done with one class of every local component and hash, so that a large family
   of near copies is joined with few comparisons.
3. The matrix. With tokens in a global order (rare first), two linked classes share at least k tokens among their first
   n - ceil(threshold * n) + k, with k a twelfth of the smaller set. The rows of the token-group matrix that matter are
   therefore the tokens in these prefixes that several components have. Two groups meet if their rows share k tokens
   from members of fitting sizes in different components; a token that very many groups have is met in blocks of them.
   Of two classes the one in the smaller component asks the other's group.
4. Bound and open. The token union of every asked group is stored once (32 bits of each token: what collides only raises
   a bound). An asking class meets the union alone; only where their overlap reaches what the threshold asks of the
   group's sizes does the pair qualify, and only for qualifying pairs are the groups' members fetched and compared
   exactly. Work on groups is dealt to tasks by weight, not by hash.

No link between different components is lost: steps 1 and 2 only save work, and steps 3 and 4 cover every pair of
classes that is not yet connected. Frequencies for the order come from all documents; each task reports tokens of several sets,
and at most FREQUENT of them are sent to the executors. The order decides cost only, never results.

Defined results: texts without words (null, empty) have an empty set and link with nothing; rows that repeat an id are
judged each by its text; a null id is linked with nothing and has itself (null) as component; an empty table gives an
empty result; other columns don't take part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

WIDTH, THRESHOLD = 5, 80
SEEDS = 4
#: Classes and tokens in one group, and tokens in one block of columns of a group's matrix.
GROUP, GROUP_TOKENS, BLOCK = 256, 300_000, 8192
#: Tokens whose frequency is known to the order (16 bytes each), and the least count in one task's different sets.
FREQUENT, LEAST_COUNT = 1_000_000, 2
#: Up to this many bytes, some 48 for each id and 8 for each entry of its list, are broadcast to pick documents; beyond, they are joined by a shuffle.
BROADCAST_BYTES, ID_BYTES = 64 << 20, 48
#: A token with more groups is met in blocks of so many, each pair of blocks by itself.
CELLS = 1024
#: Rows of work that one task deals out.
DEALT = 1_000_000
#: One in so many tokens of a set has to be shared in the prefixes (at least one).
NEEDED = 12
#: Classes that ask one group in one task.
QUERIES = 512
_SEED = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89, 0x452821E638D01377, 0xBE5466CF34E90C6C)]


def needed(n: int) -> int:
    """Tokens that two linked sets share in their prefixes, for the smaller of them; grows with the set."""
    return max(1, n // NEEDED)


def prefix_length(n: int, threshold: int = THRESHOLD) -> int:
    """With an overlap of at least threshold * n, the first needed(n) shared tokens are among so many."""
    return min(n, n - -(-threshold * n // 100) + needed(n)) if n else 0


def linked(shared: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    return 100 * shared >= threshold * (n + m - shared)


def _sum_counts(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(ids, return_inverse=True)
    return keys, np.bincount(where, counts, len(keys)).astype(np.int64)


def frequent_tokens(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, ascending, and their ranks by (count, token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, counts, buffer, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def flush():
            nonlocal kept, counts, buffer, size
            ids, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *buffer]), return_counts=True)
            more = n > 1
            kept, counts = _sum_counts(np.concatenate([kept, ids[more]]), np.concatenate([counts, n[more]]))
            if len(kept) > 4 * FREQUENT:
                top = np.sort(np.argpartition(counts, -2 * FREQUENT)[-2 * FREQUENT :])
                kept, counts = kept[top], counts[top]
            buffer, size = [], 0

        known: set[tuple[int, int]] = set()
        for batch in batches:
            for s in common.shingle_sets(batch.column(0), WIDTH):
                name = (len(s), int(common.mix(s).sum(dtype=np.uint64)))
                if name in known:
                    continue  # equal sets are one class
                if len(known) < 200_000:
                    known.add(name)
                buffer.append(s)
                size += len(s)
                if size > 3_000_000:
                    flush()
        flush()
        top = counts >= LEAST_COUNT
        kept, counts = kept[top], counts[top]
        if len(kept) > FREQUENT:
            most = np.argpartition(counts, -FREQUENT)[-FREQUENT:]
            kept, counts = kept[most], counts[most]
        yield pa.RecordBatch.from_arrays([pa.array(kept.view(np.int64), pa.int64()), pa.array(counts, pa.int64())], ["token", "n"])

    found = docs.select(text_col).mapInArrow(common.lean(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") > LEAST_COUNT).orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    ids, n = found["token"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    ranks = np.empty(len(ids), np.int64)
    ranks[np.lexsort((ids, n))] = np.arange(len(ids))
    order = np.argsort(ids)
    return ids[order], ranks[order]


def signed_sets(docs: DataFrame, id_col: str, text_col: str, threshold: int) -> DataFrame:
    """id, n, d1, d2 (digest of the set), s0.. (smallest hashes by seed), prefix (of its tokens in the global order)."""
    known = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, text_col))
    names = ["id", "n", "d1", "d2", *[f"s{k}" for k in range(SEEDS)], "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ranks = known.value
        for batch in batches:
            rows: list[list] = [[] for _ in names[1:]]
            for s in common.shingle_sets(batch.column(1), WIDTH):
                rows[0].append(len(s))
                rows[1].append(int(common.mix(s ^ _SEED[4]).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                rows[2].append(int(common.mix(s ^ _SEED[5]).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                for k in range(SEEDS):
                    rows[3 + k].append(int(common.mix(s ^ _SEED[k]).min().astype(np.int64)) if len(s) else 0)
                take = prefix_length(len(s), threshold)
                if len(tokens) and len(s):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    often = tokens[at] == s
                    rare = s[~often]
                    first = rare[:take]
                    if len(first) < take:
                        rest = s[often][np.argsort(ranks[at[often]], kind="stable")]
                        first = np.concatenate([first, rest[: take - len(first)]])
                else:
                    first = s[:take]
                rows[-1].append(first.view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in rows[-1]])]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rows[-1]])))
            arrays = [batch.column(0), *[pa.array(r, pa.int64()) for r in rows[:-1]], prefix]
            yield pa.RecordBatch.from_arrays(arrays, names)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(common.lean(run), f"id long, n long, d1 long, d2 long, {', '.join(f's{k} long' for k in range(SEEDS))}, prefix array<long>")


def _small(ids: DataFrame, entries: Column | int = 0) -> bool:
    """Whether ids may be broadcast: by the bytes that they take, not by their number."""
    n, more = ids.agg(F.count("*"), F.sum(entries if isinstance(entries, Column) else F.lit(entries))).first()
    return n * ID_BYTES + 8 * (more or 0) <= BROADCAST_BYTES


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, bits: int = 64) -> DataFrame:
    """rep, carried, n, tokens (bytes, ascending) of the documents named in ids (rep, carried: a list of longs), from their whole texts.

    With 32 bits the tokens are the distinct upper halves; n is the number of whole ones.
    """
    chosen = ids.select(F.col("rep").alias("wanted"), "carried")
    if _small(chosen, F.size("carried")):
        chosen = F.broadcast(chosen)
    rows = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).join(chosen, F.col("rep") == F.col("wanted")).select("rep", "carried", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = common.shingle_sets(batch.column(2), WIDTH)
            data = [(s if bits == 64 else np.unique((s >> np.uint64(32)).astype(np.uint32))).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(data, pa.binary())], ["rep", "carried", "n", "tokens"])

    return rows.mapInArrow(common.lean(run), "rep long, carried array<long>, n long, tokens binary")


def dealt_evenly(work: DataFrame, weight: str) -> tuple[DataFrame, int]:
    """work (written) plus `slot`, the number of a task out of so many: each row to the lightest task so far.

    A task deals out DEALT rows by itself; its rows are few and small (one for each group).
    """
    slots = max(1, int(work.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spelled = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = [(0, k) for k in range(slots)]
        for batch in batches:
            out = []
            for w in batch.column(weight).to_pylist():
                least, slot = load[0]
                heapq.heapreplace(load, (least + w, slot))
                out.append(slot)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, "slot"])

    gathered = work.repartition(max(1, -(-work.count() // DEALT))).sortWithinPartitions(F.desc(weight))
    return common.written(gathered.mapInArrow(common.lean(run), f"{spelled}, slot int"), "jaccard-dealt"), slots


def cut_groups(keyed: DataFrame) -> DataFrame:
    """keyed (lane, key, sub, rep, n), sorted and cut into groups of one (lane, key); returns grp, rep, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, last, members, size = TaskContext.get().partitionId() << 40, None, 0, 0
        for batch in batches:
            out = []
            for lane, key, n in zip(*(batch.column(c).to_pylist() for c in ("lane", "key", "n"))):
                if (lane, key) != last or members >= GROUP or size + n > GROUP_TOKENS:
                    name, last, members, size = name + 1, (lane, key), 0, 0
                members, size = members + 1, size + n
                out.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), batch.column("rep"), batch.column("n")], ["grp", "rep", "n"])

    order = ["lane", "key", "sub", "rep"]
    parts = max(1, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = keyed.select("lane", "key", "sub", "rep", "n").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return common.written(dealt.mapInArrow(common.lean(run), "grp long, rep long, n long"), "jaccard-groups")


def _local_components(sets: list[np.ndarray], threshold: int) -> list[int]:
    """For each set the index of the first one of its component."""
    k = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, where = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(k), sizes)
    shared = np.zeros((k, k), np.float32)
    order = np.argsort(where, kind="stable")
    where, rows = where[order], rows[order]
    edges = np.searchsorted(where, np.arange(0, len(tokens) + BLOCK, BLOCK))
    for b in range(len(edges) - 1):
        lo, hi = edges[b], edges[b + 1]
        if lo < hi:
            block = np.zeros((k, min(BLOCK, len(tokens) - b * BLOCK)), np.float32)
            block[rows[lo:hi], where[lo:hi] - b * BLOCK] = 1
            shared += block @ block.T
    near = linked(shared.astype(np.int64), sizes[:, None], sizes[None, :], threshold)
    root = np.arange(k)
    while True:
        low = np.where(near, root[None, :], k).min(axis=1)
        low = np.minimum(low, root)
        if (low == root).all():
            return root.tolist()
        root = low[low]


def group_edges(groups: DataFrame, docs: DataFrame, id_col: str, text_col: str, threshold: int) -> DataFrame:
    """Exact links within groups, as edges (a, b) from each class to the first one of its local component. Written."""
    several, slots = dealt_evenly(common.written(groups.groupBy("grp").agg(F.count("*").alias("members")).filter("members > 1"), "jaccard-several"), "members")
    slotted = groups.join(several.select("grp", "slot"), "grp")
    # a class is in one group of a lane, so its list of groups has SEEDS entries at most; group and task are one number
    homes = common.written(slotted.groupBy("rep").agg(F.flatten(F.collect_list(F.array(F.col("grp"), F.col("slot").cast("long")))).alias("carried")), "jaccard-homes")
    places = F.expr("transform(sequence(0, size(carried) - 2, 2), k -> struct(carried[k] AS grp, carried[k + 1] AS slot))")
    filled = full_sets(docs, homes, id_col, text_col).select(F.explode(places).alias("at"), "rep", "tokens").select(F.col("at.grp").alias("grp"), F.col("at.slot").cast("int").alias("slot"), "rep", "tokens")
    dealt = filled.repartitionById(slots, F.col("slot")).select("grp", "rep", "tokens").sortWithinPartitions("grp", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reps, sets = None, [], []

        def close() -> pa.RecordBatch:
            first = _local_components(sets, threshold) if len(sets) > 1 else []
            pairs = [(reps[k], reps[f]) for k, f in enumerate(first) if f != k]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            for k, (grp, rep) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if grp != last:
                    if len(sets) > 1:
                        yield close()
                    last, reps, sets = grp, [], []
                reps.append(rep)
                sets.append(np.frombuffer(batch.column(2)[k].as_buffer(), np.uint64).copy())
        if len(sets) > 1:
            yield close()

    return common.written(dealt.mapInArrow(common.lean(run), "a long, b long"), "jaccard-edges")


def shared_only(postings: DataFrame, by: str) -> DataFrame:
    """The postings (token first) of tokens with more than one value of `by`, as one sorted stream.

    What waits for the next batch is a token's rows of one single value; classes have a token once, so that is one row.
    """
    names = postings.columns
    col = names.index(by)
    spelled = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in postings.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last token's rows, as long as they have one value
        token = value = None
        mixed = False  # whether the last token has several values
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            t, v = batch.column(0).to_numpy(), batch.column(col).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            changes = np.concatenate([[False], (v[1:] != v[:-1]) & (t[1:] == t[:-1])])
            several = np.add.reduceat(changes.astype(np.int64), starts) > 0
            if token is not None and t[0] == token:
                if mixed or several[0] or v[0] != value:
                    yield from held
                    held, several[0] = [], True
                elif len(starts) == 1:
                    held.append(batch)
                    continue
            keep = np.repeat(several, np.diff(np.append(starts, n)))
            if keep.any():
                yield batch.filter(pa.array(keep))
            token, value, mixed = t[-1], v[-1], bool(several[-1])
            held = [] if mixed else [batch.slice(int(starts[-1]))]

    dealt = postings.repartition(names[0]).sortWithinPartitions(names[0], by)
    return dealt.mapInArrow(common.lean(run), spelled)


def group_unions(asked: tuple[DataFrame, int], groups: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """grp, least, most (sizes), tokens (32 bits each, ascending): the token union of every asked group. Written.

    asked: the groups (grp, members, slot) and the number of slots.
    """
    wanted, slots = asked
    members = groups.join(wanted.select("grp", "slot"), "grp").select("rep", F.array(F.col("grp"), F.col("slot").cast("long")).alias("carried"))
    filled = full_sets(docs, common.written(members, "jaccard-members"), id_col, text_col, 32).select(F.col("carried")[0].alias("grp"), F.col("carried")[1].cast("int").alias("slot"), "n", "tokens")
    dealt = filled.repartitionById(slots, F.col("slot")).select("grp", "n", "tokens").sortWithinPartitions("grp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sizes, union, waiting, size = None, [], np.zeros(0, np.uint32), [], 0

        def merged() -> np.ndarray:
            return np.unique(np.concatenate([union, *waiting]))

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([min(sizes)], pa.int64()), pa.array([max(sizes)], pa.int64()), pa.array([merged().tobytes()], pa.binary())], ["grp", "least", "most", "tokens"])

        for batch in batches:
            for k, (grp, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if grp != last:
                    if last is not None:
                        yield close()
                    last, sizes, union, waiting, size = grp, [], np.zeros(0, np.uint32), [], 0
                sizes.append(n)
                waiting.append(np.frombuffer(batch.column(2)[k].as_buffer(), np.uint32).copy())
                size += len(waiting[-1])
                if size > GROUP_TOKENS:
                    union, waiting, size = merged(), [], 0
        if last is not None:
            yield close()

    return common.written(dealt.mapInArrow(common.lean(run), "grp long, least long, most long, tokens binary"), "jaccard-unions")


def _parts(pairs: DataFrame, members: DataFrame | None) -> tuple[DataFrame, DataFrame, int]:
    """pairs plus part (QUERIES asks of a group at most, about), and the parts (grp, part, slot) dealt to so many tasks by weight."""
    asked = pairs.groupBy("grp").agg(F.count("*").alias("asks")).withColumn("parts", F.ceil(F.col("asks") / QUERIES).cast("int"))
    if members is not None:
        asked = asked.join(members, "grp")
    weight = F.ceil(F.col("asks") / F.col("parts")) + (F.lit(1) if members is None else F.col("members"))
    parts = asked.select("grp", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), weight.cast("long").alias("weight"))
    dealt, slots = dealt_evenly(common.written(parts, "jaccard-parts"), "weight")
    numbered = pairs.join(dealt.select("grp", "parts").distinct(), "grp").select("grp", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), "rep")
    return numbered, dealt.select("grp", "part", "slot"), slots


def qualifying(pairs: DataFrame, unions: DataFrame, docs: DataFrame, id_col: str, text_col: str, threshold: int) -> DataFrame:
    """The pairs (rep, grp) for which a class and a group's union alone share enough. Written."""
    numbered, parts, slots = _parts(pairs, None)
    askers = common.written(pairs.select("rep").distinct().withColumn("carried", F.array().cast("array<long>")), "jaccard-askers")
    sets = full_sets(docs, askers, id_col, text_col, 32).select("rep", "n", "tokens")
    asks = numbered.join(parts, ["grp", "part"]).join(sets, "rep").select("slot", "grp", "part", F.lit(1).alias("kind"), "rep", "n", F.lit(None).cast("long").alias("most"), "tokens")
    held = parts.join(unions, "grp").select("slot", "grp", "part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("rep"), F.col("least").alias("n"), "most", "tokens")
    dealt = held.unionByName(asks).repartitionById(slots, F.col("slot")).drop("slot").sortWithinPartitions("grp", "part", "kind", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union, least, most = np.zeros(0, np.uint32), 0, 0
        for batch in batches:
            reps, grps = [], []
            for k, (grp, kind, rep, n, top) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("grp", "kind", "rep", "n", "most")))):
                tokens = np.frombuffer(batch.column("tokens")[k].as_buffer(), np.uint32)
                if kind == 0:
                    union, least, most = tokens.copy(), n, top
                    continue
                at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
                # tokens that fall together count as different ones, so this is no less than the overlap with any member
                shared = min(n, int((union[at] == tokens).sum()) + n - len(tokens))
                if linked(np.int64(shared), np.int64(n), np.int64(min(max(least, shared), most)), threshold):
                    reps.append(rep)
                    grps.append(grp)
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(grps, pa.int64())], ["rep", "grp"])

    return common.written(dealt.mapInArrow(common.lean(run), "rep long, grp long"), "jaccard-qualified")


def open_groups(pairs: DataFrame, groups: DataFrame, roots: DataFrame, docs: DataFrame, id_col: str, text_col: str, threshold: int) -> DataFrame:
    """Exact links between the classes and the members of the groups of qualifying pairs (rep, grp); edges. Written."""
    members = groups.groupBy("grp").agg(F.count("*").alias("members"))
    numbered, parts, slots = _parts(pairs, members)
    asks = numbered.join(parts, ["grp", "part"]).select("slot", "grp", "part", F.lit(1).alias("kind"), "rep")
    held = parts.join(groups.select("grp", "rep"), "grp").select("slot", "grp", "part", F.lit(0).alias("kind"), "rep")
    rows = common.written(asks.unionByName(held), "jaccard-asks")
    named = rows.join(roots, F.col("rep") == F.col("node"), "left").select("slot", "grp", "part", "kind", "rep", F.coalesce("component", "rep").alias("root"))
    wanted = common.written(rows.select("rep").distinct().withColumn("carried", F.array().cast("array<long>")), "jaccard-wanted")
    filled = named.join(full_sets(docs, wanted, id_col, text_col).select("rep", "tokens"), "rep").select("slot", "grp", "part", "kind", "rep", "root", "tokens")
    dealt = filled.repartitionById(slots, F.col("slot")).drop("slot").sortWithinPartitions("grp", "part", "kind", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reps, roots_of, sets, index = None, [], [], [], None
        for batch in batches:
            a, b = [], []
            for k, (grp, part, kind, rep, root) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
                if (grp, part) != last:
                    last, reps, roots_of, sets, index = (grp, part), [], [], [], None
                tokens = np.frombuffer(batch.column(5)[k].as_buffer(), np.uint64)
                if kind == 0:
                    reps.append(rep)
                    roots_of.append(root)
                    sets.append(tokens.copy())
                    continue
                if not sets or not len(tokens):
                    continue
                if index is None:
                    sizes = np.array([len(s) for s in sets], np.int64)
                    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                    order = np.argsort(every, kind="stable")
                    union, at = np.unique(every[order], return_index=True)
                    index = (union, np.append(at, len(every)), owner[order], sizes)
                union, at, owner, sizes = index
                where = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
                hit = where[union[where] == tokens]
                spans = at[hit + 1] - at[hit]
                flat = np.repeat(at[hit] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(int(spans.sum()))
                shared = np.bincount(owner[flat], minlength=len(sets))
                done = {root}
                for m in np.flatnonzero(linked(shared, len(tokens), sizes, threshold)):
                    if roots_of[m] not in done:
                        done.add(roots_of[m])
                        a.append(rep)
                        b.append(reps[m])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return common.written(dealt.mapInArrow(common.lean(run), "a long, b long"), "jaccard-edges")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """id_col, n_shingles, component_id: the smallest id that links reach; one row for each row of docs."""
    common.tune(docs.sparkSession)
    signed = common.written(signed_sets(docs, id_col, text_col, threshold), "jaccard-signed")
    usable = signed.filter("n > 0 AND id IS NOT NULL")
    classes = usable.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), *[F.min(f"s{k}").alias(f"s{k}") for k in range(SEEDS)])
    classes = common.written(classes, "jaccard-classes")

    # 1. groups by the first seed
    first = classes.select(F.lit(0).alias("lane"), F.col("s0").alias("key"), F.col("s1").alias("sub"), "rep", "n")
    groups = cut_groups(first)
    inner = group_edges(groups, docs, id_col, text_col, threshold)
    roots = components(inner)

    # 2. bridges by the other seeds, one class of each component and hash
    rooted = classes.join(roots, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("component", "rep"))
    lanes = F.explode(F.array(*[F.struct(F.lit(k).alias("lane"), F.col(f"s{k}").alias("key"), F.col("s0").alias("sub")) for k in range(1, SEEDS)]))
    keyed = rooted.select(lanes.alias("x"), "rep", "n", "root").select("x.lane", "x.key", "x.sub", "rep", "n", "root")
    single = keyed.groupBy("lane", "key", "root").agg(F.min(F.struct("rep", "sub", "n")).alias("m")).select("lane", "key", "m.sub", "m.rep", "m.n")
    bridges = group_edges(cut_groups(single), docs, id_col, text_col, threshold)
    edges = inner.unionByName(bridges)
    roots = components(edges)

    # 3. the token-group matrix: tokens of prefixes that several components have
    one = signed.join(classes.select("n", "d1", "d2", F.col("rep").alias("id")), ["n", "d1", "d2", "id"], "left_semi")
    postings = one.select(F.explode("prefix").alias("token"), F.col("id").alias("rep"))
    several = shared_only(postings, "rep")
    named = several.join(roots, F.col("rep") == F.col("node"), "left").select("token", F.coalesce("component", "rep").alias("root"), "rep")
    named = common.written(named, "jaccard-named")
    spread = named.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("token")
    crossing = named.join(common.written(spread, "jaccard-spread"), "token", "left_semi")
    placed = crossing.join(groups.select(F.col("rep").alias("g_rep"), "grp", "n"), F.col("rep") == F.col("g_rep")).select("token", "root", "n", "grp")
    cells = placed.groupBy("token", "grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    cells = common.written(cells, "jaccard-matrix")
    crowded = common.written(cells.groupBy(F.col("token").alias("h_token")).agg(F.ceil(F.count("*") / CELLS).cast("int").alias("h_blocks")).filter("h_blocks > 1"), "jaccard-crowded")
    if _small(crowded):
        crowded = F.broadcast(crowded)
    cells = cells.join(crowded, F.col("token") == F.col("h_token"), "left").withColumn("blocks", F.coalesce("h_blocks", F.lit(1))).drop("h_token", "h_blocks")
    cells = cells.withColumn("block", F.pmod(F.xxhash64("grp"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    other = cells.withColumn("met", every).select(*[F.col(c).alias(f"o_{c}") for c in cells.columns], F.col("met").alias("o_met"))
    cells = cells.withColumn("met", every)
    # each unordered pair of groups once, where members of other components and of fitting sizes have the token
    can = (
        (F.col("token") == F.col("o_token"))
        & (F.col("block") == F.col("o_met"))
        & (F.col("met") == F.col("o_block"))
        & (F.col("grp") > F.col("o_grp"))
        & ((F.col("lo") != F.col("hi")) | (F.col("o_lo") != F.col("o_hi")) | (F.col("lo") != F.col("o_lo")))
        & (F.col("most") * 100 >= F.col("o_least") * threshold)
        & (F.col("o_most") * 100 >= F.col("least") * threshold)
    )
    hits = cells.join(other, can).groupBy("grp", "o_grp").agg(F.count("*").alias("hits"), F.min(F.least("least", "o_least")).alias("least"))
    enough = F.col("hits") >= F.greatest(F.lit(1), F.floor(F.col("least") / NEEDED))
    met = common.written(hits.filter(enough).select(F.col("grp").alias("a"), F.col("o_grp").alias("b")), "jaccard-met")
    # of two classes the one in the smaller component asks, so a large family isn't asked about itself by its members
    sizes = roots.groupBy(F.col("component").alias("s_root")).agg((F.count("*") + 1).alias("size"))
    ranked = groups.join(roots, F.col("rep") == F.col("node"), "left").select("grp", "rep", "n", F.coalesce("component", "rep").alias("root"))
    ranked = ranked.join(sizes, F.col("root") == F.col("s_root"), "left").select("grp", "rep", "n", F.struct(F.coalesce("size", F.lit(1).cast("long")).alias("size"), "root").alias("rank"))
    ranked = common.written(ranked, "jaccard-ranked")
    tops = ranked.groupBy(F.col("grp").alias("t_grp")).agg(F.max("rank").alias("top"), F.min("n").alias("t_least"), F.max("n").alias("t_most"))
    ways = met.select(F.col("a").alias("asking"), F.col("b").alias("asked")).unionByName(met.select(F.col("b").alias("asking"), F.col("a").alias("asked")))
    ways = common.written(ways.join(tops, F.col("asked") == F.col("t_grp")).select("asking", "asked", "top", "t_least", "t_most"), "jaccard-ways")
    fits = (F.col("t_most") * 100 >= F.col("n") * threshold) & (F.col("n") * 100 >= F.col("t_least") * threshold)
    asks = ways.join(ranked, (F.col("grp") == F.col("asking")) & (F.col("rank") < F.col("top")) & fits)
    pairs = common.written(asks.select("rep", F.col("asked").alias("grp")), "jaccard-pairs")
    if not pairs.isEmpty():
        asked = dealt_evenly(common.written(groups.join(pairs.select("grp").distinct(), "grp", "left_semi").groupBy("grp").agg(F.count("*").alias("members")), "jaccard-asked"), "members")
        unions = group_unions(asked, groups, docs, id_col, text_col)
        pairs = qualifying(pairs, unions, docs, id_col, text_col, threshold)
        if not pairs.isEmpty():
            edges = edges.unionByName(open_groups(pairs, groups, roots, docs, id_col, text_col, threshold))
            roots = components(edges)

    final = classes.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("n").alias("c_n"), F.col("d1").alias("c_d1"), F.col("d2").alias("c_d2"), F.coalesce("component", "rep").alias("root"))
    final = common.written(final, "jaccard-classes")
    same = (F.col("n") == F.col("c_n")) & (F.col("d1") == F.col("c_d1")) & (F.col("d2") == F.col("c_d2"))
    found = usable.select("id", "n", "d1", "d2").join(final, same).select("id", "n", "root")
    rest = signed.filter("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("root"))
    return found.unionByName(rest).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, one row of each id; rows without an id stay."""
    names = docs.columns
    plain = docs.toDF(*["id" if c == id_col else "text" if c == text_col else f"x{k}" for k, c in enumerate(names)])
    found = common.written(jaccard_components(plain.select("id", "text"), "id", "text", threshold).select("id", F.col("component_id").alias("root")), "jaccard-found")
    gone = found.filter("id <> root").select(F.col("id").alias("gone")).distinct()
    if _small(gone):
        gone = F.broadcast(gone)
    kept = plain.join(gone, F.col("id") == F.col("gone"), "left_anti")
    if not found.filter("id = root").groupBy("id").count().filter("count > 1").isEmpty():
        kept = kept.filter(F.col("id").isNull()).unionByName(kept.filter(F.col("id").isNotNull()).dropDuplicates(["id"]))
    return kept.toDF(*names)
