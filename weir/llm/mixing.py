"""Mixing sources to target weights, in DataFrame functions only.

Capped water-filling: each source's share of the budget follows its weight, a source is clamped at `max_epochs` times
its size, and the excess goes to the others by weight until none is above: a round adds up the sources not yet clamped
and what is left for them, and clamps those that this level fills; rounds end when none is (a handful, as a rule, and at
most one for each source). Nothing but those two sums reaches the driver. A source then takes whole repetitions of all its documents and the fractional rest from documents in
the order of a seeded digest, up to the document that comes nearest to the target.

The rest is found without sorting a source in one task: digests fall into BUCKETS buckets, bucket sums give the
bucket in which the target lies, and a running sum inside each bucket (1 / BUCKETS of a source) gives the document.

Defined results: a null text has size 0; a null source is a source of its own, last in order; empty tables give empty
results; repeated rows are taken row by row; sources without weight (null or not above 0) get target 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Buckets of the seeded digest in each source.
BUCKETS = 4096
#: Up to this many sources the table of targets (some 60 bytes a row) is broadcast.
BROADCAST_SOURCES = 50_000
#: Beyond, rows are joined to it by source and one of so many salts, as a source may hold a third of all rows.
SALTS = 32
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycling_weights(sizes: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, over the sources by code point, null last. sizes: one row for each source.

    Places are counted inside the parts of a range partitioning, whose sizes are then added up.
    """
    order = F.col("source").asc_nulls_last()
    parts = max(1, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = common.written(sizes.select("source").repartitionByRange(parts, order).withColumn("part", F.spark_partition_id().cast("long")), "mix-order")
    before = common.sums_before(dealt.groupBy("part").agg(F.count("*").alias("n")), "part", "n").withColumnRenamed("part", "b_part")
    place = dealt.withColumn("inside", F.row_number().over(W.partitionBy("part").orderBy(order))).join(before, F.col("part") == F.col("b_part"))
    return place.select("source", (F.pmod(F.col("before") + F.col("inside") - 1, F.lit(3)) + 1).cast("double").alias("weight"))


def water_fill(sizes: DataFrame, weights: DataFrame, share: float = 1.0, max_epochs: float = 3.0) -> DataFrame:
    """sizes: source, source_size, one row for each source; returns source, source_size, target."""
    w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("w"))
    s = sizes.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left").select(
        "source", "source_size", F.when(F.col("w") > 0, F.col("w")).otherwise(0.0).alias("w"), (F.col("source_size") * max_epochs).alias("cap")
    )
    s = common.written(s, "mix-sources")
    budget = (s.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full, rounds = 0.0, -1, F.lit(False)
    while True:
        state = s.agg(
            F.count_if(rounds).alias("full"), F.sum(F.when(rounds, F.col("cap"))).alias("capped"), F.sum(F.when(~rounds, F.col("w"))).alias("w_left")
        ).first()
        if state["full"] == full or not state["w_left"]:
            break
        # the level only rises, so what was clamped stays so
        full, level = state["full"], (budget - (state["capped"] or 0.0)) / state["w_left"]
        rounds = (F.col("w") > 0) & (F.lit(level) * F.col("w") >= F.col("cap"))
    target = F.when(F.col("w") <= 0, 0.0).when(rounds, F.col("cap")).otherwise(F.lit(level) * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: int = 17, share: float = 1.0, max_epochs: float = 3.0, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns of docs, source, size, source_size, target, repeats, taken; one row for each row of docs."""
    kept = [F.col(c).alias(f"k_{c}") for c in keep]
    lead = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    sized = docs.select(*kept, F.col("doc_id").alias("order_id"), "source", word_count(F.col("text")).alias("size"), F.md5(lead.cast("binary")).alias("draw"))
    sized = sized.withColumn("bucket", F.conv(F.substring("draw", 1, 3), 16, 10).cast("int"))
    if "text" not in keep:  # some 60 bytes a row, instead of counting words twice
        sized = common.written(sized, "mix-sized")
    buckets = common.written(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    sizes = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = common.written(water_fill(sizes, cycling_weights(sizes) if weights is None else weights, share, max_epochs), "mix-targets")
    small = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    hint = F.broadcast if small else (lambda x: x)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets.select(F.col("source").alias("t_source"), "source_size", "target", F.floor(ratio).alias("whole"), (F.col("target") - F.floor(ratio) * F.col("source_size")).alias("rest"))
    # The bucket in which the fractional rest ends, and what of it is left there.
    run = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    reached = (
        buckets.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
        .join(hint(plan), F.col("source").eqNullSafe(F.col("t_source")))
        .filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        .select(F.col("source").alias("c_source"), F.col("bucket").alias("cut"), (F.col("rest") - F.col("before")).alias("room"))
    )
    plan = plan.join(reached, F.col("t_source").eqNullSafe(F.col("c_source")), "left").drop("c_source")
    if small:
        joined = sized.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("t_source")))
    else:
        spread = plan.withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = sized.withColumn("salt", F.pmod("bucket", F.lit(SALTS)))
        joined = salted.join(spread, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("salt") == F.col("t_salt"))).drop("salt", "t_salt")
    inside = W.partitionBy("source", "bucket").orderBy("draw", "order_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    at_cut = F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False))
    run_sum = F.sum("size").over(inside)
    if "text" in keep:  # wide rows: only those of the cut buckets are shuffled, at the price of another scan
        ranked = joined.filter(~at_cut).withColumn("upto", F.lit(None).cast("long")).unionByName(joined.filter(at_cut).withColumn("upto", run_sum))
    else:
        ranked = joined.withColumn("upto", run_sum)
    more = F.when(F.col("cut").isNull(), False).when(~at_cut, F.col("bucket") < F.col("cut")).otherwise(F.col("upto") - F.col("size") / 2.0 <= F.col("room"))
    # No document is taken more often than max_epochs (a fraction of it: for a part of the documents), even where rounding leaves a rest.
    repeats = F.least(F.col("whole") + F.when(more & (F.col("rest") > 0), 1).otherwise(0), F.lit(math.ceil(max_epochs))).cast("long")
    made = {"source": F.col("source"), "size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "repeats": F.col("repeats"), "taken": F.col("repeats") * F.col("size")}
    return ranked.withColumn("repeats", repeats).select(*[F.col(f"k_{c}").alias(c) for c in keep], *[v.alias(c) for c, v in made.items() if c not in keep])


def mixed_documents(docs: DataFrame, weights: DataFrame | None = None, seed: int = 17, share: float = 1.0, max_epochs: float = 3.0) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    names = docs.columns
    plain = docs.toDF(*[c if c in ("doc_id", "text", "source") else f"x_{k}" for k, c in enumerate(names)])
    out = mix(plain, weights, seed, share, max_epochs, keep=tuple(plain.columns))
    copies = F.when(F.col("repeats") > 0, F.sequence(F.lit(1).cast("long"), F.col("repeats")))
    return out.withColumn("copy", F.explode(copies)).select(*plain.columns).toDF(*names)
