"""Fidelity measures over sample pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frames that the two signals may be shifted against each other.
MAX_LAG = 240
#: Frames over which signals are compared to find the shift.
WINDOW = 12_000


def duration_error(a: Column, b: Column) -> Column:
    """2 |a - b| / (a + b); 0 for two zeros."""
    return F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise(2 * F.abs(a - b) / (a + b))


def si_sdr(pairs: DataFrame, keys: tuple[str, ...] = ("case_id", "channel")) -> DataFrame:
    """Scale-invariant signal-to-distortion ratio in dB of samples (keys, pos, reference, estimate), means removed.

    Fewer than three samples have none (null): without their mean, two are always in proportion.
    """
    sums = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.sum(F.col(a) * F.col(b)).alias(f"{a[0]}{b[0]}") for a, b in (("reference", "reference"), ("reference", "estimate"), ("estimate", "estimate"))],
        F.sum("reference").alias("sr"),
        F.sum("estimate").alias("se"),
    )
    rr = F.col("rr") - F.col("sr") * F.col("sr") / F.col("n")
    re = F.col("re") - F.col("sr") * F.col("se") / F.col("n")
    ee = F.col("ee") - F.col("se") * F.col("se") / F.col("n")
    target = re * re / F.when(rr > 0, rr)
    noise = F.greatest(ee - target, F.lit(1e-30))
    ratio = 10 * F.log10(F.greatest(target, F.lit(1e-30)) / noise)
    return sums.select(*keys, F.when(F.col("n") > 2, ratio).alias("si_sdr_db"))


def shared_lag(pairs: DataFrame, case: str = "case_id", most: int = MAX_LAG, window: int = WINDOW) -> DataFrame:
    """The lag, common to a case's channels, of the greatest normalised cross-correlation; ties: the first of 0, 1, -1, 2, ...

    An equi-join on the shifted place, for as many lags as are allowed; `window` frames from the first shared one count.
    """
    lags = F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag")
    left = pairs.select(case, "channel", "pos", "reference").select("*", lags).withColumn("at", F.col("pos") + F.col("lag")).filter(F.col("pos") - F.greatest(-F.col("lag"), F.lit(0)) < window)
    right = pairs.select(F.col(case).alias("r_case"), F.col("channel").alias("r_channel"), F.col("pos").alias("r_pos"), "estimate")
    met = left.join(right, (F.col(case) == F.col("r_case")) & (F.col("channel") == F.col("r_channel")) & (F.col("at") == F.col("r_pos")))
    sums = met.groupBy(case, "lag").agg(F.sum(F.col("reference") * F.col("estimate")).alias("xy"), F.sum(F.col("reference") ** 2).alias("xx"), F.sum(F.col("estimate") ** 2).alias("yy"))
    score = F.col("xy") / F.sqrt(F.greatest(F.col("xx") * F.col("yy"), F.lit(1e-300)))
    rank = F.struct(score.alias("score"), (-F.abs("lag")).alias("near"), F.col("lag").alias("early"))
    return sums.groupBy(case).agg(F.max_by("lag", rank).alias("lag"))


def mean_ssim(frames: DataFrame, case: str = "case_id", least: float = 0.9) -> DataFrame:
    """frames (case, ssim): the mean and whether it reaches `least`."""
    return frames.groupBy(case).agg(F.avg("ssim").alias("mean_ssim")).withColumn("passed", F.col("mean_ssim") >= least)


def evidence_problems(evidence: DataFrame, required: DataFrame) -> DataFrame:
    """Missing, repeated and failed case ids of a run."""
    seen = evidence.groupBy("case_id").agg(F.count("*").alias("n"), F.min(F.col("passed").cast("int")).alias("ok"))
    missing = required.join(seen, "case_id", "left_anti").select("case_id", F.lit("missing").alias("problem"))
    repeated = seen.filter("n > 1").select("case_id", F.lit("repeated").alias("problem"))
    failed = seen.filter("ok = 0").select("case_id", F.lit("failed").alias("problem"))
    return missing.unionByName(repeated).unionByName(failed)
