"""URL filters by host-suffix and path-prefix expressions.

Every URL is expanded into expressions (the last k labels of its host followed by the first p characters of its
path) for exactly those (k, p) shapes that occur among the rules. Expressions meet rules in an equi-join on the
first 32 bits of their SHA-256; the full digest then confirms a hit, and the longest rule wins (ties: longer host,
then block).

Defined results: a null URL or one without `://` has an empty host and path and matches no rule but an empty-host
one; repeated rows stay repeated; an empty table gives an empty result; duplicate rules count once, and where the
same pattern both blocks and allows, block wins. Columns other than `id_cols` and the URL don't take part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this many rules they are broadcast (some 100 bytes each); beyond, both sides are shuffled with salt.
BROADCAST_RULES = 200_000
#: Salt of the shuffled join: one expression (such as a top-level domain) may stand for a third of all rows.
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def compile_rules(rules: DataFrame) -> DataFrame:
    """rules: host, path, action ('allow' or 'block'). One row for each pattern, with its digest and shape."""
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    path = F.coalesce("path", F.lit(""))
    return (
        rules.select(host.alias("r_host"), path.alias("r_path"), F.col("action"))
        .groupBy("r_host", "r_path")
        .agg(F.max("action").alias("r_action"))  # 'block' > 'allow'
        .withColumn("r_digest", F.sha2(F.concat_ws("\0", "r_host", "r_path"), 256))
        .withColumn("r_prefix", F.substring("r_digest", 1, 8))
        .withColumn("r_labels", F.size(F.split("r_host", r"\.")))
        .withColumn("r_chars", F.length("r_path"))
    )


def url_filter(urls: DataFrame, rules: DataFrame, url_col: str = "url", id_cols: Sequence[str] = ("page_id",), default: str = "allow") -> DataFrame:
    """id_cols, url_col, host, path, rule (host + path of the deciding rule, else null), verdict ('allow' or 'block')."""
    compiled = compile_rules(rules)
    # The shapes are pairs of two small numbers: as many as the rules' label counts times path lengths at most.
    shapes = [(r[0], r[1]) for r in compiled.select("r_labels", "r_chars").distinct().collect()]
    small = compiled.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    ids = [F.col(c).alias(f"id_{k}") for k, c in enumerate(id_cols)]
    keys = [f"id_{k}" for k in range(len(id_cols))] + ["url"]
    base = urls.select(*ids, F.col(url_col).alias("url")).withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    labels = F.split("host", r"\.")
    wanted = [
        F.when(
            (F.size(labels) >= k) & (F.length("path") >= p),
            F.sha2(F.concat(F.array_join(F.slice(labels, -k, k), "."), F.lit("\0"), F.substring(F.col("path"), 1, p)), 256),
        )
        for k, p in sorted(shapes)
    ]
    # The leading empty expression hits nothing and keeps each row once, so its count is the row's multiplicity.
    expanded = base.withColumn("digest", F.explode(F.array_compact(F.array(F.lit(""), *wanted)))).withColumn("prefix", F.substring("digest", 1, 8))
    hit = (F.col("prefix") == F.col("r_prefix")) & (F.col("digest") == F.col("r_digest"))
    if small:
        joined = expanded.join(F.broadcast(compiled), hit, "left")
    else:
        salt = F.pmod(F.xxhash64(*keys), F.lit(SALTS))
        spread = compiled.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = expanded.withColumn("salt", salt).join(spread, hit & (F.col("salt") == F.col("r_salt")), "left")
    rank = F.when(
        F.col("r_digest").isNotNull(),
        F.struct((F.length("r_host") + F.col("r_chars")).alias("chars"), F.length("r_host").alias("host_chars"), F.concat("r_host", "r_path").alias("rule"), F.col("r_action").alias("action")),
    )
    best = joined.groupBy(*keys).agg(F.max(rank).alias("best"), F.count_if(F.col("digest") == "").alias("copies"))
    return (
        best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .withColumn("host", url_host(F.col("url")))
        .withColumn("path", url_path(F.col("url")))
        .select(
            *[F.col(f"id_{k}").alias(c) for k, c in enumerate(id_cols)],
            F.col("url").alias(url_col),
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce("best.action", F.lit(default)).alias("verdict"),
        )
    )
