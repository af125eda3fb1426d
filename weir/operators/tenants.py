"""Tenant policies: versioned slots merged from snapshots in order of arrival, keys and signatures, lookups.

A slot is (tenant_id, version, policy_id, limits): policy and limits null is a tombstone. Snapshots are policy or media
events with an explicit sequence number; the merge isn't commutative, so every tenant's events are folded in that order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weir.functions.binary import hmac_sha256
from weir.plans.policy import canonical_json, canonical_policy, merged

LIMITS = ("video_max_duration_secs", "video_max_bitrate_kbps", "audio_max_duration_secs", "audio_max_bitrate_kbps", "audio_max_channels")
OUTCOMES = ("upsert_applied", "upsert_ignored_stale", "remove_applied", "remove_ignored_stale", "remove_already_removed", "rejected_invalid_signature")


@dataclass
class Slot:
    version: int | None = None
    policy: Any = None
    provenance: Any = None
    limits: Any = None
    limits_provenance: Any = None

    @property
    def active(self) -> bool:
        return self.policy is not None or self.limits is not None


def apply(slot: Slot, kind: str, version: int, payload: Any, provenance: Any = None) -> str:
    """Changes the slot by one event ('policy' or 'media'; payload None removes) and says what came of it."""
    known = slot.version is not None
    if payload is not None:
        if known and slot.version >= version:
            return "upsert_ignored_stale"
        if kind == "policy":  # a new policy drops the media limits
            slot.version, slot.policy, slot.provenance, slot.limits, slot.limits_provenance = version, payload, provenance, None, None
        else:
            slot.version, slot.limits, slot.limits_provenance = version, payload, provenance
        return "upsert_applied"
    if known and slot.version > version:
        return "remove_ignored_stale"
    gone = not slot.active if kind == "policy" else slot.limits is None
    if known and slot.version == version and gone:
        return "remove_already_removed"
    slot.version, slot.limits, slot.limits_provenance = version, None, None
    if kind == "policy":
        slot.policy = slot.provenance = None
    return "remove_applied"


def upsert(slot: Slot, policy: Any, provenance: Any = None) -> None:
    """Unconditional: the next version, without media limits."""
    slot.version, slot.policy, slot.provenance, slot.limits, slot.limits_provenance = (slot.version or 0) + 1, policy, provenance, None, None


def remove(slot: Slot) -> None:
    """Unconditional: a tombstone of the next version, also for an unknown tenant."""
    upsert(slot, None)


EVENTS = "seq long, tenant_id string, version long, kind string, payload string, provenance string"


FOLDED = "seq long, tenant_id string, outcome string, version long, policy string, limits string, provenance string"


def fold(events: DataFrame) -> DataFrame:
    """events (see EVENTS; payload null removes): seq, tenant_id, outcome and the slot after each event.

    A tenant's events come sorted and are taken one by one with the slot as the only state, however long its history is.
    """
    names = [c.split()[0] for c in EVENTS.split(", ")]
    dealt = events.select(*names).repartition("tenant_id").sortWithinPartitions("tenant_id", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, last = Slot(), (None,)
        for batch in batches:
            out = []
            for seq, tenant, version, kind, payload, provenance in zip(*(batch.column(c).to_pylist() for c in names)):
                if (tenant, True) != last:
                    slot, last = Slot(), (tenant, True)
                outcome = apply(slot, kind, version, payload, provenance)
                shown = (slot.limits_provenance or slot.provenance) if slot.limits is not None else slot.provenance
                out.append((seq, tenant, outcome, slot.version, slot.policy, slot.limits, shown))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), _FOLDED_TYPES)] if out else [pa.array([], t) for t in _FOLDED_TYPES]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FOLDED.split(", ")])

    return dealt.mapInArrow(run, FOLDED)


_FOLDED_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]


def latest(folded: DataFrame) -> DataFrame:
    """Every tenant's slot after its last event."""
    return folded.groupBy("tenant_id").agg(F.max_by(F.struct("version", "policy", "limits", "provenance"), "seq").alias("s")).select("tenant_id", "s.*")


def import_report(folded: DataFrame) -> DataFrame:
    """One row with the number of events of each outcome."""
    return folded.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])


def upsert_only(events: DataFrame, tenant: str, seq: str, version: str) -> DataFrame:
    """Outcomes of upserts alone, without a fold: an event counts if its version is above all before it."""
    before = W.partitionBy(tenant).orderBy(seq).rowsBetween(W.unboundedPreceding, -1)
    top = F.max(version).over(before)
    return events.withColumn("outcome", F.when(top.isNull() | (F.col(version) > top), "upsert_applied").otherwise("upsert_ignored_stale"))


#: Up to this many active slots the table (some 100 bytes a row) is broadcast, so that no payload is shuffled by tenant.
BROADCAST_SLOTS = 200_000
#: Beyond, objects are joined by tenant and one of so many salts, as a tenant may have a third of all objects.
SALTS = 32


def resolve(objects: DataFrame, slots: DataFrame, fallback: str = "standard") -> DataFrame:
    """Adds policy_id: the tenant's active one, else the fallback; a null tenant has no slot."""
    active = slots.filter(F.col("policy").isNotNull()).select(F.col("tenant_id").alias("s_tenant"), F.col("policy").alias("s_policy"))
    fits = F.col("tenant_id") == F.col("s_tenant")
    if active.limit(BROADCAST_SLOTS + 1).count() <= BROADCAST_SLOTS:
        both = objects.join(F.broadcast(active), fits, "left")
    else:
        salted = objects.withColumn("s_salt", F.pmod(F.xxhash64("object_id"), F.lit(SALTS)))
        spread = active.withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = salted.join(spread, fits & (F.col("s_salt") == F.col("t_salt")), "left").drop("s_salt", "t_salt")
    return both.withColumn("policy_id", F.coalesce("s_policy", F.lit(fallback))).drop("s_tenant", "s_policy")


def change_slots(slots: DataFrame, changes: DataFrame) -> DataFrame:
    """slots (tenant_id, version, policy, limits, provenance) after unconditional changes (seq, tenant_id, policy, provenance).

    A null policy removes. Each change is the tenant's next version, whatever it was, drops the media limits, and leaves a
    tombstone where it removes, also for an unknown tenant; so of several changes of a tenant the last one counts, and
    the version rises by their number.
    """
    last = changes.groupBy(F.col("tenant_id").alias("c_tenant")).agg(F.count("*").alias("c_n"), F.max_by(F.struct("policy", "provenance"), "seq").alias("c_last"))
    both = slots.join(last, F.col("tenant_id").eqNullSafe(F.col("c_tenant")) & F.col("c_n").isNotNull(), "full_outer")
    changed = F.col("c_n").isNotNull()
    return both.select(
        F.when(changed, F.col("c_tenant")).otherwise(F.col("tenant_id")).alias("tenant_id"),
        (F.coalesce("version", F.lit(0)) + F.coalesce("c_n", F.lit(0))).cast("long").alias("version"),
        F.when(changed, F.col("c_last.policy")).otherwise(F.col("policy")).alias("policy"),
        F.when(~changed, F.col("limits")).alias("limits"),
        F.when(changed & F.col("c_last.policy").isNotNull(), F.col("c_last.provenance")).when(~changed, F.col("provenance")).alias("provenance"),
    )


def effective_policy(base: Mapping[str, Any] | None, limits: Mapping[str, Any] | None, fallback: Mapping[str, Any]) -> dict[str, Any] | None:
    """Base or fallback with the limits that aren't null laid over it; null for a tombstone."""
    if base is None and limits is None:
        return None
    changes: dict[str, Any] = {}
    for name, value in (limits or {}).items():
        if value is not None:
            kind, _, key = name.partition("_")
            changes.setdefault(kind, {})[key] = value
    return merged(base if base is not None else fallback, changes)


def override(policies: DataFrame, limits: DataFrame, fallback: Mapping[str, int]) -> DataFrame:
    """Effective media limits by tenant: policies and limits have tenant_id and the LIMITS columns (null: not set)."""
    p = policies.select(F.col("tenant_id").alias("p_tenant"), *[F.col(c).alias(f"p_{c}") for c in LIMITS])
    m = limits.select(F.col("tenant_id").alias("m_tenant"), *[F.col(c).alias(f"m_{c}") for c in LIMITS])
    both = p.join(m, F.col("p_tenant") == F.col("m_tenant"), "full_outer")
    chosen = [F.coalesce(F.col(f"m_{c}"), F.when(F.col("p_tenant").isNotNull(), F.col(f"p_{c}")).otherwise(F.lit(fallback[c]))).alias(c) for c in LIMITS]
    return both.select(F.coalesce("p_tenant", "m_tenant").alias("tenant_id"), *chosen)


def snapshot_payload(tenant_id: str, version: int, policy: Mapping[str, Any] | None, provenance: Mapping[str, Any] | None = None) -> str:
    """What is signed of a policy snapshot."""
    return canonical_json({"tenant_id": tenant_id, "version": version, "policy": canonical_policy(policy), "provenance": provenance})


def media_payload(tenant_id: str, version: int, limits: Mapping[str, int | None] | None, provenance: Mapping[str, Any] | None = None) -> str:
    shown = None if limits is None else {name: limits.get(name) for name in LIMITS}
    return canonical_json({"tenant_id": tenant_id, "version": version, "limits": shown, "provenance": provenance})


@dataclass
class Key:
    secret: bytes
    deprecated_after: int | None = None


@dataclass
class KeyRing:
    keys: dict[str, Key] = field(default_factory=dict)
    grace_ms: int = 0

    def rows(self) -> list[tuple[str, int | None, int]]:
        return [(k, v.deprecated_after, self.grace_ms) for k, v in self.keys.items()]


def verification(payload: Column, key_id: Column, digest: Column, ring: KeyRing, now_ms: Column | int) -> Column:
    """What comes of a signed snapshot: verified_current, verified_in_grace or rejected_(unknown_key|expired|invalid_signature).

    A deprecated key verifies up to and including the end of its grace period.
    """
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    out = F.when(F.lit(False), F.lit(""))
    for name, key in ring.keys.items():
        state = "verified_current" if key.deprecated_after is None else "verified_in_grace"
        good = F.when(hmac_sha256(key.secret, payload.cast("binary")) == digest, state).otherwise("rejected_invalid_signature")
        if key.deprecated_after is not None:
            good = F.when(now > key.deprecated_after + ring.grace_ms, "rejected_expired").otherwise(good)
        out = out.when(key_id == name, good)
    return out.otherwise("rejected_unknown_key")


def key_state(now: Column, deprecated_after: Column, grace: Column) -> Column:
    return F.when(deprecated_after.isNull(), "current").when(now > F.least(F.lit(2**62), deprecated_after + grace), "expired").otherwise("in_grace")


def key_usage(outcomes: DataFrame) -> DataFrame:
    """outcomes (key_id, outcome): counters of every key; a use within grace counts as verified too."""
    o = F.col("outcome")
    return outcomes.groupBy("key_id").agg(
        F.count("*").alias("seen"),
        F.count_if(o.isin("verified_current", "verified_in_grace")).alias("verified"),
        F.count_if(o == "verified_in_grace").alias("verified_in_grace"),
        F.count_if(o == "rejected_unknown_key").alias("rejected_unknown_key"),
        F.count_if(o == "rejected_expired").alias("rejected_expired"),
        F.count_if(o == "rejected_invalid_signature").alias("rejected_invalid_signature"),
    )


def canonical_snapshot(kind: str, content: Column, tenant_id: Column, version: Column, provenance: Column) -> Column:
    """What is signed of a 'policy' or 'media' snapshot, from its own fields: compact JSON in this order, nulls kept.

    content and provenance are JSON texts (canonical themselves) or null.
    """
    name = F.regexp_extract(F.to_json(F.struct(tenant_id.alias("v"))), '(?s)^\\{"v":(.*)\\}$', 1)
    part = "policy" if kind == "policy" else "limits"
    null = F.lit("null")
    return F.concat(F.lit('{"tenant_id":'), name, F.lit(',"version":'), version.cast("string"), F.lit(f',"{part}":'), F.coalesce(content, null), F.lit(',"provenance":'), F.coalesce(provenance, null), F.lit("}"))


def accepted_by(form: str, canonical: Column, secret: bytes | None = None, ring: KeyRing | None = None, now_ms: Column | int = 0) -> Column:
    """Whether a snapshot's signature holds: form is plain, sha (column sha256), hmac or ring (key_id and hmac_sha256)."""
    data = canonical.cast("binary")
    if form == "plain":
        return F.lit(True)
    if form == "sha":
        good = F.sha2(data, 256) == F.col("sha256")
    elif form == "hmac":
        good = hmac_sha256(secret or b"", data) == F.col("hmac_sha256")
    elif form == "ring":
        good = verification(canonical, F.col("key_id"), F.col("hmac_sha256"), ring or KeyRing(), now_ms).isin("verified_current", "verified_in_grace")
    else:
        raise ValueError(f"unknown form {form}")
    return F.coalesce(good, F.lit(False))


def imported(snapshots: DataFrame, kind: str, form: str, secret: bytes | None = None, ring: KeyRing | None = None, now_ms: Column | int = 0) -> DataFrame:
    """One of the eight imports: 'policy' or 'media' snapshots in one of the four forms, folded in order of `seq`.

    snapshots: seq, tenant_id, version, payload (canonical JSON of the policy or limits; null removes), provenance (JSON
    or null) and the columns of the form. The signature is checked over the canonical form of these very fields; rejected
    snapshots come out as such and change nothing.
    """
    canonical = canonical_snapshot(kind, F.col("payload"), F.col("tenant_id"), F.col("version"), F.col("provenance"))
    events = snapshots.withColumn("kind", F.lit(kind)).withColumn("accepted", accepted_by(form, canonical, secret, ring, now_ms))
    return signed_import(events, F.col("accepted"))


def signed_import(events: DataFrame, accepted: Column) -> DataFrame:
    """Folds the events whose signature is accepted; the others (also where that is null) come out as rejected and change nothing."""
    sound = F.coalesce(accepted, F.lit(False))
    good = fold(events.filter(sound).select(*[c.split()[0] for c in EVENTS.split(", ")]))
    bad = events.filter(~sound).select("seq", "tenant_id", F.lit("rejected_invalid_signature").alias("outcome"), *[F.lit(None).cast(t).alias(c) for c, t in (("version", "long"), ("policy", "string"), ("limits", "string"), ("provenance", "string"))])
    return good.unionByName(bad)


def replay(events: Iterable[Mapping[str, Any]]) -> Iterator[tuple[str, Slot]]:
    """The fold on the driver, for small histories and tests."""
    slots: dict[str, Slot] = {}
    for e in events:
        slot = slots.setdefault(e["tenant_id"], Slot())
        yield apply(slot, e["kind"], e["version"], e["payload"], e.get("provenance")), slot


def export(folded: DataFrame) -> DataFrame:
    """Every tenant's slot with the provenance that holds: the limits' own while there are limits, else the policy's."""
    return latest(folded).select("tenant_id", "version", "policy", "limits", "provenance")


def publish(slots: DataFrame, folder: str, expected: int) -> bool:
    """Writes the slot table as version expected + 1 if no one else has; false if the version is taken.

    The table is written aside; making the version's mark, which can't exist before, is the swap.
    """
    import uuid

    spark = slots.sparkSession
    passing = f"{folder}/data-{uuid.uuid4().hex}"
    slots.write.parquet(passing)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = fs.create(fs_path(f"{folder}/version-{expected + 1:012d}"), False)
    except Exception as e:  # noqa: BLE001  any failure to make the mark leaves the published version as it is
        fs.delete(fs_path(passing), True)
        if "exist" in str(e).lower():
            return False
        raise
    out.write(bytearray(passing.rsplit("/", 1)[1].encode()))
    out.close()
    return True


def published(spark: Any, folder: str) -> tuple[int, DataFrame | None]:
    """The last published version and its slots; 0 and None before any."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path(folder)):
        return 0, None
    marks = sorted(s.getPath().getName() for s in fs.listStatus(fs_path(folder)) if s.getPath().getName().startswith("version-"))
    if not marks:
        return 0, None
    name = spark.read.text(f"{folder}/{marks[-1]}", wholetext=True).first()[0]
    return int(marks[-1].split("-")[1]), spark.read.parquet(f"{folder}/{name}")
