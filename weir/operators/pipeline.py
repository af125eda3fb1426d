"""The whole decision for every object: gates, signature scan, rebuild, output checks, re-reading, verdict, release.

objects: object_id, file_name, declared_mime, tenant_id, source, payload. Everything but the rebuild is one projection;
the bytes go to Python once, and only for rows that no gate has decided.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions import names, sniff
from weir.functions.binary import sha256

from . import gates as G
from .rebuild import policy_json, rebuilt
from .signatures import Rule, executable_magic, hits, rule_set

#: Up to this many policies the table is broadcast.
BROADCAST_POLICIES = 10_000


def with_policy(objects: DataFrame, policies: DataFrame, default: str = "standard") -> DataFrame:
    """Adds the policy struct `p`: of the row's policy_id, or of the default one.

    Every object stays once: `p` is null where no policy has that id, and of policies that share an id the greatest (by
    its fields in order) counts.
    """
    fields = [c for c in policies.columns if c != "policy_id"]
    table = policies.groupBy(F.col("policy_id").alias("p_id")).agg(F.max(F.struct(*fields)).alias("p"))
    if policies.limit(BROADCAST_POLICIES + 1).count() <= BROADCAST_POLICIES:
        table = F.broadcast(table)
    wanted = F.coalesce(F.col("policy_id"), F.lit(default)) if "policy_id" in objects.columns else F.lit(default)
    return objects.withColumn("p_wanted", wanted).join(table, F.col("p_wanted") == F.col("p_id"), "left").drop("p_wanted", "p_id")


def detected(objects: DataFrame) -> DataFrame:
    """Adds size, ext, sniffed, by_name, by_mime, kind and disagree (of the normal types by name, bytes and declaration).

    The size is that of the payload, or the column `length` where the source left the payload out because of its size.
    """
    data, name = F.col("payload"), F.col("file_name")
    size = F.coalesce(F.length(data).cast("long"), F.col("length").cast("long")) if "length" in objects.columns else F.length(data).cast("long")
    return (
        objects.withColumn("file_name", F.nullif(name, F.lit("")))
        .withColumn("size", size)
        .withColumn("ext", names.extension(name))
        .withColumn("sniffed", sniff.sniff_mime(data))
        .withColumn("by_name", names.kind_of_extension(F.col("ext")))
        .withColumn("by_mime", names.kind_from_mime(F.col("sniffed")))
        .withColumn("kind", sniff.classify(data, name, F.col("by_mime"), F.col("by_name")))
        .withColumns({"n_name": names.normal_mime(names.mime_of_extension(F.col("ext"))), "n_sniffed": names.normal_mime(F.col("sniffed")), "n_declared": names.normal_mime(F.col("declared_mime"))})
        .withColumn("disagree", G.metadata_disagrees(F.col("n_name"), F.col("n_sniffed"), F.col("n_declared")))
    )


def defend(objects: DataFrame, policies: DataFrame, rules: Sequence[Rule] = (), default: str = "standard") -> DataFrame:
    """One row for each object: error_kind, verdict, released, alerts, stages, artifact columns and parser_used.

    An object whose policy isn't known is the error UnknownPolicy, one without bytes that isn't too large MissingPayload.
    """
    p, name, data = F.col("p"), F.col("file_name"), F.col("payload")
    wanted = rule_set(rules)
    d = detected(with_policy(objects, policies, default))
    by_name, by_mime, kind, sniffed, declared = (F.col(c) for c in ("by_name", "by_mime", "kind", "sniffed", "declared_mime"))
    scanned = p["signature_scan_mode"] == "InputAndOutput"
    d = d.withColumn("early_error", F.coalesce(F.when(p.isNull(), "UnknownPolicy"), G.too_large(F.col("size"), p), G.blocked_extension(F.col("ext"), p), F.when(data.isNull(), "MissingPayload")))
    live = F.col("early_error").isNull()
    d = d.withColumn("pre_hits", F.when(live & scanned, hits(data, wanted, p["signature_rules"])).otherwise(G.none_of("array<string>")))
    d = d.withColumn("pre_alerts", G.signature_alerts(F.col("pre_hits")))
    stopped = live & (F.size("pre_hits") > 0) & p["block_on_pre_scan_match"] & (p["enforcement_mode"] == "Enforce")
    d = d.withColumn("stopped", stopped)
    late = F.coalesce(G.kind_mismatch(by_name, by_mime, p), G.metadata_mismatch(F.col("disagree"), p))
    d = d.withColumn("type_error", F.when(live & ~F.col("stopped"), late))
    level_error = F.when(p["decoder_failure_mode"] == "Block", G.level_unsupported(kind, p))
    going = live & ~F.col("stopped") & F.col("type_error").isNull()
    unsupported = G.level_unsupported(kind, p).isNotNull()
    d = d.withColumn("level_error", F.when(going, level_error))
    to_python = F.when(going & F.col("level_error").isNull(), data)
    # a level that can't be reached is a failure of the rebuild, so a quarantining policy takes the bytes as they are
    d = d.withColumn("r", rebuilt(to_python, F.when(unsupported, "other").otherwise(kind), sniffed, policy_json(p)))
    out, r = F.col("r")["output"], F.col("r")
    d = d.withColumn("error", F.coalesce("early_error", "type_error", "level_error", F.col("r")["error_kind"]))
    fine = F.col("error").isNull() & ~F.col("stopped")
    achieved = G.achieved_level(kind, r["mime"], r["stages"])
    d = d.withColumns({"achieved": achieved, "out_sniffed": sniff.sniff_mime(out), "out_size": F.length(out).cast("long"), "magic": executable_magic(out), "whole": G.structured(F.col("ext"), out)})
    d = d.withColumn("met", G.level_met(p["minimum_reconstruction_level"], F.col("achieved")))
    quarantined = F.when(unsupported, G.those(G.ALERTS, G.alert("decoder_failure_quarantine", F.concat(kind, F.lit(" can't be rebuilt as required.")), G.BLOCKING))).otherwise(G.none_of(G.ALERTS))
    up_to_detect = F.concat(F.col("pre_alerts"), G.metadata_alerts(F.col("disagree"), sniffed, declared))
    up_to_rebuild = F.concat(
        up_to_detect,
        G.those(G.ALERTS, F.when(~F.col("met"), G.alert("reconstruction_level_not_met", "The required level of reconstruction isn't reached.", G.BLOCKING))),
        F.coalesce(r["alerts"], G.none_of(G.ALERTS)),
        quarantined,
        G.output_alerts(kind, r["mime"], out, F.col("out_sniffed"), p, F.col("magic")),
        G.unknown_alerts(by_name, by_mime, p),
        G.those(G.ALERTS, G.structured_alert(kind, F.col("ext"), F.col("whole"), p)),
    )
    d = d.withColumn("rebuild_alerts", F.when(fine, up_to_rebuild))
    d = d.withColumn("scan_alerts", F.when(fine, F.concat("rebuild_alerts", G.signature_alerts(hits(out, wanted, p["signature_rules"])))))
    unread = F.when(~r["read_ok"], G.alert("output_read_failed", r["read_detail"], G.BLOCKING))
    d = d.withColumn("all_alerts", F.when(F.col("stopped"), F.col("pre_alerts")).when(fine, F.concat("scan_alerts", G.those(G.ALERTS, unread))))
    size_error = F.coalesce(G.output_too_large(F.col("out_size"), p), G.expands_too_much(F.col("size"), F.col("out_size"), p))
    d = d.withColumn("error", F.coalesce("error", F.when(fine, size_error)))
    ok = F.col("error").isNull()
    dry = p["enforcement_mode"] == "DryRun"
    d = d.withColumn("alerts", F.when(ok, F.when(dry & ~F.col("stopped"), G.soften(F.col("all_alerts"))).otherwise(F.col("all_alerts"))))
    d = d.withColumn("verdict", F.when(ok, G.verdict(F.col("alerts"))))
    digest = F.when(F.col("stopped"), sha256(data)).otherwise(sha256(out))
    d = d.withColumn("sha256", F.when(ok, digest))
    d = d.withColumn("stages", F.when(ok, _stages(d, p, kind, by_name, by_mime, declared, name, r, scanned, dry)))
    released = F.coalesce((F.col("verdict") == "clean") & (F.col("out_size") > 0), F.lit(False))
    results = d.select(
        "object_id",
        "tenant_id",
        "source",
        F.when(ok, F.col("kind")).alias("kind"),
        F.col("error").alias("error_kind"),
        "verdict",
        released.alias("released"),
        "alerts",
        "stages",
        F.when(ok, F.when(F.col("stopped"), F.coalesce("sniffed", F.lit("application/octet-stream"))).otherwise(r["mime"])).alias("mime"),
        F.when(ok, F.col("size")).alias("input_bytes"),
        F.when(ok, F.when(F.col("stopped"), F.lit(0).cast("long")).otherwise(F.col("out_size"))).alias("output_bytes"),
        "sha256",
        F.when(released, out).otherwise(F.when(ok, F.lit(bytearray(b"")))).alias("output"),
        F.when(ok, F.when(F.col("stopped"), "pre_scan_blocked").otherwise(F.col("kind"))).alias("parser_used"),
        F.when(ok, r["elapsed_ms"]).alias("duration_ms"),
    )
    # The metrics also keep filters on the result above the chain of expressions, which they would multiply when pushed down.
    return observed(results, f"weir-{uuid.uuid4().hex}")


def _stages(d: DataFrame, p: Column, kind: Column, by_name: Column, by_mime: Column, declared: Column, name: Column, r: Column, scanned: Column, dry: Column) -> Column:
    number = lambda c: c.cast("string")
    pre = F.when(scanned, G.stage("PreScan", G.status_of(F.col("pre_alerts")), F.concat(F.lit("pre_scan_alerts="), number(F.size("pre_alerts")))))
    detail = F.concat(F.lit("kind_from_name="), names.kind_label(by_name), F.lit(", kind_from_mime="), names.kind_label(by_mime), F.lit(", selected="), kind, F.lit(", declared_mime="), F.coalesce(declared, F.lit("unavailable")))
    required = F.concat(F.lit("required_reconstruction="), p["minimum_reconstruction_level"])
    reached = F.concat(required, F.lit(" achieved_reconstruction="), F.coalesce("achieved", F.lit("None")))
    middle = G.those(
        G.STAGES,
        pre,
        G.stage("Detect", G.detect_status(by_name, by_mime, p), detail),
        G.stage("Rebuild", F.when(F.col("met"), "Success").otherwise("Blocked"), reached),
    )
    tail = G.those(
        G.STAGES,
        F.when(kind == "other", G.structured_stage(name, F.col("ext"), F.col("whole"), p)),
        G.stage("Rebuild", G.status_of(F.col("rebuild_alerts")), F.concat(F.lit("rebuild_mime="), r["mime"], F.lit(" "), required)),
        G.stage("SignatureScan", G.status_of(F.col("scan_alerts")), F.concat(F.lit("signature_alerts="), number(F.size("scan_alerts")))),
        G.stage("OutputValidation", F.when(r["read_ok"], "Success").otherwise("Blocked"), F.concat(F.when(r["read_ok"], "independent_read: ").otherwise("independent_read_failed: "), r["read_detail"])),
        G.stage("OutputValidation", G.status_of(F.col("all_alerts")), F.concat(F.lit("output_size="), number(F.col("out_size")), F.lit(" max_output_size="), number(p["max_output_size_bytes"]), F.lit(" max_expansion_ratio="), number(p["max_output_expansion_ratio"]))),
    )
    whole = F.concat(middle, F.coalesce(r["stages"], G.none_of(G.STAGES)), tail)
    softened = F.when(dry, G.soften_stages(whole)).otherwise(whole)
    envelope = G.stage("OutputValidation", "Blocked", F.concat(F.lit("quarantine_ready reason="), G.first_block_reason(F.col("alerts")), F.lit(" sha256="), F.col("sha256")))
    full = F.concat(softened, G.those(G.STAGES, F.when(F.col("verdict") == "blocked", envelope)))
    early = G.those(G.STAGES, pre, G.stage("OutputValidation", "Blocked", "blocked on input signature pre-scan"))
    return F.when(F.col("stopped"), early).otherwise(full)


def outgoing(objects: DataFrame) -> DataFrame:
    """Objects that a client sends."""
    return objects.withColumn("source", F.lit("outgoing"))


def incoming(objects: DataFrame) -> DataFrame:
    """Objects that a server takes in."""
    return objects.withColumn("source", F.lit("incoming"))


def defend_for_tenants(objects: DataFrame, slots: DataFrame, policies: DataFrame, rules: Sequence[Rule] = (), fallback: str = "standard") -> DataFrame:
    """Every object under the active policy of its tenant, else under the fallback."""
    from .tenants import resolve

    return defend(resolve(objects, slots, fallback), policies, rules, fallback)


def observed(results: DataFrame, name: str = "weir") -> DataFrame:
    """results with metrics that a query listener sees: objects, errors and verdicts."""
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in ("clean", "suspicious", "blocked")]
    return results.observe(name, F.count("*").alias("objects"), F.count_if(F.col("error_kind").isNotNull()).alias("errors"), *counts)


def audit_events(results: DataFrame) -> DataFrame:
    """One event for each completed object: neither errors nor objects stopped by the pre-scan have one."""
    done = results.filter(F.col("error_kind").isNull() & (F.col("parser_used") != "pre_scan_blocked"))
    return done.select("object_id", "tenant_id", "source", "verdict", F.size("alerts").cast("long").alias("alert_count"), F.size("stages").cast("long").alias("stage_count"))


def quarantine(results: DataFrame) -> DataFrame:
    """The envelope of every blocked object."""
    blocked = results.filter(F.col("verdict") == "blocked")
    return blocked.select("object_id", "parser_used", G.first_block_reason(F.col("alerts")).alias("reason"), "sha256", F.col("input_bytes").alias("original_size"), F.col("output_bytes").alias("output_size"), F.transform("stages", lambda s: s["detail"]).alias("stage_details"))
