"""Gates and folds over objects, as column expressions.

Alerts are structs (code, message, severity: 0 info, 1 warning, 2 blocking), stages structs (stage, status, detail), both
in ordered arrays. A gate gives an error kind, an alert, or null; the first error in order decides. `p` is a policy
struct (see plans.policy), so each row may have its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weir.functions import names
from weir.functions.binary import lit_bytes

from .signatures import executable_magic

INFO, WARNING, BLOCKING = 0, 1, 2
ALERT = "struct<code:string,message:string,severity:int>"
STAGE = "struct<stage:string,status:string,detail:string>"
ALERTS, STAGES = f"array<{ALERT}>", f"array<{STAGE}>"


def alert(code: str | Column, message: str | Column, severity: int | Column) -> Column:
    code, message, severity = (x if isinstance(x, Column) else F.lit(x) for x in (code, message, severity))
    return F.struct(code.alias("code"), message.alias("message"), severity.cast("int").alias("severity"))


def stage(name: str, status: str | Column, detail: str | Column) -> Column:
    status, detail = (x if isinstance(x, Column) else F.lit(x) for x in (status, detail))
    return F.struct(F.lit(name).alias("stage"), status.alias("status"), detail.alias("detail"))


def none_of(kind: str) -> Column:
    return F.array().cast(kind)


def those(kind: str, *items: Column) -> Column:
    """The items that aren't null, in order."""
    return F.array_compact(F.array(*items)).cast(kind) if items else none_of(kind)


def worst(alerts: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(alerts, lambda a: a["severity"])), F.lit(INFO))


def status_of(alerts: Column) -> Column:
    w = worst(alerts)
    return F.when(w == BLOCKING, "Blocked").when(w == WARNING, "Warning").otherwise("Success")


def verdict(alerts: Column) -> Column:
    w = worst(alerts)
    return F.when(w == BLOCKING, "blocked").when(w == WARNING, "suspicious").otherwise("clean")


def first_block_reason(alerts: Column) -> Column:
    blocking = F.filter(alerts, lambda a: a["severity"] == BLOCKING)
    return F.when(F.size(blocking) > 0, F.element_at(blocking, 1)["code"]).otherwise("blocked")


def signature_alerts(hits: Column) -> Column:
    return F.transform(hits, lambda h: alert("signature_match", F.concat(F.lit("Matched signature rule: "), h), BLOCKING)).cast(ALERTS)


def too_large(size: Column, p: Column) -> Column:
    return F.when(size > p["max_input_size_bytes"], "FileTooLarge")


def blocked_extension(ext: Column, p: Column) -> Column:
    return F.when(F.array_contains(p["blocked_extensions"], ext), "BlockedExtension")


def kinds_disagree(by_name: Column, by_mime: Column) -> Column:
    return F.coalesce(~names.compatible_kinds(by_name, by_mime), F.lit(False))


def kind_mismatch(by_name: Column, by_mime: Column, p: Column) -> Column:
    return F.when(kinds_disagree(by_name, by_mime) & p["block_kind_mismatch"], "FileTypeMismatch")


def metadata_disagrees(named: Column, sniffed: Column, declared: Column) -> Column:
    """Whether extension's, sniffed and declared type (all normal) disagree; wildcards and types without a slash do so by themselves."""
    no = F.lit(False)
    return F.coalesce(named != sniffed, no) | F.coalesce(declared != sniffed, no) | F.coalesce(declared != named, no) | F.coalesce(~declared.contains("/") | declared.contains("*"), no)


def metadata_mismatch(disagree: Column, p: Column) -> Column:
    return F.when(disagree & p["block_kind_mismatch"], "FileTypeMismatch")


def metadata_alerts(disagree: Column, sniffed: Column, declared: Column) -> Column:
    return those(
        ALERTS,
        F.when(declared.isNotNull() & sniffed.isNull(), alert("declared_mime_unverified", "The declared type can't be confirmed from the bytes.", WARNING)),
        F.when(disagree, alert("input_mime_mismatch", "Name, declared type and content disagree.", WARNING)),
    )


def detect_status(by_name: Column, by_mime: Column, p: Column) -> Column:
    unknown = by_name.isNull() | by_mime.isNull()
    severe = F.when(unknown, p["unknown_kind_mode"] == "Block").otherwise(p["block_kind_mismatch"])
    fine = ~unknown & ~kinds_disagree(by_name, by_mime)
    return F.when(fine, "Success").when(severe, "Blocked").otherwise("Warning")


def unknown_alerts(by_name: Column, by_mime: Column, p: Column) -> Column:
    severity = F.when(p["unknown_kind_mode"] == "Block", BLOCKING).otherwise(WARNING)
    return those(
        ALERTS,
        F.when(by_name.isNull(), alert("unknown_extension", "The extension is unknown.", severity)),
        F.when(by_mime.isNull(), alert("unknown_mime", "The leading bytes are unknown.", severity)),
    )


def allowed_types(kind: Column, p: Column) -> Column:
    lists = p["output_mime_whitelist"]
    group = F.when(kind == "animated_image", "image").otherwise(kind)
    chosen = None
    for k in ("image", "gif", "video", "audio", "other"):
        chosen = F.when(group == k, lists[k]) if chosen is None else chosen.when(group == k, lists[k])
    return F.transform(chosen, names.ascii_lower)


def output_alerts(kind: Column, mime: Column, data: Column, sniffed: Column, p: Column, code: Column | None = None) -> Column:
    """Checks of a rebuilt object: emptiness, executable magic, deny and allow lists, and kinds by type and bytes."""
    declared = names.ascii_lower(mime)
    code = executable_magic(data) if code is None else code
    matching = p["enforce_output_kind_match"]
    declared_kind, sniffed_kind = names.kind_from_mime(declared), names.kind_from_mime(sniffed)
    differ = lambda k: F.coalesce(~names.compatible_kinds(k, kind), F.lit(False))
    checks = those(
        ALERTS,
        F.when(code.isNotNull(), alert(code, F.concat(F.lit("The output begins like "), F.regexp_replace(code, "_in_output$", "")), BLOCKING)),
        F.when(matching & F.array_contains(F.transform(p["output_mime_denylist"], names.ascii_lower), declared), alert("declared_output_mime_denied", F.concat(declared, F.lit(" is denied.")), BLOCKING)),
        F.when(matching & p["enforce_output_mime_whitelist"] & ~F.array_contains(allowed_types(kind, p), declared), alert("declared_output_mime_not_allowed", F.concat(declared, F.lit(" isn't allowed for "), kind), BLOCKING)),
        F.when(matching & differ(declared_kind), alert("declared_mime_kind_mismatch", F.concat(declared_kind, F.lit(" by type, expected "), kind), BLOCKING)),
        F.when(matching & differ(sniffed_kind), alert("sniffed_output_kind_mismatch", F.concat(sniffed_kind, F.lit(" by bytes, expected "), kind), BLOCKING)),
        F.when(matching & sniffed_kind.isNull(), alert("unknown_output_mime", "The output's bytes are unknown.", F.when(p["block_on_unknown_output_mime"], BLOCKING).otherwise(WARNING))),
        F.when(matching & F.coalesce(~names.same_mime(declared, sniffed), F.lit(False)), alert("output_mime_mismatch", "The output's type doesn't fit its bytes.", BLOCKING)),
    )
    return F.when(F.length(data) == 0, those(ALERTS, alert("empty_output_artifact", "The output is empty.", BLOCKING))).otherwise(checks)


ZIP_FAMILY = ("zip", "docx", "xlsx", "pptx", "jar", "apk", "odt")


def structured(ext: Column, data: Column) -> Column:
    """Whether the bytes look like what the extension says, for json, pdf, xml and the zip family; true for others."""
    text = F.try_validate_utf8(data.cast("string"))
    zips = [data.startswith(lit_bytes(x)) for x in (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08")]
    check = (
        F.when(ext == "json", F.when(text.isNotNull(), F.try_parse_json(text).isNotNull()).otherwise(False))
        .when(ext == "pdf", data.startswith(lit_bytes(b"%PDF-")) & F.contains(data, lit_bytes(b"%%EOF")))
        .when(ext == "xml", F.coalesce(F.regexp_replace(text, r"(?U)^\s+", "").startswith("<"), F.lit(False)))
        .when(ext.isin(*ZIP_FAMILY), zips[0] | zips[1] | zips[2])
    )
    return F.coalesce(check, F.lit(True))


def structured_alert(kind: Column, ext: Column, fine: Column, p: Column) -> Column:
    severity = F.when(p["other"]["structured_probe_mode"] == "Block", BLOCKING).otherwise(WARNING)
    return F.when((kind == "other") & ~fine, alert("other_structured_probe_failed", F.concat(F.lit("Not a whole ."), ext), severity))


def structured_stage(name: Column, ext: Column, fine: Column, p: Column) -> Column:
    failed = F.when(p["other"]["structured_probe_mode"] == "Block", "Blocked").otherwise("Warning")
    outcome = F.when(fine, "passed").when(failed == "Blocked", "blocked").otherwise("warning")
    detail = F.when(name.isNull(), "other probe skipped: no file name").when(ext.isNull(), "other probe skipped: no extension").otherwise(F.concat(F.lit("other probe "), outcome, F.lit(" for ."), ext))
    return stage("OtherProbe", F.when(fine, "Success").otherwise(failed), detail)


def output_too_large(size: Column, p: Column) -> Column:
    return F.when(size > p["max_output_size_bytes"], "OutputTooLarge")


def expands_too_much(before: Column, after: Column, p: Column) -> Column:
    ratio = after.cast("double") / F.when(before > 0, before.cast("double"))
    return F.when(ratio > p["max_output_expansion_ratio"], "OutputExpansionTooHigh")


def level_unsupported(kind: Column, p: Column) -> Column:
    return F.when((p["minimum_reconstruction_level"] == "Semantic") & kind.isin("animated_image", "other"), "UnsupportedReconstructionLevel")


def achieved_level(kind: Column, mime: Column, stages: Column) -> Column:
    """Semantic, Structural or null: by type for stills, by what the rebuild reports for audio and video."""
    by_type = names.kind_from_mime(mime)
    reported = F.filter(stages, lambda s: (s["stage"] == "Rebuild") & s["detail"].startswith("achieved_reconstruction="))
    level = F.when(F.size(reported) > 0, F.regexp_extract(F.element_at(reported, 1)["detail"], "=(.*)$", 1))
    return (
        F.when(kind.isin("image", "gif") & (by_type == kind), "Semantic")
        .when((kind == "animated_image") & (by_type == "image"), "Structural")
        .when(kind.isin("audio", "video"), F.when(level == "semantic", "Semantic").when(level == "structural", "Structural"))
    )


def level_met(required: Column, achieved: Column) -> Column:
    return F.coalesce((achieved == "Semantic") | ((achieved == "Structural") & (required == "Structural")), F.lit(False))


def soften(alerts: Column) -> Column:
    """What a dry run makes of alerts."""
    hard = lambda a: a["severity"] == BLOCKING
    return F.transform(alerts, lambda a: alert(a["code"], F.when(hard(a), F.concat(a["message"], F.lit(" [dry-run: would block]"))).otherwise(a["message"]), F.when(hard(a), WARNING).otherwise(a["severity"])))


def soften_stages(stages: Column) -> Column:
    hard = lambda s: s["status"] == "Blocked"
    return F.transform(
        stages,
        lambda s: F.struct(
            s["stage"].alias("stage"),
            F.when(hard(s), "Warning").otherwise(s["status"]).alias("status"),
            F.when(hard(s), F.concat(s["detail"], F.lit(" [dry-run]"))).otherwise(s["detail"]).alias("detail"),
        ),
    )
