"""Policies: profiles, versioned documents and their canonical JSON; a table has one row for each policy."""

from __future__ import annotations

import json
from collections.abc import Mapping
from copy import deepcopy
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIB = 1024 * 1024

# Extensions that no profile lets in.
BLOCKED_EXTENSIONS = ("exe dll js bat cmd msi scr vbs vbe ps1 psc1 jar apk com pif hta cpl wsf wsh reg inf lnk py rb sh php class dex wasm").split()
ARCHIVE_EXTENSIONS = "zip rar 7z tar gz bz2 iso cab dmg".split()
# Output types that strict and paranoid profiles deny.
DENIED_TYPES = [
    "application/x-msdownload",
    "application/x-dosexec",
    "application/java-archive",
    "application/x-sh",
    "application/javascript",
    "text/javascript",
    "application/x-mach-binary",
    "application/x-elf",
]
PROFILE_ALIASES = {"dissertation": "strict", "enterprise": "strict", "staging": "standard", "public": "standard", "default": "standard", "high_risk": "paranoid"}

SCHEMA = """
minimum_reconstruction_level string, max_handler_duration_ms long, max_input_size_bytes long, max_output_size_bytes long,
max_output_expansion_ratio double, enforce_output_kind_match boolean, block_on_unknown_output_mime boolean,
enforce_output_mime_whitelist boolean,
output_mime_whitelist struct<image:array<string>,gif:array<string>,video:array<string>,audio:array<string>,other:array<string>>,
output_mime_denylist array<string>, enforcement_mode string, block_kind_mismatch boolean, unknown_kind_mode string,
decoder_failure_mode string, signature_scan_mode string, block_on_pre_scan_match boolean, blocked_extensions array<string>,
signature_rules array<struct<name:string,pattern:binary,location:string,limit:long>>,
image struct<output_format:string,max_pixels:long,probe_failure_mode:string>,
animated_image struct<max_chunks:long,max_chunk_size:long,max_frames:long,max_pixels_per_frame:long,max_side:long,max_total_pixels:long>,
gif struct<max_frames:long,max_pixels_per_frame:long,probe_failure_mode:string>,
video struct<mode:string,ffmpeg_bin:string,ffprobe_bin:string,ffmpeg_timeout_secs:long,max_duration_secs:long,max_bitrate_kbps:long,probe_failure_mode:string>,
audio struct<mode:string,ffmpeg_bin:string,ffprobe_bin:string,ffmpeg_timeout_secs:long,max_duration_secs:long,max_bitrate_kbps:long,max_channels:long,output_codec:string,keep_original_mode:string,probe_failure_mode:string>,
other struct<max_entropy:double,structured_probe_mode:string>
"""

STANDARD: dict[str, Any] = {
    "minimum_reconstruction_level": "Structural",
    "max_handler_duration_ms": 10_000,
    "max_input_size_bytes": 200 * MIB,
    "max_output_size_bytes": 250 * MIB,
    "max_output_expansion_ratio": 12.0,
    "enforce_output_kind_match": True,
    "block_on_unknown_output_mime": False,
    "enforce_output_mime_whitelist": True,
    "output_mime_whitelist": {
        "image": ["image/png", "image/jpeg", "image/webp"],
        "gif": ["image/gif"],
        "video": ["video/mp4", "video/raw"],
        "audio": ["audio/mpeg", "audio/aac", "audio/opus", "audio/flac", "audio/wav", "audio/raw"],
        "other": ["application/octet-stream"],
    },
    "output_mime_denylist": [],
    "enforcement_mode": "Enforce",
    "block_kind_mismatch": True,
    "unknown_kind_mode": "Warn",
    "decoder_failure_mode": "QuarantineAsOther",
    "signature_scan_mode": "InputAndOutput",
    "block_on_pre_scan_match": True,
    "blocked_extensions": list(BLOCKED_EXTENSIONS),
    "signature_rules": [],
    "image": {"output_format": "Png", "max_pixels": 30_000_000, "probe_failure_mode": "Warn"},
    "animated_image": {"max_chunks": 4096, "max_chunk_size": 8 * MIB, "max_frames": 300, "max_pixels_per_frame": 8_000_000, "max_side": 16384, "max_total_pixels": 200_000_000},
    "gif": {"max_frames": 500, "max_pixels_per_frame": 16_000_000, "probe_failure_mode": "Warn"},
    "video": {"mode": "BlockWhenUnavailable", "ffmpeg_bin": "ffmpeg", "ffprobe_bin": "ffprobe", "ffmpeg_timeout_secs": 25, "max_duration_secs": 3600, "max_bitrate_kbps": 20000, "probe_failure_mode": "Warn"},
    "audio": {
        "mode": "BlockWhenUnavailable",
        "ffmpeg_bin": "ffmpeg",
        "ffprobe_bin": "ffprobe",
        "ffmpeg_timeout_secs": 20,
        "max_duration_secs": 3600,
        "max_bitrate_kbps": 1536,
        "max_channels": 6,
        "output_codec": "Mp3",
        "keep_original_mode": "FallbackToMp3",
        "probe_failure_mode": "Warn",
    },
    "other": {"max_entropy": 7.98, "structured_probe_mode": "Warn"},
}

_STRICT: dict[str, Any] = {
    "minimum_reconstruction_level": "Semantic",
    "max_handler_duration_ms": 8000,
    "max_input_size_bytes": 100 * MIB,
    "max_output_size_bytes": 120 * MIB,
    "max_output_expansion_ratio": 8.0,
    "block_on_unknown_output_mime": True,
    "output_mime_whitelist": {"image": ["image/png", "image/jpeg"], "video": ["video/mp4"], "audio": ["audio/mpeg", "audio/aac", "audio/opus", "audio/flac", "audio/wav"]},
    "output_mime_denylist": DENIED_TYPES,
    "unknown_kind_mode": "Block",
    "decoder_failure_mode": "Block",
    "image": {"probe_failure_mode": "Block"},
    "animated_image": {"max_chunks": 2048, "max_chunk_size": 4 * MIB, "max_frames": 200, "max_pixels_per_frame": 4_000_000, "max_side": 8192, "max_total_pixels": 100_000_000},
    "gif": {"probe_failure_mode": "Block"},
    "video": {"mode": "RequireFfmpeg", "ffmpeg_timeout_secs": 20, "max_duration_secs": 1800, "max_bitrate_kbps": 15000, "probe_failure_mode": "Block"},
    "audio": {"mode": "RequireFfmpeg", "ffmpeg_timeout_secs": 15, "max_duration_secs": 1200, "max_bitrate_kbps": 1024, "max_channels": 2, "keep_original_mode": "Block", "probe_failure_mode": "Block"},
    "other": {"max_entropy": 7.7, "structured_probe_mode": "Block"},
}

_PARANOID: dict[str, Any] = {
    "max_handler_duration_ms": 5000,
    "max_input_size_bytes": 50 * MIB,
    "max_output_size_bytes": 60 * MIB,
    "max_output_expansion_ratio": 4.0,
    "output_mime_whitelist": {"image": ["image/png"], "audio": ["audio/mpeg", "audio/flac"]},
    "blocked_extensions": BLOCKED_EXTENSIONS + ARCHIVE_EXTENSIONS,
    "image": {"max_pixels": 20_000_000},
    "animated_image": {"max_chunks": 1024, "max_chunk_size": 2 * MIB, "max_frames": 100, "max_pixels_per_frame": 2_000_000, "max_side": 4096, "max_total_pixels": 40_000_000},
    "gif": {"max_frames": 200, "max_pixels_per_frame": 8_000_000},
    "video": {"ffmpeg_timeout_secs": 12, "max_duration_secs": 900, "max_bitrate_kbps": 8000},
    "audio": {"ffmpeg_timeout_secs": 10, "max_duration_secs": 600, "max_bitrate_kbps": 512},
    "other": {"max_entropy": 7.4},
}


def merged(base: Mapping[str, Any], changes: Mapping[str, Any]) -> dict[str, Any]:
    """base with changes laid over it, field by field."""
    out = deepcopy(dict(base))
    for key, value in changes.items():
        out[key] = merged(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else deepcopy(value)
    return out


STRICT = merged(STANDARD, _STRICT)
PARANOID = merged(STRICT, _PARANOID)
PROFILES = {"standard": STANDARD, "strict": STRICT, "paranoid": PARANOID}


def profile(name: str, **changes: Any) -> dict[str, Any]:
    return merged(PROFILES[PROFILE_ALIASES.get(name, name)], changes)


def dry_run(policy: Mapping[str, Any]) -> dict[str, Any]:
    return merged(policy, {"enforcement_mode": "DryRun"})


def _row(policy: Mapping[str, Any]) -> dict[str, Any]:
    out = deepcopy(dict(policy))
    for rule in out["signature_rules"]:
        rule["pattern"] = bytearray(rule["pattern"])
        rule.setdefault("limit", None)
    return out


def policy_table(spark: SparkSession, policies: Mapping[str, Mapping[str, Any]] | None = None) -> DataFrame:
    """policy_id and all fields; the profiles by default."""
    rows = [{"policy_id": k, **_row(p)} for k, p in (policies or PROFILES).items()]
    return spark.createDataFrame(rows, f"policy_id string, {SCHEMA}")


def canonical_policy(policy: Mapping[str, Any] | None) -> Any:
    """The policy as it is signed: fields in schema order, patterns in hex."""
    if policy is None:
        return None
    out = {key: policy[key] for key in STANDARD}
    out["signature_rules"] = [
        {"name": r["name"], "pattern_hex": bytes(r["pattern"]).hex(), "location": "Anywhere" if r["location"] == "Anywhere" else {r["location"]: r["limit"]}} for r in policy["signature_rules"]
    ]
    return out


def canonical_json(value: Any) -> str:
    """Compact JSON with keys in the given order and nulls kept."""
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


DOCUMENT = "version string, config struct<profile:string,max_input_size_bytes:long,max_output_size_bytes:long,max_output_expansion_ratio:double,blocked_extensions:array<string>>"


def policy_documents(texts: DataFrame, column: str = "document") -> DataFrame:
    """Versioned policy documents parsed and checked: config, valid, problem (the first rule that fails)."""
    parsed = texts.withColumn("parsed", F.from_json(column, DOCUMENT))
    c = F.col("parsed.config")
    problem = (
        F.when(F.col("parsed").isNull() | ~F.col("parsed.version").eqNullSafe("v1") | c.isNull(), "unknown document version")
        .when(F.greatest(c["profile"].isNull(), c["max_input_size_bytes"].isNull(), c["max_output_size_bytes"].isNull(), c["max_output_expansion_ratio"].isNull(), c["blocked_extensions"].isNull()), "missing field")
        .when(c["max_input_size_bytes"] <= 0, "max_input_size_bytes must be > 0")
        .when(c["max_output_size_bytes"] <= 0, "max_output_size_bytes must be > 0")
        .when(c["max_output_expansion_ratio"] <= 0, "max_output_expansion_ratio must be > 0")
        .when(c["profile"] == "", "profile cannot be empty")
    )
    return parsed.withColumn("config", c).withColumn("problem", problem).withColumn("valid", F.col("problem").isNull()).drop("parsed")
