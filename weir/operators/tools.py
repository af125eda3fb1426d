"""External media tools: bounded child processes, probes and transcoding. Without a tool everything fails closed."""

from __future__ import annotations

import os
import subprocess
import tempfile
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from weir.functions import names, sniff

from .containers import Malformed

#: Most bytes kept of what a child writes to its standard streams.
KEPT_OUTPUT = 1 << 20
# Encoder, MIME type and file suffix of each output codec.
CODECS = {
    "Mp3": ("libmp3lame", "audio/mpeg", ".mp3"),
    "Aac": ("aac", "audio/aac", ".aac"),
    "Opus": ("libopus", "audio/opus", ".opus"),
    "Flac": ("flac", "audio/flac", ".flac"),
    "Wav": ("pcm_s16le", "audio/wav", ".wav"),
}
_ORIGINAL = {"audio/mpeg": "Mp3", "audio/aac": "Aac", "audio/flac": "Flac", "audio/x-flac": "Flac", "audio/wav": "Wav", "audio/x-wav": "Wav", "audio/ogg": "Opus", "audio/opus": "Opus"}


@dataclass
class Finished:
    ok: bool
    out: bytes
    err: bytes


def run_bounded(command: list[str], seconds: float) -> Finished:
    """Standard streams go to files, so that a child can't block on a pipe; it is killed after `seconds`."""
    with tempfile.TemporaryFile() as out, tempfile.TemporaryFile() as err:
        child = subprocess.Popen(command, stdin=subprocess.DEVNULL, stdout=out, stderr=err)
        try:
            code = child.wait(timeout=seconds)
        except subprocess.TimeoutExpired:
            child.kill()
            child.wait()
            raise
        out.seek(0)
        err.seek(0)
        return Finished(code == 0, out.read(KEPT_OUTPUT), err.read(KEPT_OUTPUT))


def available(tool: str, seconds: float) -> bool:
    try:
        return run_bounded([tool, "-version"], seconds).ok
    except (OSError, subprocess.SubprocessError):
        return False


def parse_probe(text: str) -> dict[str, float | int | None]:
    """key=value lines: the greatest bit rate, the last duration and channel count that are numbers."""
    found: dict[str, Any] = {"duration": None, "bit_rate": None, "channels": None}
    for line in text.splitlines():
        key, _, value = line.strip().partition("=")
        try:
            if key == "bit_rate":
                found[key] = max(found[key] or 0, int(value))
            elif key == "channels":
                found[key] = int(value)
            elif key == "duration":
                number = float(value)
                found[key] = number if number == number and number >= 0 else found[key]
        except ValueError:
            continue
    if all(v is None for v in found.values()):
        raise ValueError("the probe gave no usable figure")
    return found


def probe(tool: str, path: str, seconds: float) -> dict[str, float | int | None]:
    done = run_bounded([tool, "-v", "error", "-show_entries", "format=duration,bit_rate:stream=bit_rate,channels", "-of", "default=noprint_wrappers=1", path], seconds)
    if not done.ok:
        raise ValueError("the probe failed")
    return parse_probe(done.out.decode("utf-8", "replace"))


def plan_of(policy: Mapping[str, Any], mime: str | None) -> tuple[tuple[str, str, str], bool | None]:
    """Encoder, type and suffix; and whether the original codec is kept, None where that wasn't asked for."""
    codec = policy["output_codec"]
    if codec != "KeepOriginalWhenPossible" or policy["mode"] == "RequireFfmpeg":
        return CODECS[codec if codec in CODECS else "Mp3"], None
    original = _ORIGINAL.get(mime or "")
    return CODECS[original or "Mp3"], original is not None


@dataclass
class Job:
    """One object on its way through the tools."""

    kind: str
    data: bytes
    mime: str | None
    policy: Mapping[str, Any]
    encoder: str
    out_mime: str
    suffix: str
    kept: bool | None
    made: bytes = b""

    @property
    def error(self) -> str:
        return self.kind.capitalize()

    @property
    def sniffed(self) -> str | None:
        return sniff.mime_of(self.made)


def _job(kind: str, data: bytes, mime: str | None, policy: Mapping[str, Any]) -> Job:
    if kind == "video":
        return Job(kind, data, mime, policy, "libx264", "video/mp4", ".mp4", None)
    (encoder, out_mime, suffix), kept = plan_of(policy, mime)
    return Job(kind, data, mime, policy, encoder, out_mime, suffix, kept)


#: What of a source goes into the output, by kind.
_MAPPED = {
    "audio": lambda job: ["-map", "0:a:0", "-map_metadata", "-1", "-map_chapters", "-1", "-vn", "-sn", "-dn", "-threads", "2", "-c:a", job.encoder],
    "video": lambda job: ["-map", "0:v:0", "-map", "0:a:0?", "-map_metadata", "-1", "-map_chapters", "-1", "-sn", "-dn", "-threads", "2", "-c:v", job.encoder, "-c:a", "aac", "-movflags", "+faststart"],
}
#: Figures of the probe and the limit of each, by kind.
_LIMITS = {
    "audio": (("duration", "max_duration_secs", 1), ("bit_rate", "max_bitrate_kbps", 1000), ("channels", "max_channels", 1)),
    "video": (("duration", "max_duration_secs", 1), ("bit_rate", "max_bitrate_kbps", 1000)),
}


def _is_program(job: Job) -> bool:
    from .signatures import EXECUTABLE_MAGIC

    return any(job.made.startswith(m) for m, _ in EXECUTABLE_MAGIC)


def _is_other_sound(job: Job, than: str | None) -> bool:
    return bool(job.sniffed and than) and names.canonical_audio_of(job.sniffed) != names.canonical_audio_of(than)


#: What is wrong with an encoder's output, in this order, by kind: test, code, message.
_CHECKS: dict[str, tuple[tuple[Callable[[Job], bool], str, str], ...]] = {
    "audio": (
        (lambda job: not job.made, "ffmpeg_empty_output_audio", "the encoder gave no output"),
        (_is_program, "ffmpeg_executable_magic_audio", "the encoder's output begins like a program"),
        (lambda job: job.sniffed is not None and job.sniffed not in names.AUDIO_TYPES, "ffmpeg_non_audio_mime_audio", "the encoder's output isn't sound"),
        (lambda job: _is_other_sound(job, job.out_mime), "ffmpeg_audio_mime_mismatch", "the encoder's output isn't of the planned type"),
        (lambda job: bool(job.kept) and _is_other_sound(job, job.mime), "audio_keep_original_mime_mismatch", "the encoder's output isn't of the original type"),
    ),
    "video": (
        (lambda job: not job.made, "ffmpeg_empty_output", "the encoder gave no output"),
        (_is_program, "ffmpeg_executable_magic_video", "the encoder's output begins like a program"),
        (lambda job: job.made[4:8] != b"ftyp", "ffmpeg_invalid_container_video", "the encoder's output is no MP4"),
    ),
}
_FAILED = {"audio": "ffmpeg_failed_audio", "video": "ffmpeg_failed"}


def _probed(job: Job, source: str, seconds: float) -> tuple[list[tuple[str, str, int]], list[tuple[str, str, str]]]:
    """Alerts and stages of the probe; raises Malformed beyond a limit."""
    label = f"{job.error}Probe"
    try:
        found = probe(job.policy["ffprobe_bin"], source, seconds)
    except (OSError, ValueError, subprocess.SubprocessError):
        if job.policy["probe_failure_mode"] == "Block":
            raise Malformed(job.error, f"{job.kind} probe failed") from None
        return [(f"{job.kind}_ffprobe_failed", "The metadata probe failed.", 1)], [(label, "Warning", f"{job.kind} probe warning")]
    for figure, limit, unit in _LIMITS[job.kind]:
        value, most = found[figure], job.policy[limit] * unit
        if value is not None and value > most:
            raise Malformed(job.error, f"{job.kind} {figure} is above the limit: {value} > {most}")
    return [], [(label, "Success", f"{job.kind} probe succeeded")]


def _encoded(job: Job, source: str, target: str, seconds: float) -> tuple[str, str] | None:
    """Runs the encoder and keeps what it made; the code and message of what went wrong."""
    try:
        done = run_bounded([job.policy["ffmpeg_bin"], "-y", "-nostdin", "-v", "error", "-protocol_whitelist", "file,pipe", "-threads", "2", "-i", source, *_MAPPED[job.kind](job), target], seconds)
    except (OSError, subprocess.SubprocessError) as e:
        return f"ffmpeg_execution_failed_{job.kind}", f"the encoder can't be run: {type(e).__name__}"
    if not done.ok:
        return _FAILED[job.kind], "the encoder failed"
    if os.path.exists(target):
        with open(target, "rb") as f:
            job.made = f.read()
    return next(((code, message) for wrong, code, message in _CHECKS[job.kind] if wrong(job)), None)


def transcode(kind: str, data: bytes, mime: str | None, policy: Mapping[str, Any], strict: bool) -> dict[str, Any]:
    """A rebuilt object by the external encoder: mime, output, alerts, stages.

    What goes wrong raises Malformed if strict, else the object comes out as it is, with a warning, as raw data.
    """
    job = _job(kind, data, mime, policy)
    if not data:
        raise Malformed(job.error, f"{kind} input is empty")
    seconds = float(policy["ffmpeg_timeout_secs"])
    with tempfile.TemporaryDirectory() as folder:
        source, target = os.path.join(folder, "input"), os.path.join(folder, f"output{job.suffix}")
        with open(source, "wb") as f:
            f.write(data)
        alerts, stages = _probed(job, source, seconds)
        if job.kept is False:
            if policy["keep_original_mode"] == "Block":
                return {"mime": "audio/blocked", "output": b"", "alerts": [("audio_keep_original_blocked", "The original codec can't be kept.", 2)], "stages": stages}
            alerts.append(("audio_keep_original_fallback", "The original codec can't be kept; MP3 takes its place.", 1))
        wrong = _encoded(job, source, target, seconds)
    if wrong is None:
        return {"mime": job.out_mime, "output": job.made, "alerts": alerts, "stages": [*stages, ("Rebuild", "Success", "achieved_reconstruction=semantic")]}
    if strict:
        raise Malformed(job.error, wrong[1])
    return {"mime": f"{kind}/raw", "output": data, "alerts": [*alerts, (*wrong, 1)], "stages": stages}


def verify_video(data: bytes, policy: Mapping[str, Any]) -> str:
    """A whole decode by the external tool; raises ValueError if that isn't possible."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "input")
        with open(path, "wb") as f:
            f.write(data)
        try:
            done = run_bounded([policy["ffmpeg_bin"], "-nostdin", "-v", "error", "-xerror", "-protocol_whitelist", "file,pipe", "-i", path, "-f", "null", "-"], float(policy["ffmpeg_timeout_secs"]))
        except (OSError, subprocess.SubprocessError):
            raise ValueError("no video reader is available") from None
    if not done.ok or done.err.strip():
        raise ValueError("the video can't be decoded whole")
    return "video decoded completely"
