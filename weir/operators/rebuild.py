"""Rebuilding objects and reading the result again, row by row in Arrow batches.

One function holds all formats; a row's failure is its own: errors come back as values, never as a failed task. Rows that
are decided before get a null payload and cost nothing here.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from weir.functions.binary import _entropy

from . import tools
from .codecs import Undecodable, bmp, flac, gif, jpeg, png, tiff
from .containers import Cleaned, Malformed, apng, audio, video
from .signatures import BASELINE

# The shortest frame delay and the longest animation, in hundredths of a second.
LEAST_DELAY, MOST_DELAY = 2, 6000
#: Signatures that count wherever they stand, and the levels of compression that are tried until a PNG holds none of them.
ANYWHERE, LEVELS = tuple(r.pattern for r in BASELINE if r.location == "Anywhere"), (6, 9, 4, 1)


def _still(data: bytes, check: Callable[[], None] = lambda: None) -> tuple[Callable[[bytes], np.ndarray], tuple[int, int]]:
    if data[:3] == b"\xff\xd8\xff":
        return lambda d: jpeg.decode(d, check), jpeg.dimensions(data)
    for module in (png, bmp, tiff):
        try:
            return module.decode, module.dimensions(data)
        except Undecodable:
            continue
    if data[:6] in (b"GIF87a", b"GIF89a"):
        def first(d: bytes) -> np.ndarray:
            w, h = gif.dimensions(d)
            shot = gif.frames(d, 1 << 16, 1 << 31)[0]
            canvas = np.zeros((h, w, 4), np.uint8)
            canvas[shot.top : shot.top + shot.rgba.shape[0], shot.left : shot.left + shot.rgba.shape[1]] = shot.rgba
            return canvas

        return first, gif.dimensions(data)
    raise Undecodable("no decoder for this pixel format")


class Clock:
    """The time that one object may take (null or 0: any); `check` is called wherever a handler may have worked for long."""

    def __init__(self, milliseconds: int | None):
        self.end = time.monotonic() + milliseconds / 1000 if milliseconds else None

    def check(self) -> None:
        if self.end is not None and time.monotonic() > self.end:
            raise Malformed("Timeout", "the time for one object is over")

    def left(self, seconds: float) -> float:
        """The seconds that a child process may take: so many, but no more than are left."""
        return seconds if self.end is None else max(0.001, min(seconds, self.end - time.monotonic()))


def _png(pixels: np.ndarray) -> bytes:
    """The pixels as PNG. One in 65,536 checksums ends in PE before the zeros of IEND, which reads as a signature; another level has another checksum."""
    first = None
    for level in LEVELS:
        output = png.encode(pixels, level)
        first = first or output
        if not any(pattern in output for pattern in ANYWHERE):
            return output
    return first


def image(data: bytes, p: Mapping[str, Any], clock: Clock) -> dict[str, Any]:
    most = p["image"]["max_pixels"]
    try:
        decode, (width, height) = _still(data, clock.check)
        if not width or not height or width * height > most:
            raise Malformed("Io", f"{width} x {height} pixels")
        clock.check()
        pixels = decode(data)
        clock.check()
    except Undecodable as e:
        raise Malformed("Image", str(e)) from None
    encoders = {"Png": ("image/png", _png), "Jpeg": ("image/jpeg", jpeg.encode)}
    if p["image"]["output_format"] not in encoders:
        raise Malformed("Image", "only PNG and JPEG can be encoded here")
    mime, encode = encoders[p["image"]["output_format"]]
    try:
        output = encode(pixels)
    except Undecodable as e:
        raise Malformed("Image", str(e)) from None
    h, w = pixels.shape[:2]
    note = f"Rebuilt as {mime} from {w} x {h} decoded pixels without any metadata."
    return {"mime": mime, "output": output, "alerts": [("image_metadata_stripped", note, 0)], "stages": [("ImageProbe", "Success", f"image probe succeeded width={width} height={height}")]}


def animation(data: bytes, p: Mapping[str, Any], clock: Clock) -> dict[str, Any]:
    limits = p["gif"]
    try:
        width, height = gif.dimensions(data)
        shots = gif.frames(data, limits["max_frames"], limits["max_pixels_per_frame"], clock.check)
    except Undecodable as e:
        raise Malformed("Gif", str(e)) from None
    if not shots:
        raise Malformed("Gif", "no frames")
    alerts = [("gif_metadata_stripped", f"Rebuilt from {len(shots)} frames without comments and application data.", 0)]
    short = sum(s.delay < LEAST_DELAY for s in shots)
    for s in shots:
        s.delay = max(s.delay, LEAST_DELAY)
    if short:
        alerts.append(("gif_delay_clamped", f"{short} frames were shown for less than {LEAST_DELAY} cs.", 1))
    total = sum(s.delay for s in shots)
    if total > MOST_DELAY:
        alerts.append(("gif_excessive_duration", f"{total} cs are more than {MOST_DELAY}.", 1))
    return {"mime": "image/gif", "output": gif.encode(width, height, shots), "alerts": alerts, "stages": [("GifProbe", "Success", "gif probe succeeded")]}


def _cleaned(c: Cleaned, code: str, what: str, probe: str, extra: list[tuple[str, str, str]], always: bool = False) -> dict[str, Any]:
    alerts = [(code, f"{what}: {c.stripped} parts, {c.stripped_bytes} bytes of metadata removed.", 0)] if c.stripped or (always and c.stripped_bytes) else []
    return {"mime": c.mime, "output": c.data, "alerts": alerts, "stages": [(probe, "Success", f"{what}: stripped={c.stripped or c.stripped_bytes}"), *extra], "stripped": c.stripped, "stripped_bytes": c.stripped_bytes}


_STRUCTURAL = [("Rebuild", "Success", "achieved_reconstruction=structural")]


def native_audio(data: bytes) -> dict[str, Any] | None:
    """The first walker that knows the format decides, also by failing."""
    if (c := audio.ogg(data)) is not None:
        return _cleaned(c, "audio_ogg_metadata_stripped", f"ogg/{c.note} remux", "AudioProbe", _STRUCTURAL, True)
    if (c := video.mp4(data)) is not None:
        c.mime = "audio/mp4"
        return _cleaned(c, "audio_mp4_metadata_stripped", "mp4 remux", "AudioProbe", _STRUCTURAL)
    for walker in (audio.mp3, audio.wav, audio.flac):
        if (c := walker(data)) is not None:
            return _cleaned(c, "audio_metadata_stripped", f"{c.mime} remux", "AudioProbe", _STRUCTURAL)
    return None


def native_video(data: bytes) -> dict[str, Any] | None:
    for walker, code in ((video.mp4, "video_mp4_metadata_stripped"), (video.webm, "video_webm_metadata_stripped")):
        if (c := walker(data)) is not None:
            return _cleaned(c, code, f"{c.mime} remux", "VideoProbe", _STRUCTURAL)
    return None


def sound_or_film(kind: str, data: bytes, mime: str | None, p: Mapping[str, Any], clock: Clock) -> dict[str, Any]:
    policy = dict(p[kind])
    policy["ffmpeg_timeout_secs"] = clock.left(float(policy["ffmpeg_timeout_secs"]))
    if p["minimum_reconstruction_level"] == "Semantic":
        policy["mode"] = "RequireFfmpeg"
    if policy["mode"] == "RequireFfmpeg":
        return tools.transcode(kind, data, mime, policy, True)
    native = (native_audio if kind == "audio" else native_video)(data)
    if native is not None:
        return native
    if policy["mode"] == "BypassWhenUnavailable":
        return tools.transcode(kind, data, mime, policy, False)
    if tools.available(policy["ffmpeg_bin"], policy["ffmpeg_timeout_secs"]):
        return tools.transcode(kind, data, mime, policy, True)
    alert = ("ffmpeg_missing", f"No encoder is installed and the {kind} policy blocks without one.", 2)
    return {"mime": f"{kind}/blocked", "output": b"", "alerts": [alert], "stages": [(f"{kind.capitalize()}Probe", "Blocked", f"{kind} probe blocked without an encoder")]}


def generic(data: bytes) -> dict[str, Any]:
    """Bytes that are no media aren't rebuilt and never released."""
    e = f"{_entropy(data):.3f}"
    return {
        "mime": "application/octet-stream",
        "output": data,
        "alerts": [("unsupported_file_kind", f"Not a supported kind of media. Entropy: {e}.", 2)],
        "stages": [("OtherProbe", "Blocked", f"generic handler blocked: entropy={e}")],
    }


def read_image(data: bytes, p: Mapping[str, Any], clock: Clock) -> str:
    decode, (width, height) = _still(data, clock.check)
    _budget(width, height, p["image"]["max_pixels"])
    if decode(data).shape[:2] != (height, width):
        raise ValueError("dimensions changed during decoding")
    return f"image decoded completely, {width}x{height}"


def _budget(width: int, height: int, most: int) -> None:
    if not 0 < width * height <= most:
        raise ValueError(f"dimensions are outside the pixel budget: {width}x{height}")


def read_animation(kind: str, data: bytes, p: Mapping[str, Any], clock: Clock) -> str:
    if kind == "gif":
        limits = p["gif"]
        width, height = gif.dimensions(data)
        _budget(width, height, limits["max_pixels_per_frame"])
        count = len(gif.frames(data, limits["max_frames"], limits["max_pixels_per_frame"], clock.check))
        most = limits["max_frames"] * limits["max_pixels_per_frame"]
    else:
        limits = p["animated_image"]
        width, height = png.dimensions(data)
        _budget(width, height, limits["max_pixels_per_frame"])
        count, most = len(png.decode_frames(data)), limits["max_total_pixels"]
        if count > limits["max_frames"]:
            raise ValueError("more frames than allowed")
    if not count:
        raise ValueError("no readable frames")
    if count * width * height > most:
        raise ValueError("all frames together have too many pixels")
    return f"all {count} animation frames decoded"


def read_flac(data: bytes, p: Mapping[str, Any], clock: Clock) -> str:
    s, samples = flac.stream(data), 0
    if s.channels > p["audio"]["max_channels"]:
        raise ValueError("too many audio channels")
    for part in flac.frames(data):
        clock.check()
        samples += part.shape[1]
        if samples > s.rate * p["audio"]["max_duration_secs"]:
            raise ValueError("audio is too long")
    if not samples:
        raise ValueError("no decoded audio samples")
    return f"all audio read, {samples} sample frames"


def read_audio(data: bytes, p: Mapping[str, Any], clock: Clock) -> str:
    """PCM WAV and FLAC are read to their last sample; there is no decoder here for other formats, so they fail closed."""
    if data[:4] == b"fLaC":
        return read_flac(data, p, clock)
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no reader for this audio format")
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > len(data):
            raise ValueError("PCM payload is truncated")
        if name == b"fmt ":
            form = data[at + 8 : at + 8 + size]
        elif name == b"data":
            body = size
        at += 8 + size + (size & 1)
    if form is None or body is None or len(form) < 16:
        raise ValueError("WAV without format or data")
    code, channels, rate, _, align, bits = (int.from_bytes(form[a:z], "little") for a, z in ((0, 2), (2, 4), (4, 8), (8, 12), (12, 14), (14, 16)))
    if code not in (1, 3, 0xFFFE) or not channels or not rate or align != channels * ((bits + 7) // 8) or not align:
        raise ValueError("WAV format isn't plain PCM")
    samples = body // align
    if channels > p["audio"]["max_channels"]:
        raise ValueError("too many audio channels")
    if samples > rate * p["audio"]["max_duration_secs"]:
        raise ValueError("audio is too long")
    if not samples:
        raise ValueError("no decoded audio samples")
    return f"all audio read, {samples} sample frames"


def read_again(kind: str, data: bytes, p: Mapping[str, Any], clock: Clock) -> tuple[bool, str]:
    """Whether the rebuilt bytes can be read whole in the time that is left, and how that went."""
    try:
        clock.check()
        if kind == "image":
            return True, read_image(data, p, clock)
        if kind in ("gif", "animated_image"):
            return True, read_animation(kind, data, p, clock)
        if kind == "audio":
            return True, read_audio(data, p, clock)
        if kind == "video":
            return True, tools.verify_video(data, {**p["video"], "ffmpeg_timeout_secs": clock.left(float(p["video"]["ffmpeg_timeout_secs"]))})
        raise ValueError("no reader for this kind of object")
    except ValueError as e:
        return False, str(e)
    except Exception as e:  # noqa: BLE001  whatever a reader trips over counts as unreadable
        return False, f"reader failed: {type(e).__name__}"


def remuxed_animation(data: bytes, p: Mapping[str, Any], clock: Clock) -> dict[str, Any]:
    c = apng.apng(data, p["animated_image"], clock.check)
    return _cleaned(c, "apng_metadata_stripped", f"animation remux frames={c.note}", "ImageProbe", [])


#: The handler of each kind of object: bytes, sniffed type, policy and clock in; mime, output, alerts and stages out.
Handler = Callable[[bytes, "str | None", Mapping[str, Any], Clock], dict[str, Any]]
HANDLERS: dict[str, Handler] = {
    "image": lambda data, mime, p, clock: image(data, p, clock),
    "gif": lambda data, mime, p, clock: animation(data, p, clock),
    "animated_image": lambda data, mime, p, clock: remuxed_animation(data, p, clock),
    "audio": lambda data, mime, p, clock: sound_or_film("audio", data, mime, p, clock),
    "video": lambda data, mime, p, clock: sound_or_film("video", data, mime, p, clock),
    "other": lambda data, mime, p, clock: generic(data),
}


def one(data: bytes | None, kind: str | None, mime: str | None, p: Mapping[str, Any] | None) -> dict[str, Any] | None:
    """A row's result; None for a row that is decided already."""
    if data is None or kind is None or p is None:
        return None
    began, clock = time.monotonic(), Clock(p["max_handler_duration_ms"])
    try:
        made = HANDLERS.get(kind, HANDLERS["other"])(data, mime, p, clock)
        clock.check()
    except Malformed as e:
        made = {"error_kind": e.kind, "error_message": str(e)}
    except Exception as e:  # noqa: BLE001  hostile bytes must not fail the task
        made = {"error_kind": "HandlerPanic", "error_message": type(e).__name__}
    if "error_kind" in made and p["decoder_failure_mode"] == "QuarantineAsOther":
        failed = kind
        made = generic(data)
        made["alerts"].append(("decoder_failure_quarantine", f"The {failed} decoder failed; taken as plain bytes.", 2))
    if "output" in made:
        made["read_ok"], made["read_detail"] = read_again(kind, made["output"], p, clock)
    made["alerts"] = [dict(zip(("code", "message", "severity"), a)) for a in made.get("alerts", [])]
    made["stages"] = [dict(zip(("stage", "status", "detail"), s)) for s in made.get("stages", [])]
    made["elapsed_ms"] = int((time.monotonic() - began) * 1000)
    return made


_ALERT = pa.struct([("code", pa.string()), ("message", pa.string()), ("severity", pa.int32())])
_STAGE = pa.struct([("stage", pa.string()), ("status", pa.string()), ("detail", pa.string())])
_TYPE = pa.struct(
    [
        ("error_kind", pa.string()),
        ("error_message", pa.string()),
        ("mime", pa.string()),
        ("output", pa.binary()),
        ("alerts", pa.list_(_ALERT)),
        ("stages", pa.list_(_STAGE)),
        ("read_ok", pa.bool_()),
        ("read_detail", pa.string()),
        ("stripped", pa.int64()),
        ("stripped_bytes", pa.int64()),
        ("elapsed_ms", pa.int64()),
    ]
)


@F.arrow_udf(from_arrow_type(_TYPE))
def rebuilt(data: pa.Array, kind: pa.Array, mime: pa.Array, policy: pa.Array) -> pa.Array:
    """The policy comes as JSON, so that a batch parses each distinct one once."""
    parsed: dict[str, Any] = {}
    out = []
    for d, k, m, text in zip(data, kind.to_pylist(), mime.to_pylist(), policy.to_pylist()):
        if text is not None and text not in parsed:
            parsed[text] = json.loads(text)
        out.append(one(d.as_py(), k, m, parsed.get(text)))
    return pa.array(out, _TYPE)


def policy_json(p: Column) -> Column:
    """The fields that the rebuild looks at."""
    fields = ("minimum_reconstruction_level", "max_handler_duration_ms", "decoder_failure_mode", "image", "animated_image", "gif", "video", "audio")
    return F.to_json(F.struct(*[p[f].alias(f) for f in fields]))


_STRIPPED = pa.struct([("output", pa.binary()), ("mime", pa.string()), ("stripped", pa.int64()), ("stripped_bytes", pa.int64()), ("error", pa.string())])


def _walker(walk: Callable[[bytes], Cleaned | None]):
    def run(data: pa.Array) -> pa.Array:
        out = []
        for d in data:
            raw = d.as_py()
            try:
                c = None if raw is None else walk(raw)
                out.append(None if c is None else {"output": c.data, "mime": c.mime, "stripped": c.stripped, "stripped_bytes": c.stripped_bytes, "error": None})
            except Malformed as e:
                out.append({"output": None, "mime": None, "stripped": 0, "stripped_bytes": 0, "error": e.kind})
        return pa.array(out, _STRIPPED)

    run.__annotations__ = {"data": pa.Array, "return": pa.Array}
    return F.arrow_udf(from_arrow_type(_STRIPPED))(run)


#: One function for each walker: binary column to struct (output, mime, stripped, stripped_bytes, error); null if it isn't the format.
STRIP = {name: _walker(walk) for name, walk in (("mp3", audio.mp3), ("wav", audio.wav), ("flac", audio.flac), ("ogg", audio.ogg), ("mp4", video.mp4), ("webm", video.webm))}


def strip_apng(limits: Mapping[str, int]):
    return _walker(lambda data: apng.apng(data, limits))
