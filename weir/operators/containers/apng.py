"""Animated PNG remux."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Mapping

from . import Cleaned, Malformed

SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Chunks that stay, and allowed bit depths by colour type.
KEPT = (b"IHDR", b"PLTE", b"tRNS", b"IDAT", b"acTL", b"fcTL", b"fdAT", b"IEND")
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}


def _fail(message: str):
    raise Malformed("AnimatedImage", message)


def chunks(data: bytes, most: int, largest: int) -> Iterator[tuple[bytes, bytes]]:
    """(name, data) of the chunks up to IEND, with checked CRCs."""
    at = 8
    for _ in range(most):
        if at + 12 > len(data):
            _fail("chunk header is cut off")
        size, name = struct.unpack_from(">I4s", data, at)
        if size > largest:
            _fail(f"chunk of {size} bytes is above the limit")
        if at + 12 + size > len(data):
            _fail("chunk reaches beyond the end")
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(name + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            _fail("CRC of a chunk doesn't fit")
        if name == b"PLTE" and size % 3:
            _fail("PLTE isn't made of triples")
        yield name, body
        if name == b"IEND":
            return
        at += 12 + size
    _fail("no IEND among the chunks that are looked at")


def header(data: bytes, limits: Mapping[str, int]) -> tuple[int, int]:
    if len(data) < 33:
        _fail("too short for IHDR")
    size, name, width, height, depth, colour = struct.unpack_from(">I4sIIBB", data, 8)
    if size != 13 or name != b"IHDR":
        _fail("the first chunk is no IHDR")
    if not width or not height:
        _fail("IHDR has no area")
    if max(width, height) > limits["max_side"]:
        _fail("IHDR has a side above the limit")
    if depth not in DEPTHS.get(colour, ()):
        _fail("IHDR has no valid colour type and depth")
    return width, height


def apng(data: bytes, limits: Mapping[str, int], check: Callable[[], None] = lambda: None) -> Cleaned:
    """The critical and animation chunks; bytes behind IEND are dropped. limits: a policy's animated_image fields; check: called for each chunk."""
    if data[:8] != SIGNATURE:
        _fail("not a PNG")
    width, height = header(data, limits)
    if width * height > limits["max_pixels_per_frame"]:
        _fail("a frame has more pixels than allowed")
    kept, frames, stripped, cut = [SIGNATURE], None, 0, 0
    for name, body in chunks(data, limits["max_chunks"], limits["max_chunk_size"]):
        check()
        if name == b"acTL" and len(body) >= 8:
            frames = int.from_bytes(body[:4], "big")
        if name in KEPT:
            kept.append(struct.pack(">I4s", len(body), name) + body + struct.pack(">I", zlib.crc32(name + body)))
        else:
            stripped, cut = stripped + 1, cut + 12 + len(body)
    if frames is not None:
        if not frames:
            _fail("acTL has no frames")
        if frames > limits["max_frames"]:
            _fail("more frames than allowed")
        if frames * width * height > limits["max_total_pixels"]:
            _fail("more pixels in all frames than allowed")
    return Cleaned(b"".join(kept), "image/png" if frames is None else "image/apng", stripped, cut, "static" if frames is None else str(frames))
