"""PNG and APNG decoding (all colour types, depths and Adam7) and 8-bit RGBA encoding."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from weir.operators.containers.apng import DEPTHS, SIGNATURE

from . import Undecodable

_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise Undecodable("no PNG signature")
    out, at = [], 8
    while True:
        if at + 12 > len(data):
            raise Undecodable("PNG ends before IEND")
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data) or zlib.crc32(name + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise Undecodable("PNG chunk is damaged")
        out.append((name, body))
        if name == b"IEND":
            return out
        at += 12 + size


def dimensions(data: bytes) -> tuple[int, int]:
    if data[:8] != SIGNATURE or len(data) < 33 or data[12:16] != b"IHDR":
        raise Undecodable("no PNG header")
    return struct.unpack_from(">II", data, 16)


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    if len(raw) < height * (stride + 1):
        raise Undecodable("PNG pixel data is too short")
    lines = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    out, above = np.zeros((height, stride), np.uint8), np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = int(lines[y, 0]), lines[y, 1:].copy()
        if kind == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step], dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            here, over = line.tolist(), above.tolist()
            for x in range(stride):
                a, b = here[x - step] if x >= step else 0, over[x]
                if kind == 3:
                    here[x] = (here[x] + (a + b) // 2) & 255
                else:
                    c = over[x - step] if x >= step else 0
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    here[x] = (here[x] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
            line = np.array(here, np.uint8)
        elif kind:
            raise Undecodable("PNG filter is unknown")
        out[y] = above = line
    return out


def _samples(rows: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    """height x width x channels, in 16 bits for depth 16, else 8."""
    if depth == 16:
        return rows.reshape(len(rows), -1, 2).astype(np.uint16)[:, :, 0].reshape(len(rows), width, channels) << 8 | rows.reshape(len(rows), -1, 2)[:, :, 1].reshape(len(rows), width, channels)
    if depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(len(rows), width, depth)
        return (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)[:, :, None]
    return rows.reshape(len(rows), width, channels)


def _pixels(packed: bytes, width: int, height: int, depth: int, colour: int, interlaced: bool, palette: bytes, clear: bytes) -> np.ndarray:
    channels = _CHANNELS[colour]
    line = lambda w: (w * channels * depth + 7) // 8
    parts = [(x, y, dx, dy, -(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in _ADAM7] if interlaced else [(0, 0, 1, 1, width, height)]
    parts = [p for p in parts if p[4] > 0 and p[5] > 0]
    most = sum(p[5] * (line(p[4]) + 1) for p in parts)
    try:
        stream = zlib.decompressobj()
        raw = stream.decompress(packed, most)
    except zlib.error as e:
        raise Undecodable(f"PNG pixel data: {e}") from None
    step, at = max(1, channels * depth // 8), 0
    out = np.zeros((height, width, channels), np.uint16 if depth == 16 else np.uint8)
    for x, y, dx, dy, w, h in parts:
        size = h * (line(w) + 1)
        out[y::dy, x::dx] = _samples(_unfiltered(raw[at : at + size], h, line(w), step), w, depth, channels)
        at += size
    return _rgba(out, depth, colour, palette, clear)


def _rgba(s: np.ndarray, depth: int, colour: int, palette: bytes, clear: bytes) -> np.ndarray:
    rgba = np.full((*s.shape[:2], 4), 255, np.uint8)
    if colour == 3:
        table = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        if not len(table) or s.max(initial=0) >= len(table):
            raise Undecodable("PNG palette is too short")
        rgba[:, :, :3] = table[s[:, :, 0]]
        alpha = np.full(len(table), 255, np.uint8)
        alpha[: min(len(clear), len(table))] = np.frombuffer(clear, np.uint8)[: len(table)]
        rgba[:, :, 3] = alpha[s[:, :, 0]]
        return rgba
    eight = (s >> 8).astype(np.uint8) if depth == 16 else (s * (255 // ((1 << depth) - 1))).astype(np.uint8)
    rgba[:, :, :3] = eight[:, :, :3] if colour in (2, 6) else eight[:, :, :1]
    if colour in (4, 6):
        rgba[:, :, 3] = eight[:, :, -1]
    elif len(clear) >= 2 * s.shape[2]:
        key = np.frombuffer(clear, ">u2")[: s.shape[2]]
        rgba[(s == key).all(axis=2), 3] = 0
    return rgba


def _header(parts: list[tuple[bytes, bytes]]) -> tuple[int, int, int, int, bool, bytes, bytes]:
    if not parts or parts[0][0] != b"IHDR" or len(parts[0][1]) != 13:
        raise Undecodable("PNG begins without IHDR")
    width, height, depth, colour, packing, filtering, interlaced = struct.unpack(">IIBBBBB", parts[0][1])
    if not width or not height or depth not in DEPTHS.get(colour, ()) or packing or filtering or interlaced > 1:
        raise Undecodable("PNG header is invalid")
    by = dict(reversed(parts))
    return width, height, depth, colour, bool(interlaced), by.get(b"PLTE", b""), by.get(b"tRNS", b"")


def decode(data: bytes) -> np.ndarray:
    """height x width x 4, 8 bits; 16-bit samples lose their low byte."""
    parts = chunks(data)
    width, height, depth, colour, interlaced, palette, clear = _header(parts)
    return _pixels(b"".join(b for n, b in parts if n == b"IDAT"), width, height, depth, colour, interlaced, palette, clear)


def decode_frames(data: bytes) -> list[np.ndarray]:
    """The areas of all animation frames; acTL has to give their number."""
    parts = chunks(data)
    width, height, depth, colour, interlaced, palette, clear = _header(parts)
    declared = [b for n, b in parts if n == b"acTL"]
    if len(declared) != 1 or len(declared[0]) != 8:
        raise Undecodable("no animation control")
    frames, area, body = [], None, []

    def close():
        if area is not None:
            frames.append(_pixels(b"".join(body), *area, depth, colour, interlaced, palette, clear))

    for name, b in parts:
        if name == b"fcTL":
            close()
            if len(b) != 26:
                raise Undecodable("frame control is damaged")
            w, h, x, y = struct.unpack_from(">IIII", b, 4)
            if not w or not h or x + w > width or y + h > height:
                raise Undecodable("a frame lies outside the canvas")
            area, body = (w, h), []
        elif name == b"IDAT" and area is not None:
            body.append(b)
        elif name == b"fdAT":
            if area is None or len(b) < 4:
                raise Undecodable("frame data without control")
            body.append(b[4:])
    close()
    if len(frames) != int.from_bytes(declared[0][:4], "big") or not frames:
        raise Undecodable("the number of frames differs from the declared one")
    return frames


def chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def encode(rgba: np.ndarray, level: int = 6) -> bytes:
    """8-bit, RGB if nothing is transparent, else RGBA."""
    height, width = rgba.shape[:2]
    opaque = bool((rgba[:, :, 3] == 255).all())
    pixels = rgba[:, :, :3] if opaque else rgba
    lines = np.zeros((height, 1 + width * pixels.shape[2]), np.uint8)
    lines[:, 1:] = pixels.reshape(height, -1)
    lines[1:, 1:] -= pixels.reshape(height, -1)[:-1]
    lines[1:, 0] = 2
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if opaque else 6, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")
