"""TIFF: the first picture of a file, in strips or tiles: grey, RGB, palette and ink; plain, PackBits, LZW and deflate."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from . import Undecodable

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 6: 1, 7: 1, 8: 2, 9: 4}
_READ = {1: "B", 3: "H", 4: "I"}


def _tags(data: bytes) -> tuple[str, dict[int, list[int]]]:
    """Byte order and the whole-number tags of the first directory."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None or len(data) < 8:
        raise Undecodable("no TIFF signature")
    at = struct.unpack_from(f"{order}I", data, 4)[0]
    if at + 2 > len(data):
        raise Undecodable("TIFF directory lies outside the file")
    count = struct.unpack_from(f"{order}H", data, at)[0]
    if at + 2 + 12 * count > len(data):
        raise Undecodable("TIFF directory is cut")
    tags = {}
    for k in range(count):
        entry = at + 2 + 12 * k
        tag, kind, n = struct.unpack_from(f"{order}HHI", data, entry)
        if kind not in _READ:
            continue
        size = _SIZES[kind] * n
        place = entry + 8 if size <= 4 else struct.unpack_from(f"{order}I", data, entry + 8)[0]
        if place + size > len(data):
            raise Undecodable("TIFF tag lies outside the file")
        tags[tag] = list(struct.unpack_from(f"{order}{n}{_READ[kind]}", data, place))
    return order, tags


def _number(tags: dict[int, list[int]], tag: int, otherwise: int | None = None) -> int:
    values = tags.get(tag) or ([] if otherwise is None else [otherwise])
    if not values:
        raise Undecodable(f"TIFF without tag {tag}")
    return values[0]


def dimensions(data: bytes) -> tuple[int, int]:
    tags = _tags(data)[1]
    return _number(tags, 256), _number(tags, 257)


def packbits(data: bytes, most: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < most:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out[:most])


def lzw(data: bytes, most: int) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, which widen one code early."""
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    words, width, out, before = first[:], 9, bytearray(), b""
    held = n = 0
    for byte in data:
        held, n = held << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code, held = held >> n, held & (1 << n) - 1
        if code == 257 or len(out) >= most:
            break
        if code == 256:
            words, width, before = first[:], 9, b""
            continue
        if code < len(words):
            word = words[code]
        elif code == len(words) and before:
            word = before + before[:1]
        else:
            raise Undecodable("TIFF code is damaged")
        out += word
        if before and len(words) < 4096:
            words.append(before + word[:1])
        before = word
        width = min(12, max(9, (len(words) + 1).bit_length()))
    return bytes(out[:most])


def _inflated(data: bytes, most: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, most)
    except zlib.error as e:
        raise Undecodable(f"TIFF data are damaged: {e}") from None


_UNPACK = {1: lambda data, most: data[:most], 5: lzw, 8: _inflated, 32946: _inflated, 32773: packbits}


def _samples(raw: bytes, rows: int, columns: int, per_pixel: int, bits: int, order: str, predictor: int) -> np.ndarray:
    """(rows, columns, samples) of one strip or tile."""
    stride = (columns * per_pixel * bits + 7) // 8
    if len(raw) < rows * stride:
        raise Undecodable("TIFF strip is too short")
    lines = np.frombuffer(raw, np.uint8, rows * stride).reshape(rows, stride)
    if bits == 16:
        values = lines.view(f"{order}u2").astype(np.uint16)
    elif bits == 8:
        values = lines
    else:
        single = np.unpackbits(lines, axis=1).reshape(rows, -1, bits)
        values = (single << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)[:, : columns * per_pixel]
    values = values.reshape(rows, columns, per_pixel)
    return np.cumsum(values, axis=1, dtype=values.dtype) if predictor == 2 else values


def decode(data: bytes) -> np.ndarray:
    """RGBA of eight bits; of wider samples the upper eight count, unassociated alpha is kept, other extra samples are dropped."""
    order, tags = _tags(data)
    width, height = dimensions(data)
    per_pixel, packing, colour = _number(tags, 277, 1), _number(tags, 259, 1), _number(tags, 262)
    depths, planar, predictor = set(tags.get(258, [1])), _number(tags, 284, 1), _number(tags, 317, 1)
    bits = min(depths)
    least = {0: 1, 1: 1, 2: 3, 3: 1, 5: 4}.get(colour)
    if not width * height or len(depths) != 1 or bits not in (1, 2, 4, 8, 16) or packing not in _UNPACK or least is None or not least <= per_pixel <= 8:
        raise Undecodable("TIFF variant has no decoder")
    if predictor not in (1, 2) or (predictor == 2 and bits < 8) or planar not in (1, 2) or _number(tags, 266, 1) != 1 or set(tags.get(339, [1])) != {1}:
        raise Undecodable("TIFF variant has no decoder")
    tiled = 322 in tags
    across, down = (_number(tags, 322), _number(tags, 323)) if tiled else (width, min(height, _number(tags, 278, height)))
    if not across or not down or across * down > 4 * width * height + (1 << 22):
        raise Undecodable("TIFF tiles are impossible")
    places, sizes = tags.get(324 if tiled else 273, []), tags.get(325 if tiled else 279, [])
    columns, rows, planes = -(-width // across), -(-height // down), per_pixel if planar == 2 else 1
    if len(places) != columns * rows * planes or len(sizes) != len(places):
        raise Undecodable("TIFF has too few or too many strips")
    together = per_pixel // planes
    pixels = np.zeros((height, width, per_pixel), np.uint16 if bits == 16 else np.uint8)
    for k, (place, size) in enumerate(zip(places, sizes)):
        plane, cell = divmod(k, columns * rows)
        top, left = cell // columns * down, cell % columns * across
        deep = down if tiled else min(down, height - top)
        if place + size > len(data):
            raise Undecodable("TIFF strip lies outside the file")
        raw = _UNPACK[packing](data[place : place + size], deep * ((across * together * bits + 7) // 8))
        part = _samples(raw, deep, across, together, bits, order, predictor)[: height - top, : width - left]
        pixels[top : top + part.shape[0], left : left + part.shape[1], plane * together : (plane + 1) * together] = part
    rgba = np.full((height, width, 4), 255, np.uint8)
    if colour == 3:
        table = np.array(tags.get(320, []))
        if len(table) != 3 << bits:
            raise Undecodable("TIFF palette has the wrong size")
        rgba[:, :, :3] = (table.reshape(3, -1) >> 8).T[pixels[:, :, 0]]
        return rgba
    level = (pixels >> 8).astype(np.uint8) if bits == 16 else (pixels.astype(np.uint16) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    if colour in (0, 1):
        rgba[:, :, :3] = 255 - level[:, :, :1] if colour == 0 else level[:, :, :1]
    elif colour == 2:
        rgba[:, :, :3] = level[:, :, :3]
    else:
        rgba[:, :, :3] = ((255 - level[:, :, :3]).astype(np.uint16) * (255 - level[:, :, 3:4]) + 127) // 255
    if tags.get(338, [0])[0] == 2 and per_pixel > least:
        rgba[:, :, 3] = level[:, :, least]
    return rgba
