"""GIF decoding into frames and encoding."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from . import Undecodable


@dataclass
class Frame:
    left: int
    top: int
    rgba: np.ndarray
    delay: int = 0
    dispose: int = 0


def dimensions(data: bytes) -> tuple[int, int]:
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise Undecodable("no GIF header")
    return struct.unpack_from("<HH", data, 6)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while True:
        if at >= len(data):
            raise Undecodable("GIF ends within a block")
        n = data[at]
        if not n:
            return b"".join(out), at + 1
        if at + 1 + n > len(data):
            raise Undecodable("GIF ends within a block")
        out.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def _unpacked(data: bytes, least: int, wanted: int) -> np.ndarray:
    """LZW with codes of least + 1 to 12 bits."""
    if not 1 <= least <= 11:
        raise Undecodable("GIF code size is invalid")
    clear, end = 1 << least, (1 << least) + 1
    base = [bytes([k]) for k in range(clear)] + [b"", b""]
    table, width, out, size, last = list(base), least + 1, [], 0, None
    bits = held = 0
    for byte in data:
        bits |= byte << held
        held += 8
        while held >= width:
            code = bits & ((1 << width) - 1)
            bits, held = bits >> width, held - width
            if code == clear:
                table, width, last = list(base), least + 1, None
                continue
            if code == end:
                if size < wanted:
                    raise Undecodable("GIF frame is too short")
                return np.frombuffer(b"".join(out), np.uint8)[:wanted]
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last is not None:
                entry = last + last[:1]
            else:
                raise Undecodable("GIF code is invalid")
            out.append(entry)
            size += len(entry)
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = entry
            if size > wanted + 4096:
                raise Undecodable("GIF frame is too long")
    if size < wanted:
        raise Undecodable("GIF frame is too short")
    return np.frombuffer(b"".join(out), np.uint8)[:wanted]


def frames(data: bytes, most: int, most_pixels: int, check: Callable[[], None] = lambda: None) -> list[Frame]:
    """All frames; limits are checked, and check is called, before a frame is decoded."""
    dimensions(data)
    at, shared = 13, None
    if data[10] & 0x80:
        n = 3 << ((data[10] & 7) + 1)
        shared, at = data[13 : 13 + n], 13 + n
        if len(shared) < n:
            raise Undecodable("GIF colours are cut off")
    out, delay, dispose, clear = [], 0, 0, None
    while True:
        if at >= len(data):
            raise Undecodable("GIF ends without a trailer")
        mark = data[at]
        if mark == 0x3B:
            return out
        if mark == 0x21:
            body, after = _blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                dispose, delay = (body[0] >> 2) & 7, body[1] | body[2] << 8
                clear = body[3] if body[0] & 1 else None
            at = after
        elif mark == 0x2C:
            if at + 11 > len(data):
                raise Undecodable("GIF frame header is cut off")
            check()
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at, colours = at + 10, shared
            if flags & 0x80:
                n = 3 << ((flags & 7) + 1)
                colours, at = data[at : at + n], at + n
            if colours is None or len(colours) % 3 or at >= len(data):
                raise Undecodable("GIF frame has no colours")
            if len(out) >= most:
                raise Undecodable(f"more than {most} frames")
            if w * h > most_pixels or not w * h:
                raise Undecodable(f"a frame of {w * h} pixels")
            least = data[at]
            body, at = _blocks(data, at + 1)
            index = _unpacked(body, least, w * h).reshape(h, w)
            if flags & 0x40:
                order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
                plain = np.empty_like(index)
                plain[order] = index
                index = plain
            palette = np.frombuffer(colours, np.uint8).reshape(-1, 3)
            if index.max() >= len(palette):
                raise Undecodable("GIF colour is outside its table")
            rgba = np.full((h, w, 4), 255, np.uint8)
            rgba[:, :, :3] = palette[index]
            if clear is not None:
                rgba[index == clear] = 0
            out.append(Frame(left, top, rgba, delay, dispose))
            delay, dispose, clear = 0, 0, None
        else:
            raise Undecodable("GIF block is unknown")


def _packed(index: bytes, least: int) -> bytes:
    clear, end = 1 << least, (1 << least) + 1
    table = {bytes([k]): k for k in range(clear)}
    width, bits, held, out, run = least + 1, 0, 0, bytearray(), b""

    def put(code: int) -> None:
        nonlocal bits, held
        bits |= code << held
        held += width
        while held >= 8:
            out.append(bits & 255)
            bits, held = bits >> 8, held - 8

    put(clear)
    following = end + 1
    for k in range(len(index)):
        longer = run + index[k : k + 1]
        if longer in table:
            run = longer
            continue
        put(table[run])
        if following < 4096:
            table[longer] = following
            if following == 1 << width and width < 12:
                width += 1
            following += 1
        else:
            put(clear)
            table, width, following = {bytes([j]): j for j in range(clear)}, least + 1, end + 1
        run = index[k : k + 1]
    if run:
        put(table[run])
    put(end)
    if held:
        out.append(bits & 255)
    return bytes(out)


def _indexed(rgba: np.ndarray) -> tuple[np.ndarray, np.ndarray, int | None]:
    """Colour numbers, the table and the transparent number; colours beyond 256 lose low bits until they fit."""
    shown = rgba[:, :, 3] > 0
    for lost in range(8):
        key = ((rgba[:, :, 0].astype(np.uint32) >> lost) << 16 | (rgba[:, :, 1].astype(np.uint32) >> lost) << 8 | rgba[:, :, 2].astype(np.uint32) >> lost)
        names, first = np.unique(key[shown], return_index=True)
        if len(names) + (not shown.all()) <= 256:
            break
    table = rgba[shown][first, :3] if len(names) else np.zeros((0, 3), np.uint8)
    index = np.searchsorted(names, key).clip(0, 255).astype(np.uint8)
    clear = None
    if not shown.all():
        clear = len(names)
        index[~shown] = clear
        table = np.concatenate([table, np.zeros((1, 3), np.uint8)])
    return index, table, clear


def encode(width: int, height: int, shots: list[Frame]) -> bytes:
    """An endless animation without comments or application data but the loop count."""
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0, 0, 0), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    for f in shots:
        index, table, clear = _indexed(f.rgba)
        bits = max(1, (max(2, len(table)) - 1).bit_length())
        colours = table.tobytes().ljust(3 << bits, b"\0")
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, f.dispose << 2 | (clear is not None), f.delay, clear or 0, 0))
        h, w = index.shape
        out.append(struct.pack("<BHHHHB", 0x2C, f.left, f.top, w, h, 0x80 | bits - 1) + colours)
        least = max(2, bits)
        body = _packed(index.tobytes(), least)
        out.append(bytes([least]) + b"".join(bytes([len(body[k : k + 255])]) + body[k : k + 255] for k in range(0, len(body), 255)) + b"\0")
    return b"".join(out) + b"\x3b"
