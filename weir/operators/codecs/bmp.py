"""Uncompressed BMP decoding (8, 24 and 32 bits)."""

from __future__ import annotations

import struct

import numpy as np

from . import Undecodable


def dimensions(data: bytes) -> tuple[int, int]:
    if data[:2] != b"BM" or len(data) < 54:
        raise Undecodable("no BMP header")
    width, height = struct.unpack_from("<ii", data, 18)
    return abs(width), abs(height)


def decode(data: bytes) -> np.ndarray:
    width, height = dimensions(data)
    start, size = struct.unpack_from("<II", data, 10)
    upward = struct.unpack_from("<i", data, 22)[0] > 0
    depth, packing, _, _, _, colours = struct.unpack_from("<HIIIII", data, 28)
    if depth not in (8, 24, 32) or packing not in ((0, 3) if depth == 32 else (0,)):
        raise Undecodable("BMP variant has no decoder")
    stride = (width * depth + 31) // 32 * 4
    if start + stride * height > len(data) or not width * height:
        raise Undecodable("BMP pixel data is too short")
    rows = np.frombuffer(data, np.uint8, stride * height, start).reshape(height, stride)[:, : width * depth // 8]
    rows = rows[::-1] if upward else rows
    rgba = np.full((height, width, 4), 255, np.uint8)
    if depth == 8:
        table = np.frombuffer(data[14 + size : start], np.uint8)
        table = table[: len(table) // 4 * 4].reshape(-1, 4)[: colours or 256]
        if not len(table) or rows.max() >= len(table):
            raise Undecodable("BMP palette is too short")
        rgba[:, :, :3] = table[rows][:, :, 2::-1]
    else:
        rgba[:, :, :3] = rows.reshape(height, width, depth // 8)[:, :, 2::-1]
    return rgba
