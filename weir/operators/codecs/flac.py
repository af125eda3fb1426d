"""FLAC: every frame decoded and held against its checksums, the whole stream against its digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import mul

import numpy as np

from . import Undecodable

# Fixed values of the format, by code; None: given elsewhere or reserved.
BLOCKS = (None, 192, 576, 1152, 2304, 4608, None, None, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768)
RATES = (None, 88200, 176400, 192000, 8000, 16000, 22050, 24000, 32000, 44100, 48000, 96000, None, None, None, None)
DEPTHS = (None, 8, 12, None, 16, 20, 24, 32)

#: No frame is longer, in bytes: eight channels of 65,535 plain samples of 33 bits are half of it.
MOST_FRAME = 1 << 22


def _crc_table(polynomial: int, width: int) -> list[int]:
    table = []
    for value in range(256):
        value <<= width - 8
        for _ in range(8):
            value = value << 1 ^ (polynomial if value >> (width - 1) else 0)
            value &= (1 << width) - 1
        table.append(value)
    return table


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    value = 0
    for byte in data:
        value = _CRC8[value ^ byte]
    return value


def crc16(data: bytes) -> int:
    value = 0
    for byte in data:
        value = value << 8 & 0xFF00 ^ _CRC16[value >> 8 ^ byte]
    return value


class _Short(Exception):
    """The stretch of bits that was looked at is too short."""


class _Bits:
    """Bits as a text of 0 and 1: what is unary is found by searching."""

    def __init__(self, data: bytes):
        self.text, self.at = f"{int.from_bytes(data, 'big'):0{8 * len(data)}b}" if data else "", 0

    def number(self, n: int) -> int:
        at, self.at = self.at, self.at + n
        if self.at > len(self.text):
            raise _Short
        return int(self.text[at : self.at], 2) if n else 0

    def signed(self, n: int) -> int:
        value = self.number(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def zeros(self) -> int:
        at, one = self.at, self.text.find("1", self.at)
        if one < 0:
            raise _Short
        self.at = one + 1
        return one - at

    def rice(self, count: int, low: int) -> list[int]:
        text, at, end, out = self.text, self.at, len(self.text), []
        find = text.find
        for _ in range(count):
            one = find("1", at)
            at = one + 1 + low
            if one < 0 or at > end:
                raise _Short
            folded = (one - self.at) << low | (int(text[one + 1 : at], 2) if low else 0)
            out.append(folded >> 1 if not folded & 1 else -(folded >> 1) - 1)
            self.at = at
        return out


@dataclass
class Stream:
    rate: int
    channels: int
    depth: int
    samples: int
    digest: bytes
    start: int


def stream(data: bytes) -> Stream:
    """What the first metadata block says, and where the frames start."""
    if data[:4] != b"fLaC" or len(data) < 42 or data[4] & 127 or int.from_bytes(data[5:8], "big") != 34:
        raise Undecodable("no FLAC stream")
    fields = int.from_bytes(data[18:26], "big")
    at, last = 4, False
    while not last:
        if at + 4 > len(data):
            raise Undecodable("FLAC metadata are cut")
        last, at = data[at] > 127, at + 4 + int.from_bytes(data[at + 1 : at + 4], "big")
    return Stream(fields >> 44, (fields >> 41 & 7) + 1, (fields >> 36 & 31) + 1, fields & (1 << 36) - 1, data[26:42], at)


def _residual(bits: _Bits, block: int, order: int) -> list[int]:
    method, parts = bits.number(2), bits.number(4)
    if method > 1 or block >> parts << parts != block or block >> parts < order:
        raise Undecodable("FLAC residual is impossible")
    wide, out = 4 + method, []
    for part in range(1 << parts):
        count, low = (block >> parts) - (0 if part else order), bits.number(wide)
        if low == (1 << wide) - 1:
            plain = bits.number(5)
            out += [bits.signed(plain) for _ in range(count)]
        else:
            out += bits.rice(count, low)
    return out


def _subframe(bits: _Bits, block: int, depth: int) -> np.ndarray:
    if bits.number(1):
        raise Undecodable("FLAC subframe is damaged")
    kind, wasted = bits.number(6), 0
    if bits.number(1):
        wasted = bits.zeros() + 1
    depth -= wasted
    if depth < 1:
        raise Undecodable("FLAC subframe has no bits left")
    if kind == 0:
        values = np.full(block, bits.signed(depth), np.int64)
    elif kind == 1:
        values = np.array([bits.signed(depth) for _ in range(block)], np.int64)
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        if order > block:
            raise Undecodable("FLAC predictor is longer than its block")
        first = [bits.signed(depth) for _ in range(order)]
        if kind < 32:
            values = _fixed(first, _residual(bits, block, order), order)
        else:
            precision, shift = bits.number(4) + 1, bits.signed(5)
            if precision == 16 or shift < 0:
                raise Undecodable("FLAC predictor is impossible")
            weights = [bits.signed(precision) for _ in range(order)][::-1]
            for rest in _residual(bits, block, order):
                first.append(rest + (sum(map(mul, weights, first[-order:])) >> shift))
            if max(map(abs, first)) >> 62:
                raise Undecodable("FLAC sample is out of range")
            values = np.array(first, np.int64)
    else:
        raise Undecodable("FLAC subframe of a reserved kind")
    return values << wasted


def _fixed(first: list[int], rest: list[int], order: int) -> np.ndarray:
    """The `order`-th differences are the residual; sums undo them, each from where the first samples' differences end."""
    known, values = np.array(first, np.int64), np.array(rest, np.int64)
    for k in reversed(range(order)):
        values = np.cumsum(values) + np.diff(known, k)[-1]
    return np.concatenate([known, values])


def _frame(data: bytes, at: int, most: int, s: Stream) -> tuple[int, int, np.ndarray]:
    """Place behind the frame at `at`, its rate and its samples (channels, block), looking at `most` bytes."""
    bits = _Bits(data[at : at + most])
    if bits.number(15) != 0x7FFC:
        raise Undecodable("FLAC frame doesn't start with its mark")
    bits.number(1)
    block_code, rate_code, channel_code, depth_code, reserved = bits.number(4), bits.number(4), bits.number(4), bits.number(3), bits.number(1)
    lead = f"{bits.number(8):08b}".index("0") if bits.text[bits.at : bits.at + 8] != "1" * 8 else 8
    if lead == 1 or lead > 7:
        raise Undecodable("FLAC frame number is damaged")
    bits.number(8 * max(0, lead - 1))
    block = bits.number(8 * (block_code - 5)) + 1 if block_code in (6, 7) else BLOCKS[block_code]
    rate = {12: 1000, 13: 1, 14: 10}[rate_code] * bits.number(8 if rate_code == 12 else 16) if 12 <= rate_code <= 14 else RATES[rate_code] or (s.rate if not rate_code else None)
    depth = DEPTHS[depth_code] or (s.depth if not depth_code else None)
    if block is None or rate is None or depth is None or channel_code > 10 or reserved:
        raise Undecodable("FLAC frame header is damaged")
    head = bits.at // 8
    if crc8(data[at : at + head]) != bits.number(8):
        raise Undecodable("FLAC frame header has a wrong checksum")
    channels = channel_code + 1 if channel_code < 8 else 2
    if channels != s.channels or depth != s.depth or rate != s.rate:
        raise Undecodable("FLAC frame differs from its stream")
    side = {8: 1, 9: 0, 10: 1}.get(channel_code)
    parts = [_subframe(bits, block, depth + (k == side)) for k in range(channels)]
    end = -(-bits.at // 8)
    if at + end + 2 > len(data) or crc16(data[at : at + end]) != int.from_bytes(data[at + end : at + end + 2], "big"):
        raise Undecodable("FLAC frame has a wrong checksum")
    if channel_code == 8:
        parts[1] = parts[0] - parts[1]
    elif channel_code == 9:
        parts[0] = parts[0] + parts[1]
    elif channel_code == 10:
        twice = parts[0] * 2 + (parts[1] & 1)
        parts = [twice + parts[1] >> 1, twice - parts[1] >> 1]
    return at + end + 2, rate, np.stack(parts)


def frames(data: bytes) -> Iterator[np.ndarray]:
    """Samples (channels, block) of one frame after the other; damage, also of the whole stream's digest, is an error."""
    s = stream(data)
    if not s.rate or s.depth < 4:
        raise Undecodable("FLAC stream is impossible")
    at, total, digest, most = s.start, 0, hashlib.md5(), 1 << 14
    while at < len(data):
        while True:
            try:
                at, _, samples = _frame(data, at, most, s)
                break
            except _Short:
                if at + most >= len(data) or most >= MOST_FRAME:
                    raise Undecodable("FLAC frame is cut, or longer than its samples") from None
                most *= 4
        total += samples.shape[1]
        wide = (s.depth + 7) // 8
        digest.update(samples.T.astype("<i8", order="C").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes())
        yield samples
    if s.samples not in (0, total) or (any(s.digest) and s.digest != digest.digest()):
        raise Undecodable("FLAC samples aren't those that the stream promises")
