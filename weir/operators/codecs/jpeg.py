"""JPEG: decoding of sequential and progressive Huffman files of 8 bits, and sequential encoding without subsampling.

Coefficients are read bit by bit in Python; the transform, colours and sampling run over whole components in numpy. A file
that ends early, or whose scans don't cover every block, has no pixels. Chroma is repeated, not interpolated.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from . import Undecodable

# Fixed values of the standard: example quantisation tables in natural order (rows).
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
) + (99,) * 32

#: Place in the block (by rows) of the k-th coefficient: diagonals, upwards where their number is even.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
_BASIS = np.array([[np.sqrt((2 if u else 1) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
_END = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
_FRAMES = {0xC0: False, 0xC1: False, 0xC2: True}  # marker: progressive


@dataclass
class Component:
    name: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks that hold pixels, as single scans count them
    high: int = 0
    stride: int = 0  # blocks stored in a row
    coefficients: array = field(default_factory=lambda: array("h"))
    quantiser: np.ndarray | None = None
    seen: bool = False


def _frame(data: bytes) -> tuple[int, int, int, bytes]:
    """Place, height, width and body of the first frame header."""
    for marker, at, body in _segments(data):
        if marker in _FRAMES:
            if len(body) < 6 or body[0] != 8 or len(body) < 6 + 3 * body[5]:
                raise Undecodable("JPEG frame header is damaged or not of 8 bits")
            return at, *struct.unpack_from(">HH", body, 1), body
        if 0xC3 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise Undecodable("JPEG process has no decoder")
    raise Undecodable("JPEG without frame")


def _segments(data: bytes):
    """Marker, place behind the segment and body of all segments; behind a scan's header its data are skipped."""
    if data[:3] != b"\xff\xd8\xff":
        raise Undecodable("no JPEG signature")
    at = 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 2 > len(data) or data[at] != 0xFF:
            raise Undecodable("JPEG ends before its end marker")
        marker, at = data[at + 1], at + 2
        if marker == 0xD9:
            yield marker, at, b""
            return
        size = int.from_bytes(data[at : at + 2], "big")
        if size < 2 or at + size > len(data):
            raise Undecodable("JPEG segment is damaged")
        body, at = data[at + 2 : at + size], at + size
        yield marker, at, body
        if marker == 0xDA:
            end = _END.search(data, at)
            if end is None:
                raise Undecodable("JPEG ends within a scan")
            at = end.start()


def dimensions(data: bytes) -> tuple[int, int]:
    _, height, width, _ = _frame(data)
    return width, height


class _Bits:
    """Bits of one stretch of a scan, without stuffing; reading on beyond its end is an error."""

    def __init__(self, data: bytes):
        plain = data.replace(b"\xff\x00", b"\xff")
        self.data, self.at, self.end = plain + bytes(4), 0, 8 * len(plain)

    def symbol(self, table: list[int]) -> int:
        at = self.at
        found = table[int.from_bytes(self.data[at >> 3 : (at >> 3) + 3], "big") >> (8 - (at & 7)) & 0xFFFF]
        self.at = at + (found >> 8)
        if not found or self.at > self.end:
            raise Undecodable("JPEG code is damaged")
        return found & 255

    def bits(self, n: int) -> int:
        if not n:
            return 0
        at = self.at
        self.at = at + n
        if self.at > self.end:
            raise Undecodable("JPEG scan is too short")
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 3], "big") >> (24 - n - (at & 7)) & (1 << n) - 1

    def signed(self, n: int) -> int:
        value = self.bits(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


def _code_table(counts: bytes, symbols: bytes) -> list[int]:
    """Of every 16 bits that may follow: length of the code times 256, plus its symbol; 0 where none fits."""
    table, at, code = [0] * 65536, 0, 0
    for length, count in enumerate(counts, 1):
        for symbol in symbols[at : at + count]:
            first, wide = code << (16 - length), 1 << (16 - length)
            if first + wide > 65536:
                raise Undecodable("JPEG code table is damaged")
            table[first : first + wide] = [length << 8 | symbol] * wide
            code += 1
        at, code = at + count, code << 1
    return table


def _whole_block(bits: _Bits, c: array, base: int, dc: list[int], ac: list[int], before: int) -> int:
    before += bits.signed(bits.symbol(dc) & 15)
    c[base] = before
    k = 1
    while k < 64:
        run, size = divmod(bits.symbol(ac), 16)
        if size:
            k += run
            if k > 63:
                raise Undecodable("JPEG block is too long")
            c[base + ZIGZAG[k]] = bits.signed(size)
            k += 1
        elif run == 15:
            k += 16
        else:
            break
    return before


def _first_band(bits: _Bits, c: array, base: int, ac: list[int], first: int, last: int, low: int, ended: int) -> int:
    if ended:
        return ended - 1
    k = first
    while k <= last:
        run, size = divmod(bits.symbol(ac), 16)
        if size:
            k += run
            if k > last:
                raise Undecodable("JPEG band is too long")
            c[base + ZIGZAG[k]] = bits.signed(size) * (1 << low)
            k += 1
        elif run == 15:
            k += 16
        else:
            return (1 << run) + bits.bits(run) - 1
    return 0


def _finer_band(bits: _Bits, c: array, base: int, ac: list[int], first: int, last: int, low: int, ended: int) -> int:
    one, k = 1 << low, first
    while k <= last and not ended:
        run, size = divmod(bits.symbol(ac), 16)
        new = 0
        if size:
            new = one if bits.bits(1) else -one
        elif run < 15:
            ended = (1 << run) + bits.bits(run)
            break
        while k <= last:  # past `run` zeros to the place of the new value; values on the way get their next bit
            z = base + ZIGZAG[k]
            k += 1
            if c[z]:
                if bits.bits(1) and not abs(c[z]) & one:
                    c[z] += one if c[z] > 0 else -one
            elif run:
                run -= 1
            else:
                c[z] = new
                break
    if not ended:
        return 0
    for z in (base + ZIGZAG[j] for j in range(k, last + 1)):
        if c[z] and bits.bits(1) and not abs(c[z]) & one:
            c[z] += one if c[z] > 0 else -one
    return ended - 1


def _scan(body: bytes, coded: bytes, parts: list[Component], codes: dict[int, list[int]], interval: int, mcus: tuple[int, int], progressive: bool, check: Callable[[], None]) -> None:
    if not body or len(body) != 4 + 2 * body[0]:
        raise Undecodable("JPEG scan header is damaged")
    chosen = []
    for name, tables in zip(body[1 : 1 + 2 * body[0] : 2], body[2 : 2 + 2 * body[0] : 2]):
        found = [p for p in parts if p.name == name]
        if not found:
            raise Undecodable("JPEG scan of an unknown component")
        chosen.append((found[0], codes.get(tables >> 4), codes.get(16 | tables & 15)))
    first, last, high, low = (*body[-3:-1], body[-1] >> 4, body[-1] & 15) if progressive else (0, 63, 0, 0)
    if not chosen or last > 63 or first > last or low > 13 or progressive and ((first == 0) != (last == 0) or first and len(chosen) > 1):
        raise Undecodable("JPEG scan has impossible bounds")
    for part, dc, ac in chosen:
        if (first == 0 and high == 0 and dc is None) or (last > 0 and ac is None):
            raise Undecodable("JPEG scan without its code table")
        part.seen = part.seen or first == 0
    if len(chosen) == 1:
        part = chosen[0][0]
        columns, rows, shapes = part.wide, part.high, [(1, 1)]
    else:
        (columns, rows), shapes = mcus, [(p.h, p.v) for p, _, _ in chosen]
    stretches = _RESTART.split(coded)
    interval = interval or columns * rows
    if len(stretches) != -(-columns * rows // interval):
        raise Undecodable("JPEG scan has too few or too many stretches")
    for number, stretch in enumerate(stretches):
        bits, before, ended = _Bits(stretch), [0] * len(chosen), 0
        for unit in range(number * interval, min((number + 1) * interval, columns * rows)):
            row, column = divmod(unit, columns)
            if not column:
                check()
            for n, ((part, dc, ac), (h, v)) in enumerate(zip(chosen, shapes)):
                for k in range(h * v):
                    base = 64 * ((row * v + k // h) * part.stride + column * h + k % h)
                    c = part.coefficients
                    try:
                        if not progressive:
                            before[n] = _whole_block(bits, c, base, dc, ac, before[n])
                        elif first:
                            ended = (_finer_band if high else _first_band)(bits, c, base, ac, first, last, low, ended)
                        elif high:
                            c[base] |= bits.bits(1) << low
                        else:
                            before[n] += bits.signed(bits.symbol(dc) & 15)
                            c[base] = before[n] * (1 << low)
                    except OverflowError:
                        raise Undecodable("JPEG coefficient is out of range") from None


def _samples(part: Component, width: int, height: int, most_h: int, most_v: int) -> np.ndarray:
    blocks = np.frombuffer(part.coefficients, np.int16).reshape(-1, 8, 8).astype(np.float32) * part.quantiser.reshape(8, 8).astype(np.float32)
    basis = _BASIS.astype(np.float32)
    values = np.clip(np.rint(basis.T @ blocks @ basis + 128), 0, 255).astype(np.uint8)
    plane = values.reshape(-1, part.stride, 8, 8).swapaxes(1, 2).reshape(-1, part.stride * 8)
    rows, columns = np.arange(height) * part.v // most_v, np.arange(width) * part.h // most_h
    return plane[rows][:, columns]


def _rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> list[np.ndarray]:
    y, cb, cr = y.astype(np.float32), cb.astype(np.float32) - 128, cr.astype(np.float32) - 128
    mixed = (y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)
    return [np.clip(np.rint(m), 0, 255).astype(np.uint8) for m in mixed]


def decode(data: bytes, check: Callable[[], None] = lambda: None) -> np.ndarray:
    """RGBA; `check` is called at the start of each row of blocks."""
    frame_end, height, width, header = _frame(data)
    if not width or not height:
        raise Undecodable("JPEG without pixels")
    parts = [Component(header[6 + 3 * k], header[7 + 3 * k] >> 4, header[7 + 3 * k] & 15, header[8 + 3 * k]) for k in range(header[5])]
    if len(parts) not in (1, 3, 4) or any(not 1 <= n <= 4 for p in parts for n in (p.h, p.v)) or len({p.name for p in parts}) < len(parts):
        raise Undecodable("JPEG components are impossible")
    if len(parts) == 1:
        parts[0].h = parts[0].v = 1
    most_h, most_v = max(p.h for p in parts), max(p.v for p in parts)
    mcus = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    for p in parts:
        p.wide, p.high, p.stride = -(-width * p.h // (8 * most_h)), -(-height * p.v // (8 * most_v)), mcus[0] * p.h
        p.coefficients = array("h", bytes(128 * p.stride * mcus[1] * p.v))
    progressive, adobe, interval = False, None, 0
    codes: dict[int, list[int]] = {}
    quantisers: dict[int, np.ndarray] = {}
    for marker, at, body in _segments(data):
        if marker in _FRAMES:
            if at != frame_end:
                raise Undecodable("JPEG with several frames")
            progressive = _FRAMES[marker]
        elif marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                if len(body) < 1 + 64 * wide:
                    raise Undecodable("JPEG quantisation table is too short")
                table = np.zeros(64, np.int32)
                table[ZIGZAG] = np.frombuffer(body, ">u2" if wide == 2 else np.uint8, 64, 1)
                quantisers[body[0] & 15], body = table, body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                count = sum(body[1:17])
                if len(body) < 17 + count:
                    raise Undecodable("JPEG code table is too short")
                codes[body[0]], body = _code_table(body[1:17], body[17 : 17 + count]), body[17 + count :]
        elif marker == 0xDD and len(body) >= 2:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif marker == 0xDA:
            _scan(body, data[at : _END.search(data, at).start()] if _END.search(data, at) else b"", parts, codes, interval, mcus, progressive, check)
            for p in parts:  # the table that stands when a component is first read counts
                if p.seen and p.quantiser is None:
                    p.quantiser = quantisers.get(p.table)
    if any(p.quantiser is None for p in parts):
        raise Undecodable("JPEG lacks a component or its quantisation table")
    planes = [_samples(p, width, height, most_h, most_v) for p in parts]
    rgba = np.full((height, width, 4), 255, np.uint8)
    if len(parts) == 1:
        colours = planes * 3
    elif len(parts) == 3:
        plain = adobe == 0 or (adobe is None and bytes(p.name for p in parts) == b"RGB")
        colours = planes if plain else _rgb(*planes)
    else:  # inks are stored inverted, as the makers of such files do
        inks = [255 - c for c in _rgb(*planes[:3])] if adobe == 2 else planes[:3]
        colours = [(i.astype(np.uint16) * planes[3] + 127) // 255 for i in inks]
    for k, c in enumerate(colours):
        rgba[:, :, k] = c
    return rgba


def code_lengths(counts: Counter) -> list[tuple[int, int]]:
    """(length, symbol) in order of codes: Huffman codes of at most 16 bits, none of which is all ones."""
    heap = [(n, k, (s,)) for k, (s, n) in enumerate(sorted(counts.items()))] + [(0, 999, (-1,))]
    depth = dict.fromkeys([*counts, -1], 0)
    heapq.heapify(heap)
    number = 1000
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            depth[s] += 1
        number += 1
        heapq.heappush(heap, (n + m, number, a + b))
    per = Counter(depth.values())
    for length in range(max(per), 16, -1):
        while per[length]:  # two leaves move up: one to their parent's place, the other beside a shorter code
            shorter = max(k for k in range(1, length - 1) if per[k])
            per[length] -= 2
            per[length - 1] += 1
            per[shorter] -= 1
            per[shorter + 1] += 2
    lengths = sorted(k for k, n in per.items() for _ in range(n))
    by_use = sorted(counts, key=lambda s: (-counts[s], s))
    return list(zip(lengths, by_use))  # the reserved symbol has the last, longest code


def quality_table(table: tuple[int, ...], quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * scale + 50) // 100, 1, 255)


def quantised(rgba: np.ndarray, tables: list[np.ndarray]) -> list[np.ndarray]:
    """Coefficients (block rows, block columns, 64 in natural order) of Y, Cb and Cr."""
    h, w = rgba.shape[:2]
    padded = np.pad(rgba[:, :, :3], ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge").astype(np.float64)
    r, g, b = (padded[:, :, k] for k in range(3))
    planes = (0.299 * r + 0.587 * g + 0.114 * b - 128, -0.168736 * r - 0.331264 * g + 0.5 * b, 0.5 * r - 0.418688 * g - 0.081312 * b)
    out = []
    for plane, table in zip(planes, tables):
        blocks = plane.reshape(plane.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)
        moved = _BASIS @ blocks @ _BASIS.T
        out.append(np.rint(moved.reshape(*moved.shape[:2], 64) / table).astype(int))
    return out


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _amplitude(value: int) -> tuple[int, int]:
    size = abs(value).bit_length()
    return size, value if value > 0 else value + (1 << size) - 1


class Scan:
    """Symbols with extra bits, gathered first and coded once their counts are known."""

    def __init__(self) -> None:
        self.parts: list[tuple[int, int, int, int]] = []  # table, symbol, bits, number of bits
        self.counts: dict[int, Counter] = {}

    def add(self, table: int, symbol: int, extra: int = 0, size: int = 0) -> None:
        self.parts.append((table, symbol, extra, size))
        if symbol >= 0:
            self.counts.setdefault(table, Counter())[symbol] += 1

    def coded(self) -> tuple[bytes, bytes]:
        """The segments of code tables, and the coded bits with stuffing; symbol -1 stands for bare bits."""
        tables, codes = b"", {}
        for table, counts in sorted(self.counts.items()):
            ordered, code, before = code_lengths(counts), 0, 0
            for length, symbol in ordered:
                code <<= length - before
                codes[table, symbol] = code, length
                code, before = code + 1, length
            per = Counter(length for length, _ in ordered)
            tables += segment(0xC4, bytes([table, *(per[k] for k in range(1, 17))]) + bytes(s for _, s in ordered))
        out, held, n = bytearray(), 0, 0
        for table, symbol, extra, size in self.parts:
            code, length = codes[table, symbol] if symbol >= 0 else (0, 0)
            held, n = (held << length | code) << size | extra, n + length + size
            if n >= 64:
                out += (held >> n % 8).to_bytes(n // 8, "big")
                held, n = held & (1 << n % 8) - 1, n % 8
        if n:
            out += (held << -n % 8 | (1 << -n % 8) - 1).to_bytes((n + 7) // 8, "big")
        return tables, bytes(out).replace(b"\xff", b"\xff\x00")


def encode(rgba: np.ndarray, quality: int = 75) -> bytes:
    """A sequential file in Y, Cb, Cr without subsampling, with codes made for it; alpha is dropped."""
    h, w = rgba.shape[:2]
    if not 0 < h < 65536 or not 0 < w < 65536:
        raise Undecodable("JPEG can't have these dimensions")
    tables = [quality_table(LUMINANCE, quality), quality_table(CHROMINANCE, quality)]
    parts = quantised(rgba, [tables[0], tables[1], tables[1]])
    scan, before = Scan(), [0, 0, 0]
    rows, columns = parts[0].shape[:2]
    ordered = [p[:, :, ZIGZAG].reshape(-1, 64) for p in parts]
    for unit in range(rows * columns):
        for n, blocks in enumerate(ordered):
            block, kind = blocks[unit], min(n, 1)
            dc = int(block[0])
            size, extra = _amplitude(dc - before[n])
            before[n] = dc
            scan.add(kind, size, extra, size)
            last = 0
            for k in (np.flatnonzero(block[1:]) + 1).tolist():
                run, last = k - last - 1, k
                for _ in range(run // 16):
                    scan.add(16 | kind, 0xF0)
                size, extra = _amplitude(int(block[k]))
                scan.add(16 | kind, run % 16 << 4 | size, extra, size)
            if last < 63:
                scan.add(16 | kind, 0)
    codes, coded = scan.coded()
    return header(w, h, tables, 0xC0) + codes + segment(0xDA, b"\x03\x01\x00\x02\x11\x03\x11\x00\x3f\x00") + coded + b"\xff\xd9"


def header(w: int, h: int, tables: list[np.ndarray], frame: int) -> bytes:
    quantisers = b"".join(segment(0xDB, bytes([k]) + bytes(t[ZIGZAG].tolist())) for k, t in enumerate(tables))
    parts = b"".join(bytes([k + 1, 0x11, min(k, 1)]) for k in range(3))
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + quantisers + segment(frame, struct.pack(">BHHB", 8, h, w, 3) + parts)
