"""ISO base media (MP4, M4A, MOV) and EBML (WebM, Matroska)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from . import Cleaned, Malformed

# Atoms that begin a file, are dropped, are walked into; and how deep and far.
FIRST_ATOMS = (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"styp")
DROPPED_ATOMS = (b"udta", b"meta", b"free", b"skip", b"wide", b"uuid", b"pdin")
NESTED_ATOMS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"sinf", b"mvex", b"moof", b"traf")
ATOM_DEPTH, ATOMS = 32, 4096
# EBML ids, and how many elements are looked at.
EBML, SEGMENT = 0x1A45DFA3, 0x18538067
DROPPED_ELEMENTS = {0x1254C367, 0x1941A469, 0x1043A770}  # tags, attachments, chapters
TOP_ELEMENTS, ELEMENTS, UNKNOWN_SIZE = 16, 65536, 500 * 1024 * 1024


def _clean_level(data: bytes, depth: int) -> tuple[bytes, int, int]:
    if depth > ATOM_DEPTH:
        raise Malformed("Video", "MP4 atoms are nested too deeply")
    out, stripped, cut, at = [], 0, 0, 0
    for _ in range(ATOMS):
        left = len(data) - at
        if left < 8:
            cut += left
            break
        size, name = struct.unpack_from(">I4s", data, at)
        head, whole = 8, size
        if size == 1:
            if left < 16:
                raise Malformed("Video", "MP4 atom without its 64-bit size")
            head, whole = 16, int.from_bytes(data[at + 8 : at + 16], "big")
        to_end = whole == 0
        if to_end and name in NESTED_ATOMS:
            raise Malformed("Video", "MP4 container atom of size 0")
        end = len(data) if to_end else at + whole
        if end > len(data) or (not to_end and whole < head):
            raise Malformed("Video", f"MP4 atom of size {whole} with {left} bytes left")
        if name in DROPPED_ATOMS:
            stripped, cut = stripped + 1, cut + end - at
        elif name in NESTED_ATOMS:
            inner, n, gone = _clean_level(data[at + head : end], depth + 1)
            stripped, cut = stripped + n, cut + gone
            size = head + len(inner)
            out.append((struct.pack(">I4s", size, name) if head == 8 else struct.pack(">I4sQ", 1, name, size)) + inner)
        else:
            out.append(data[at:end])
        at = end
    return b"".join(out), stripped, cut


def _atoms(data: bytes, start: int, end: int, walk: bool) -> Iterator[tuple[bytes, int, int, int]]:
    """(name, start, body, end) of the atoms, with those inside containers if `walk`."""
    while start + 8 <= end:
        size, name = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            head, size = 16, int.from_bytes(data[start + 8 : start + 16], "big")
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield name, start, start + head, start + size
        if walk and name in NESTED_ATOMS:
            yield from _atoms(data, start + head, start + size, walk)
        start += size


def _data_start(data: bytes) -> int | None:
    return next((start for name, start, _, _ in _atoms(data, 0, len(data), False) if name == b"mdat"), None)


def mp4(data: bytes) -> Cleaned | None:
    """Without metadata atoms; chunk offsets of top-level stco and co64 atoms follow the media data.

    Offset tables inside moov stay as they were: the rebuilt file is checked by reading it again, which fails closed
    where that matters. `mp4_with_offsets` moves those too.
    """
    return _mp4(data, False)


def mp4_with_offsets(data: bytes) -> Cleaned | None:
    return _mp4(data, True)


def _mp4(data: bytes, walk: bool) -> Cleaned | None:
    if len(data) < 8 or data[4:8] not in FIRST_ATOMS:
        return None
    clean, stripped, cut = _clean_level(data, 0)
    if all(name not in (b"moov", b"moof", b"mdat") for name, *_ in _atoms(data, 0, len(data), False)):
        raise Malformed("Video", "MP4 without a movie or media data")
    before, after = _data_start(data), _data_start(clean)
    if before is not None and after is not None and before != after:
        moved = bytearray(clean)
        for name, _, body, end in list(_atoms(clean, 0, len(clean), walk)):
            if name in (b"stco", b"co64") and body + 8 <= end:
                form, width = (">I", 4) if name == b"stco" else (">Q", 8)
                count = struct.unpack_from(">I", clean, body + 4)[0]
                if body + 8 + count * width <= end:
                    for k in range(count):
                        place = body + 8 + k * width
                        value = struct.unpack_from(form, clean, place)[0] - (before - after)
                        struct.pack_into(form, moved, place, value % (1 << 8 * width))
        clean = bytes(moved)
    return Cleaned(clean, "video/mp4", stripped, cut)


def vint_length(first: int) -> int:
    if not first:
        raise Malformed("Video", "EBML number begins with 0")
    return 9 - first.bit_length()


def vint_id(data: bytes, at: int) -> tuple[int, int]:
    """The id with its marker bits, and its length."""
    if at >= len(data):
        raise Malformed("Video", "EBML id is cut off")
    n = vint_length(data[at])
    if at + n > len(data):
        raise Malformed("Video", "EBML id is cut off")
    return int.from_bytes(data[at : at + n], "big") & 0xFFFFFFFF, n


def vint_size(data: bytes, at: int) -> tuple[int | None, int]:
    """The size (None: unknown) and its length."""
    if at >= len(data):
        raise Malformed("Video", "EBML size is cut off")
    n = vint_length(data[at])
    if at + n > len(data):
        raise Malformed("Video", "EBML size is cut off")
    most = (1 << 7 * n) - 1
    value = int.from_bytes(data[at : at + n], "big") & most
    return (None if value == most else value), n


def write_vint(value: int, n: int) -> bytes:
    return (value | 1 << 7 * n).to_bytes(n, "big")


def _clean_segment(data: bytes, at: int, end: int) -> tuple[bytes, int, int]:
    out, stripped, cut = [], 0, 0
    for _ in range(ELEMENTS):
        if at >= end or at + 2 > len(data):
            break
        name, a = vint_id(data, at)
        if at + a >= len(data):
            break
        size, b = vint_size(data, at + a)
        body = at + a + b
        stop = body + (min(max(0, end - body), UNKNOWN_SIZE) if size is None else size)
        if size is not None and stop > end:
            raise Malformed("Video", f"WebM element {name:X} reaches beyond its segment")
        if name in DROPPED_ELEMENTS:
            stripped, cut = stripped + 1, cut + stop - at
        else:
            out.append(data[at:stop])
        at = stop
    return b"".join(out), stripped, cut


def webm(data: bytes) -> Cleaned | None:
    """Without tags, attachments and chapters; a segment of known size gets its new one in as many bytes.

    Without a segment it is no film, and with more top-level elements than are looked at it would come out cut: both are malformed.
    """
    if data[:4] != EBML.to_bytes(4, "big"):
        return None
    out, stripped, cut, at, segments = [], 0, 0, 0, 0
    for _ in range(TOP_ELEMENTS):
        if at >= len(data):
            break
        name, a = vint_id(data, at)
        size, b = vint_size(data, at + a)
        body = at + a + b
        end = len(data) if size is None else body + size
        if end > len(data):
            raise Malformed("Video", "WebM element reaches beyond the end")
        if name == SEGMENT:
            inner, n, gone = _clean_segment(data, body, end)
            stripped, cut, segments = stripped + n, cut + gone, segments + 1
            out += [data[at : at + a], data[at + a : body] if size is None else write_vint(len(inner), b), inner]
        else:
            out.append(data[at:end])
        at = end
    if not segments:
        raise Malformed("Video", "WebM without a segment")
    if at < len(data):
        raise Malformed("Video", f"WebM with more than {TOP_ELEMENTS} top-level elements")
    return Cleaned(b"".join(out), "video/webm", stripped, cut)
