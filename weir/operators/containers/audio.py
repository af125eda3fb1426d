"""MP3, WAV, FLAC and Ogg."""

from __future__ import annotations

import struct

from . import Cleaned, Malformed

# Most WAV chunks, FLAC metadata blocks and Ogg pages that are looked at.
WAV_CHUNKS, FLAC_BLOCKS, OGG_PAGES = 1024, 256, 65536


def mp3(data: bytes) -> Cleaned | None:
    """Without the leading ID3v2 tag and the trailing ID3v1 and extended tags; frames have to begin with a sync word."""
    head, cut, tags = 0, 0, 0
    if data[:3] == b"ID3" and len(data) >= 10:
        a, b, c, d = data[6:10]
        head = 10 + ((a << 21) | (b << 14) | (c << 7) | d)
        if head > len(data):
            raise Malformed("Audio", "ID3v2 tag reaches beyond the end")
        tags, cut = 1, head
    tail = len(data)
    for size, mark in ((128, b"TAG"), (227, b"TAG+")):
        if tail - size >= head and data.startswith(mark, tail - size):
            tail, tags, cut = tail - size, tags + 1, cut + size
    frames = data[head:tail]
    if len(frames) < 4:
        raise Malformed("Audio", "no audio frames beside the tags")
    if frames[0] != 0xFF or frames[1] & 0xE0 != 0xE0:
        return None
    return Cleaned(frames, "audio/mpeg", tags, cut)


def wav(data: bytes) -> Cleaned | None:
    """Only the fmt and data chunks, each padded to an even length."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    kept, names, stripped, cut, at = [], set(), 0, 0, 12
    for _ in range(WAV_CHUNKS):
        if at + 8 > len(data):
            break
        name, size = struct.unpack_from("<4sI", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise Malformed("Audio", "WAV chunk reaches beyond the end")
        if name in (b"fmt ", b"data"):
            names.add(name)
            kept.append(struct.pack("<4sI", name, size) + body + b"\0" * (size & 1))
        else:
            stripped, cut = stripped + 1, cut + 8 + size
        at += 8 + size + (size & 1)
    if len(names) < 2:
        raise Malformed("Audio", "WAV without fmt or data chunk")
    body = b"WAVE" + b"".join(kept)
    return Cleaned(b"RIFF" + struct.pack("<I", len(body) & 0xFFFFFFFF) + body, "audio/wav", stripped, cut)


def flac(data: bytes) -> Cleaned | None:
    """STREAMINFO as the only metadata block, then the frames."""
    if len(data) < 8 or data[:4] != b"fLaC":
        return None
    info, stripped, cut, at, last = None, 0, 0, 4, False
    for _ in range(FLAC_BLOCKS):
        if at + 4 > len(data):
            raise Malformed("Audio", "FLAC block header is cut off")
        flags, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        if at + 4 + size > len(data):
            raise Malformed("Audio", "FLAC block reaches beyond the end")
        if flags & 0x7F == 0:
            info = data[at + 4 : at + 4 + size]
        else:
            stripped, cut = stripped + 1, cut + 4 + size
        at, last = at + 4 + size, bool(flags & 0x80)
        if last:
            break
    if info is None:
        raise Malformed("Audio", "FLAC without STREAMINFO")
    if not last or at >= len(data):
        raise Malformed("Audio", "FLAC without frames")
    return Cleaned(b"fLaC\x80" + len(info).to_bytes(3, "big") + info + data[at:], "audio/flac", stripped, cut)


def _ogg_table() -> list[int]:
    out = []
    for value in range(256):
        value <<= 24
        for _ in range(8):
            value = ((value << 1) ^ (0x04C11DB7 if value >> 31 else 0)) & 0xFFFFFFFF
        out.append(value)
    return out


_OGG = _ogg_table()


def ogg_crc32(data: bytes) -> int:
    """Polynomial 0x04C11DB7, not reflected, from 0."""
    crc = 0
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _OGG[(crc >> 24) ^ b]
    return crc


# Codecs by their first packet, with the start of the comment packet and an empty one.
_EMPTY = struct.pack("<II", 0, 0)
OGG_CODECS = {"opus": (b"OpusHead", b"OpusTags", b"OpusTags" + _EMPTY), "vorbis": (b"\x01vorbis", b"\x03vorbis", b"\x03vorbis" + _EMPTY + b"\x01")}


def ogg_page(head: bytes, body: bytes) -> bytes:
    """A page with the given first 22 header bytes and a fresh checksum."""
    lacing = b"\xff" * (len(body) // 255) + bytes([len(body) % 255])
    rest = bytes([len(lacing)]) + lacing + body
    return head[:22] + struct.pack("<I", ogg_crc32(head[:22] + b"\0\0\0\0" + rest)) + rest


def ogg(data: bytes) -> Cleaned | None:
    """Comment pages replaced by empty ones, their continuation pages dropped."""
    if len(data) < 27 or data[:4] != b"OggS":
        return None
    out, codec, cut, at, dropping = [], None, 0, 0, False
    for _ in range(OGG_PAGES):
        if at >= len(data):
            break
        if at + 27 > len(data):
            raise Malformed("Audio", "Ogg page header is cut off")
        if data[at : at + 4] != b"OggS":
            raise Malformed("Audio", f"no Ogg page at {at}")
        if data[at + 4]:
            raise Malformed("Audio", f"Ogg version {data[at + 4]}")
        flags, start = data[at + 5], at + 27 + data[at + 26]
        if start > len(data):
            raise Malformed("Audio", "Ogg segment table is cut off")
        end = start + sum(data[at + 27 : start])
        if end > len(data):
            raise Malformed("Audio", "Ogg page reaches beyond the end")
        body = data[start:end]
        if flags & 2 and codec is None:
            codec = next((c for c, (first, _, _) in OGG_CODECS.items() if body.startswith(first)), None)
        if dropping and flags & 1:
            cut += len(body)
        else:
            dropping = codec is not None and body.startswith(OGG_CODECS[codec][1])
            if dropping:
                cut += len(body)
                out.append(ogg_page(data[at : at + 26], OGG_CODECS[codec][2]))
            else:
                out.append(data[at:end])
        at = end
    return Cleaned(b"".join(out), "audio/opus" if codec == "opus" else "audio/ogg", 0, cut, codec or "unknown")
