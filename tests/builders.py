"""Small media files, made here; nothing is stored."""

import struct
import zlib

import numpy as np

from weir.operators.codecs import gif, png
from weir.operators.containers.audio import ogg_page

PNG = b"\x89PNG\r\n\x1a\n"


def chunk(name, body=b"", crc=None):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body) if crc is None else crc)


def pixels(width=8, height=6, seed=0, alpha=False):
    rng = np.random.default_rng(seed)
    out = rng.integers(0, 256, (height, width, 4), dtype=np.uint8)
    if not alpha:
        out[:, :, 3] = 255
    return out


def still(seed=0, text=b"", width=8, height=6):
    data = png.encode(pixels(width, height, seed))
    return data[:-12] + (chunk(b"tEXt", b"Comment\0" + text) if text else b"") + data[-12:]


def animated(frames=2, text=b"secret", width=4, height=3, declared=None):
    lines = b"".join(b"\0" + bytes(range(3 * width)) for _ in range(height))
    out = [PNG, chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)), chunk(b"acTL", struct.pack(">II", frames if declared is None else declared, 0))]
    if text:
        out.append(chunk(b"tEXt", b"k\0" + text))
    number = 0
    for k in range(frames):
        out.append(chunk(b"fcTL", struct.pack(">IIIIIHHBB", number, width, height, 0, 0, 1, 10, 0, 0)))
        number += 1
        if k:
            out.append(chunk(b"fdAT", struct.pack(">I", number) + zlib.compress(lines)))
            number += 1
        else:
            out.append(chunk(b"IDAT", zlib.compress(lines)))
    return b"".join(out) + chunk(b"IEND")


def moving(frames=4, delay=10, width=8, height=6, comment=b""):
    shots = []
    for k in range(frames):
        p = np.full((height, width, 4), 255, np.uint8)
        p[:, :, :3] = (np.arange(width * height * 3).reshape(height, width, 3) * 5 + k) % 7 * 30
        shots.append(gif.Frame(0, 0, p, delay))
    data = gif.encode(width, height, shots)
    return data[:13] + b"\x21\xfe" + bytes([len(comment)]) + comment + b"\0" + data[13:] if comment else data


def wav(samples=200, channels=1, rate=8000, extra=b"LIST"):
    form = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * 2, channels * 2, 16)
    body = b"WAVE" + b"fmt " + struct.pack("<I", 16) + form + (extra + struct.pack("<I", 5) + b"hello\0" if extra else b"")
    data = bytes(k % 256 for k in range(samples * channels * 2))
    body += b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def mp3(tags=True):
    frame = b"\xff\xfb\x90\x00" + b"\x11" * 413
    return (b"ID3\x03\x00\x00\x00\x00\x00\x0a" + b"t" * 10 if tags else b"") + frame + (b"TAG" + b"a" * 125 if tags else b"")


def flac():
    return b"fLaC\x00\x00\x00\x22" + b"i" * 34 + b"\x04\x00\x00\x08comments" + b"\x86\x00\x00\x03pic" + b"\xff\xf8frames"


def ogg(pages=3):
    head = lambda flags, n: b"OggS\x00" + bytes([flags]) + b"\0" * 8 + b"seri" + struct.pack("<I", n)
    return ogg_page(head(2, 0), b"OpusHead" + b"h" * 11) + ogg_page(head(0, 1), b"OpusTags" + b"artist=me" * 30) + ogg_page(head(1, 2), b"more tags") + b"".join(ogg_page(head(0, 3 + k), b"audio" * 60) for k in range(pages))


def atom(name, body):
    return struct.pack(">I", 8 + len(body)) + name + body


def mp4(brand=b"isom"):
    moov = atom(b"moov", atom(b"mvhd", b"h" * 20) + atom(b"trak", atom(b"tkhd", b"k" * 12) + atom(b"udta", b"who")) + atom(b"udta", b"private"))
    return atom(b"ftyp", brand + b"\0\0\0\0") + moov + atom(b"free", b"f" * 9) + atom(b"mdat", b"m" * 50)


def element(name, body, wide=False):
    size = struct.pack(">I", len(body) | 0x10000000) if wide else bytes([0x80 | len(body)])
    return name + size + body


def webm():
    inside = element(b"\x15\x49\xa9\x66", b"info") + element(b"\x16\x54\xae\x6b", b"tracks") + element(b"\x12\x54\xc3\x67", b"tags!") + element(b"\x1f\x43\xb6\x75", b"cluster")
    return element(b"\x1a\x45\xdf\xa3", b"\x42\x82\x84webm") + element(b"\x18\x53\x80\x67", inside, True)


def bmp(rgba):
    h, w = rgba.shape[:2]
    stride = (w * 3 + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * 3] = rgba[::-1, :, 2::-1].reshape(h, -1)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 0, 0, 0, 0) + rows.tobytes()
