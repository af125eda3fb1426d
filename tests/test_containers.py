import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weir.operators.codecs import Undecodable, bmp, gif, png
from weir.operators.containers import Malformed, apng, audio, video
from weir.plans.policy import STANDARD

from . import builders as B

LIMITS = STANDARD["animated_image"]


def test_mp3():
    c = audio.mp3(B.mp3())
    assert (c.data, c.stripped, c.stripped_bytes, c.mime) == (B.mp3(False), 2, 148, "audio/mpeg")
    assert audio.mp3(B.mp3(False)).stripped == 0 and audio.mp3(b"plain text") is None
    both = B.mp3(False) + b"TAG+" + b"z" * 223 + b"TAG" + b"a" * 125
    assert audio.mp3(both).data == B.mp3(False)
    for bad in (b"ID3\x03\x00\x00\x7f\x7f\x7f\x7f", b"", b"\xff\xfb"):
        with pytest.raises(Malformed):
            audio.mp3(bad)


def test_wav():
    c = audio.wav(B.wav())
    assert c.data == B.wav(extra=b"") and (c.stripped, c.stripped_bytes) == (1, 13)
    assert audio.wav(b"RIFF") is None and audio.wav(B.wav() + b"tail") is not None
    for bad in (B.wav()[:-3], b"RIFF\0\0\0\0WAVE", b"RIFF\0\0\0\0WAVEfmt \x02\0\0\0ab"):
        with pytest.raises(Malformed):
            audio.wav(bad)


def test_flac():
    c = audio.flac(B.flac())
    assert c.data == b"fLaC\x80\x00\x00\x22" + b"i" * 34 + b"\xff\xf8frames" and (c.stripped, c.stripped_bytes) == (2, 19)
    for bad in (b"fLaC\x84\0\0\1xframes", b"fLaC\x80\0\0\x22" + b"i" * 34, b"fLaC\0\0\0\x22" + b"i" * 10):
        with pytest.raises(Malformed):
            audio.flac(bad)


def test_ogg():
    data = B.ogg()
    c = audio.ogg(data)
    assert b"artist" not in c.data and b"more tags" not in c.data and c.note == "opus" and c.mime == "audio/opus"
    assert c.stripped_bytes == 8 + 270 + 9 and c.data.count(b"OggS") == 5
    at = c.data.index(b"OpusTags") - 28
    page = c.data[at : at + 28 + 16]
    assert struct.unpack("<I", page[22:26])[0] == audio.ogg_crc32(page[:22] + b"\0\0\0\0" + page[26:])
    assert audio.ogg(c.data).data == c.data
    for bad in (data[:-1], data + b"x", data[:4] + b"\x01" + data[5:], data + b"OggX" + b"\0" * 30):
        with pytest.raises(Malformed):
            audio.ogg(bad)


def test_ogg_checksum_of_a_known_value():
    assert audio.ogg_crc32(b"") == 0 and audio.ogg_crc32(b"\x01") == 0x04C11DB7


def test_mp4():
    c = video.mp4(B.mp4())
    assert b"private" not in c.data and b"who" not in c.data and c.stripped == 3 and c.data.endswith(b"m" * 50)
    assert video.mp4(c.data).data == c.data and video.mp4(b"nothing here") is None
    for bad in (B.atom(b"ftyp", b"isom") + b"\0\0\xff\xffmdat", B.atom(b"ftyp", b"") + b"\0\0\0\0moov", B.atom(b"ftyp", b"") + b"\0\0\0\1mdat"):
        with pytest.raises(Malformed):
            video.mp4(bad)
    deep = b""
    for _ in range(40):
        deep = B.atom(b"moov", deep)
    with pytest.raises(Malformed):
        video.mp4(deep)


def test_mp4_offsets():
    table = lambda at: B.atom(b"stco", b"\0\0\0\0" + struct.pack(">II", 1, at))
    inside = lambda at: B.atom(b"moov", B.atom(b"trak", B.atom(b"mdia", B.atom(b"minf", B.atom(b"stbl", table(at))))))
    data = B.atom(b"ftyp", b"isom") + inside(100) + B.atom(b"free", b"x" * 12) + table(100) + B.atom(b"mdat", b"m")
    plain, moved = video.mp4(data).data, video.mp4_with_offsets(data).data
    assert plain == B.atom(b"ftyp", b"isom") + inside(100) + table(80) + B.atom(b"mdat", b"m")
    assert moved == B.atom(b"ftyp", b"isom") + inside(80) + table(80) + B.atom(b"mdat", b"m")


def test_webm():
    c = video.webm(B.webm())
    assert b"tags!" not in c.data and c.stripped == 1 and c.stripped_bytes == 10 and video.webm(c.data).data == c.data
    unknown = B.element(b"\x1a\x45\xdf\xa3", b"x") + b"\x18\x53\x80\x67\xff" + B.element(b"\x12\x54\xc3\x67", b"tags!") + B.element(b"\x1f\x43\xb6\x75", b"c")
    assert video.webm(unknown).data == unknown[:6] + unknown[6:11] + B.element(b"\x1f\x43\xb6\x75", b"c")
    for bad in (b"\x1a\x45\xdf\xa3\x00", B.webm()[:-2], b"\x1a\x45\xdf\xa3"):
        with pytest.raises(Malformed):
            video.webm(bad)
    assert video.vint_size(b"\x81", 0) == (1, 1) and video.vint_size(b"\xff", 0) == (None, 1) and video.vint_size(b"\x40\x05", 0) == (5, 2)
    assert video.write_vint(5, 2) == b"\x40\x05"


def test_films_need_their_parts():
    head = B.element(b"\x1a\x45\xdf\xa3", b"x")
    void = B.element(b"\xec", b"y")
    segment = B.element(b"\x18\x53\x80\x67", b"", True)
    assert video.webm(head + void * 14 + segment).data == head + void * 14 + segment
    for bad in (head, head + void * 3, head + segment + void * 15):  # the last would lose its end
        with pytest.raises(Malformed):
            video.webm(bad)
    with pytest.raises(Malformed):
        video.mp4(B.atom(b"ftyp", b"isom") + b"trail")
    assert video.mp4(B.atom(b"ftyp", b"isom") + B.atom(b"mdat", b"m")).stripped == 0


def test_apng():
    c = apng.apng(B.animated() + b"trailing", LIMITS)
    assert b"secret" not in c.data and b"trailing" not in c.data and c.mime == "image/apng" and c.stripped == 1 and c.stripped_bytes == 20
    assert apng.apng(B.still(text=b"x"), LIMITS).mime == "image/png"
    crc = B.animated().replace(b"secret", b"public")
    zero = B.animated(declared=0)
    wide = B.PNG + B.chunk(b"IHDR", struct.pack(">IIBBBBB", 50000, 50000, 8, 2, 0, 0, 0)) + B.chunk(b"IEND")
    depth = B.PNG + B.chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 4, 2, 0, 0, 0)) + B.chunk(b"IEND")
    for bad in (crc, zero, wide, depth, B.animated()[:-5], b"GIF89a", B.animated(declared=301)):
        with pytest.raises(Malformed):
            apng.apng(bad, LIMITS)
    with pytest.raises(Malformed):
        apng.apng(B.animated(), {**LIMITS, "max_chunks": 3})


WALKERS = [audio.mp3, audio.wav, audio.flac, audio.ogg, video.mp4, video.webm, lambda d: apng.apng(d, LIMITS)]
SEEDS = [B.mp3(), B.wav(), B.flac(), B.ogg(), B.mp4(), B.webm(), B.animated()]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(range(len(SEEDS))), st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 255)), max_size=6), st.integers(0, 10**6), st.binary(max_size=12))
def test_walkers_survive_damage(which, changes, cut, tail):
    data = bytearray(SEEDS[which])
    for at, value in changes:
        data[at % len(data)] = value
    data = bytes(data[: cut % (len(data) + 1)]) + tail
    for walk in WALKERS:
        try:
            c = walk(data)
        except Malformed:
            continue
        assert c is None or len(c.data) <= len(data) + 64


@pytest.mark.parametrize("alpha", [False, True])
def test_png_round_trip(alpha):
    p = B.pixels(17, 9, 3, alpha)
    assert (png.decode(png.encode(p)) == p).all()


def png_of(width, height, depth, colour, raw, extra=b"", interlaced=0):
    import zlib

    return B.PNG + B.chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)) + extra + B.chunk(b"IDAT", zlib.compress(raw)) + B.chunk(b"IEND")


def test_png_variants():
    assert png.decode(png_of(8, 1, 1, 0, b"\0\xaa"))[0, :, 0].tolist() == [255, 0] * 4
    assert png.decode(png_of(2, 1, 2, 0, b"\0\x60"))[0, :, 0].tolist() == [85, 170]
    two = png_of(2, 1, 8, 3, b"\0\x01\x00", B.chunk(b"PLTE", bytes(range(6))) + B.chunk(b"tRNS", b"\x07"))
    assert png.decode(two).tolist() == [[[3, 4, 5, 255], [0, 1, 2, 7]]]
    assert png.decode(png_of(1, 1, 16, 2, b"\0" + bytes([1, 2, 3, 4, 5, 6])))[0, 0].tolist() == [1, 3, 5, 255]
    assert png.decode(png_of(1, 1, 8, 4, b"\0\x09\x08"))[0, 0].tolist() == [9, 9, 9, 8]
    assert png.decode(png_of(1, 1, 8, 2, b"\0\1\2\3", B.chunk(b"tRNS", bytes([0, 1, 0, 2, 0, 3]))))[0, 0].tolist() == [1, 2, 3, 0]
    filters = bytes([1, 10, 10, 10]) + bytes([2, 1, 1, 1]) + bytes([3, 1, 1, 1]) + bytes([4, 1, 1, 1])
    assert png.decode(png_of(3, 4, 8, 0, filters))[:, :, 0].tolist() == [[10, 20, 30], [11, 21, 31], [6, 14, 23], [7, 15, 24]]
    full = np.arange(64, dtype=np.uint8).reshape(8, 8)
    passes = b"".join(b"".join(b"\0" + row.tobytes() for row in full[y::dy, x::dx]) for x, y, dx, dy in png._ADAM7)
    assert (png.decode(png_of(8, 8, 8, 0, passes, interlaced=1))[:, :, 0] == full).all()
    for bad in (png_of(4, 4, 8, 0, b"\0"), png_of(1, 1, 8, 3, b"\0\0"), png_of(1, 1, 8, 0, b"\x09\0"), B.still()[:30], B.still()[:-4] + b"\0\0\0\0"):
        with pytest.raises(Undecodable):
            png.decode(bad)


def test_gif_round_trip():
    shots = gif.frames(B.moving(comment=b"hidden"), 500, 10**6)
    data = gif.encode(8, 6, shots)
    again = gif.frames(data, 500, 10**6)
    assert len(again) == 4 and b"hidden" not in data and all((a.rgba == b.rgba).all() and a.delay == b.delay for a, b in zip(shots, again))
    big = gif.Frame(1, 2, B.pixels(60, 50, 1), 5)
    out = gif.frames(gif.encode(64, 64, [big]), 1, 10**6)[0]
    assert out.rgba.shape == (50, 60, 4) and (out.left, out.top) == (1, 2)
    clear = np.zeros((5, 5, 4), np.uint8)
    clear[2, 2] = (9, 8, 7, 255)
    assert (gif.frames(gif.encode(5, 5, [gif.Frame(0, 0, clear, 5)]), 1, 100)[0].rgba == clear).all()
    for bad in (B.moving()[:-30], b"GIF89a", B.moving()[:40]):
        with pytest.raises(Undecodable):
            gif.frames(bad, 500, 10**6)
    with pytest.raises(Undecodable):
        gif.frames(B.moving(), 3, 10**6)


def test_bmp():
    p = B.pixels(5, 4, 2)
    assert (bmp.decode(B.bmp(p)) == p).all()
    with pytest.raises(Undecodable):
        bmp.decode(B.bmp(p)[:-8])


def test_apng_frames():
    assert len(png.decode_frames(B.animated(3))) == 3
    with pytest.raises(Undecodable):
        png.decode_frames(B.animated(2, declared=3))
    with pytest.raises(Undecodable):
        png.decode_frames(B.still())
