import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weir.operators.codecs import Undecodable, jpeg, tiff
from weir.operators.rebuild import one
from weir.plans.policy import STANDARD


def smooth(height=37, width=53):
    y, x = np.mgrid[0:height, 0:width]
    out = np.full((height, width, 4), 255, np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2] = y * 5, x * 4, (x + y) * 2
    return out


def shifted(value, low):
    return value >> low if value >= 0 else -(-value >> low)


def progressive(rgba):
    """Bits of coefficients in five scans each: DC and its last bit, two bands, and the last bit of all of them."""
    h, w = rgba.shape[:2]
    tables = [np.full(64, 4), np.full(64, 6)]
    parts = [p[:, :, jpeg.ZIGZAG].reshape(-1, 64).tolist() for p in jpeg.quantised(rgba, [tables[0], tables[1], tables[1]])]
    out = jpeg.header(w, h, tables, 0xC2)

    def scan(made, head):
        codes, coded = made.coded()
        return codes + jpeg.segment(0xDA, head) + coded

    dc, before = jpeg.Scan(), [0, 0, 0]
    for unit in range(len(parts[0])):
        for n, p in enumerate(parts):
            value = p[unit][0] >> 1
            size, extra = jpeg._amplitude(value - before[n])
            before[n] = value
            dc.add(0, size, extra, size)
    out += scan(dc, b"\x03\x01\x00\x02\x00\x03\x00\x00\x00\x01")
    fine = jpeg.Scan()
    for unit in range(len(parts[0])):
        for p in parts:
            fine.add(0, -1, p[unit][0] & 1, 1)
    out += scan(fine, b"\x03\x01\x00\x02\x00\x03\x00\x00\x00\x10")
    for n, p in enumerate(parts):
        for first, last in ((1, 5), (6, 63)):
            band, ended = jpeg.Scan(), 0

            def close(band, ended):
                if ended:
                    size = ended.bit_length() - 1
                    band.add(16, size << 4, ended - (1 << size), size)

            for block in p:
                run = 0
                for k in range(first, last + 1):
                    value = shifted(block[k], 1)
                    if not value:
                        run += 1
                        continue
                    close(band, ended)
                    ended = 0
                    while run > 15:
                        band.add(16, 0xF0)
                        run -= 16
                    size, extra = jpeg._amplitude(value)
                    band.add(16, run << 4 | size, extra, size)
                    run = 0
                if run:
                    ended += 1
                    if ended == 0x7FFF:
                        close(band, ended)
                        ended = 0
            close(band, ended)
            out += scan(band, bytes([1, n + 1, 0, first, last, 1]))
        finer = jpeg.Scan()
        for block in p:
            run, bits = 0, []
            newest = max((k for k in range(1, 64) if abs(block[k]) == 1), default=0)
            for k in range(1, 64):
                size = abs(block[k])
                if not size:
                    if run == 15 and k < newest:
                        finer.add(16, 0xF0)
                        for b in bits:
                            finer.add(16, -1, b, 1)
                        run, bits = 0, []
                    else:
                        run += 1
                elif size > 1:
                    bits.append(size & 1)
                else:
                    finer.add(16, run << 4 | 1, int(block[k] > 0), 1)
                    for b in bits:
                        finer.add(16, -1, b, 1)
                    run, bits = 0, []
            if run or bits:
                finer.add(16, 0)
                for b in bits:
                    finer.add(16, -1, b, 1)
        out += scan(finer, bytes([1, n + 1, 0, 1, 63, 0x10]))
    return out + b"\xff\xd9", tables


def plain_inverse(rgba, tables):
    """Quantised and back without any file, by the sum that defines the transform."""
    h, w = rgba.shape[:2]
    planes = []
    for block, table in zip(jpeg.quantised(rgba, [tables[0], tables[1], tables[1]]), [tables[0], tables[1], tables[1]]):
        rows, columns = block.shape[:2]
        plane = np.zeros((rows * 8, columns * 8))
        for i in range(rows):
            for j in range(columns):
                c = (block[i, j] * table).reshape(8, 8)
                for y in range(8):
                    for x in range(8):
                        wave = np.array([[(0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4 * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16) for v in range(8)] for u in range(8)])
                        plane[i * 8 + y, j * 8 + x] = (wave * c).sum() + 128
        planes.append(np.clip(np.rint(plane), 0, 255)[:h, :w])
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.rint(np.dstack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb])), 0, 255)


def test_jpeg_against_the_defining_sum():
    picture = smooth(13, 18)
    picture[4:9, 5:11, :3] = np.random.default_rng(1).integers(0, 256, (5, 6, 3))
    got = jpeg.decode(jpeg.encode(picture, 80))
    want = plain_inverse(picture, [jpeg.quality_table(jpeg.LUMINANCE, 80), jpeg.quality_table(jpeg.CHROMINANCE, 80)])
    assert got.shape == (13, 18, 4) and np.abs(got[:, :, :3] - want).max() <= 2 and (got[:, :, 3] == 255).all()


def test_progressive_jpeg():
    picture = smooth(29, 43)
    picture[8:24, 8:30, :3] = np.random.default_rng(2).integers(0, 256, (16, 22, 3))
    data, tables = progressive(picture)
    assert np.abs(jpeg.decode(data)[:, :, :3] - plain_inverse(picture, tables)).max() <= 2


@pytest.mark.parametrize("shape", [(1, 1), (8, 8), (9, 7), (64, 40)])
def test_jpeg_round_trip(shape):
    picture = smooth(*shape)
    got = jpeg.decode(jpeg.encode(picture, 95))
    assert got.shape == picture.shape and np.abs(got.astype(int) - picture).max() <= 8
    assert jpeg.dimensions(jpeg.encode(picture)) == shape[::-1]


def test_subsampled_jpeg_with_restarts():
    """A file of one level: 20 x 20 pixels, chroma halved both ways, a restart after each unit."""
    frame = struct.pack(">BHHB", 8, 20, 20, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"
    codes = jpeg.segment(0xC4, b"\x00" + bytes([0, 2] + [0] * 14) + b"\x00\x05") + jpeg.segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00")
    level = "01" + f"{20:05b}" + "0"  # size 5, value 20, end of block
    same = "00" + "0"
    unit = level + same * 3 + same + same
    unit += "1" * (-len(unit) % 8)
    stretch = int(unit, 2).to_bytes(len(unit) // 8, "big").replace(b"\xff", b"\xff\0")
    coded = stretch + b"\xff\xd0" + stretch + b"\xff\xd1" + stretch + b"\xff\xd2" + stretch
    data = b"\xff\xd8" + jpeg.segment(0xDB, b"\0" + bytes([16] * 64)) + jpeg.segment(0xC0, frame) + codes + jpeg.segment(0xDD, b"\0\1") + jpeg.segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00") + coded + b"\xff\xd9"
    got = jpeg.decode(data)
    assert got.shape == (20, 20, 4) and (got[:, :, :3] == 128 + 20 * 16 // 8).all()
    with pytest.raises(Undecodable):
        jpeg.decode(data.replace(b"\xff\xd2", b""))


def test_damaged_jpegs_have_no_pixels():
    data = jpeg.encode(smooth())
    for bad in (b"", data[:-2], data[: len(data) // 2] + b"\xff\xd9", data[:200], b"\xff\xd8\xff\xd9", data.replace(b"\xff\xda", b"\xff\xfe"), data.replace(b"\xff\xc0", b"\xff\xc9")):
        with pytest.raises(Undecodable):
            jpeg.decode(bad)
    sides = data.index(b"\xff\xc0") + 5
    for k in {*range(2, len(data), 7)} - {*range(sides, sides + 4)}:  # whatever is flipped: pixels or this error, nothing else
        try:
            jpeg.decode(data[:k] + bytes([data[k] ^ 0x55]) + data[k + 1 :])
        except Undecodable:
            pass


def lzw_packed(data):
    words, width, held, n, before = {bytes([k]): k for k in range(256)}, 9, 256, 9, b""
    number = 258
    for byte in data:
        if before + bytes([byte]) in words:
            before += bytes([byte])
            continue
        held, n = held << width | words[before], n + width
        words[before + bytes([byte])] = number
        number, before = number + 1, bytes([byte])
        width = max(9, number.bit_length())
        if number == 4094:
            held, n = held << width | words[before], n + width
            held, n = held << width | 256, n + width
            words, width, number, before = {bytes([k]): k for k in range(256)}, 9, 258, b""
    if before:
        held, n = held << width | words[before], n + width
        width = max(9, (number + 1).bit_length())
    held, n = held << width | 257, n + width
    return (held << -n % 8).to_bytes((n + 7) // 8, "big")


def packbits_packed(data):
    return b"".join(bytes([len(data[k : k + 100]) - 1]) + data[k : k + 100] for k in range(0, len(data), 100)) + b"\x80"


PACK = {1: bytes, 5: lzw_packed, 8: zlib.compress, 32773: packbits_packed}


def tiff_file(lines, width, colour, bits, per_pixel, packing=1, order="<", rows=8, more=()):
    """lines: bytes of each row."""
    strips = [PACK[packing](b"".join(lines[k : k + rows])) for k in range(0, len(lines), rows)]
    body, places = b"", []
    for s in strips:
        places.append(8 + len(body))
        body += s
    tags = {256: [width], 257: [len(lines)], 258: [bits] * per_pixel, 259: [packing], 262: [colour], 273: places, 277: [per_pixel], 278: [rows], 279: [len(s) for s in strips], **dict(more)}
    at, extra, entries = 8 + len(body), b"", b""
    for tag, values in sorted(tags.items()):
        packed = struct.pack(f"{order}{len(values)}I", *values)
        if len(packed) > 4:
            extra, packed = extra + packed, struct.pack(f"{order}I", at + len(extra))
        entries += struct.pack(f"{order}HHI", tag, 4, len(values)) + packed
    return {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(f"{order}I", at + len(extra)) + body + extra + struct.pack(f"{order}H", len(tags)) + entries


@pytest.mark.parametrize("packing", PACK)
@pytest.mark.parametrize("order", "<>")
def test_tiff(packing, order):
    picture = smooth(61, 90)
    picture[20:50, :, :3] = np.random.default_rng(3).integers(0, 256, (30, 90, 3))
    rgb = [r.tobytes() for r in picture[:, :, :3]]
    assert np.array_equal(tiff.decode(tiff_file(rgb, 90, 2, 8, 3, packing, order)), picture)
    wide = [(r.astype(int) << 8 | 7).astype(f"{order}u2").tobytes() for r in picture[:, :, :3]]
    assert np.array_equal(tiff.decode(tiff_file(wide, 90, 2, 16, 3, packing, order, 61)), picture)
    apart = [np.diff(r.astype(int), axis=0, prepend=np.zeros((1, 3), int)).astype(np.uint8).tobytes() for r in picture[:, :, :3]]
    assert np.array_equal(tiff.decode(tiff_file(apart, 90, 2, 8, 3, packing, order, more=((317, [2]),))), picture)


def test_tiff_of_few_bits_and_palettes():
    rng = np.random.default_rng(4)
    for bits in (1, 2, 4):
        values = rng.integers(0, 1 << bits, (9, 13), dtype=np.uint8)
        lines = [int("".join(f"{v:0{bits}b}" for v in r).ljust(-(-13 * bits // 8) * 8, "0"), 2).to_bytes(-(-13 * bits // 8), "big") for r in values]
        grey = tiff.decode(tiff_file(lines, 13, 1, bits, 1))
        assert np.array_equal(grey[:, :, 1], values.astype(int) * 255 // ((1 << bits) - 1))
        assert np.array_equal(tiff.decode(tiff_file(lines, 13, 0, bits, 1))[:, :, :3], 255 - grey[:, :, :3])
        table = rng.integers(0, 65536, (3, 1 << bits))
        assert np.array_equal(tiff.decode(tiff_file(lines, 13, 3, bits, 1, more=((320, table.ravel().tolist()),)))[:, :, :3], (table >> 8).T[values])


def test_damaged_tiffs_have_no_pixels():
    data = tiff_file([bytes(30)] * 10, 10, 2, 8, 3)
    for bad in (b"", data[:8], data[:-30], data[:4] + b"\xff\xff\xff\x00" + data[8:], tiff_file([bytes(20)] * 10, 10, 2, 8, 3), tiff_file([bytes(30)] * 10, 10, 6, 8, 3), tiff_file([bytes(30)] * 10, 10, 2, 8, 3, more=((278, [3]),))):
        with pytest.raises(Undecodable):
            tiff.decode(bad)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=200), st.integers(0, 400), st.sampled_from(sorted(PACK)))
def test_any_bytes_give_pixels_or_an_error(tail, at, packing):
    data = tiff_file([bytes(range(30))] * 10, 10, 2, 8, 3, packing)
    for module, raw in ((tiff, data[:at] + tail + data[at + len(tail) :]), (tiff, b"II*\0" + tail), (jpeg, b"\xff\xd8\xff" + tail)):
        try:
            width, height = module.dimensions(raw)
            if width * height < 1 << 20:
                assert module.decode(raw).shape == (height, width, 4)
        except Undecodable:
            pass


def test_rebuilt_stills():
    """JPEG and TIFF become PNG without metadata; JPEG comes out where the policy asks for it."""
    picture = smooth()
    photo = jpeg.encode(picture, 95)
    tagged = photo[:2] + jpeg.segment(0xE1, b"Exif\0\0secret place") + photo[2:]
    made = one(tagged, "image", "image/jpeg", STANDARD)
    assert made["mime"] == "image/png" and made["read_ok"] and b"secret" not in made["output"] and "error_kind" not in made
    scan = tiff_file([r.tobytes() for r in picture[:, :, :3]], 53, 2, 8, 3)
    assert one(scan, "image", "image/tiff", STANDARD)["read_ok"]
    policy = {**STANDARD, "image": {**STANDARD["image"], "output_format": "Jpeg"}}
    made = one(scan, "image", "image/tiff", policy)
    assert made["mime"] == "image/jpeg" and made["read_ok"] and np.abs(jpeg.decode(made["output"]).astype(int) - picture).max() <= 24
    tight = {**STANDARD, "image": {**STANDARD["image"], "max_pixels": 100}, "decoder_failure_mode": "Block"}
    assert one(photo, "image", "image/jpeg", tight)["error_kind"] == "Io"
    strict = {**STANDARD, "decoder_failure_mode": "Block"}
    assert one(photo[:-9], "image", "image/jpeg", strict)["error_kind"] == one(scan[:-9], "image", "image/tiff", strict)["error_kind"] == "Image"


def test_a_rebuilt_png_holds_no_signature_by_chance():
    """At the usual level this picture's checksum ends in PE, before the zeros of IEND."""
    import numpy as np

    from weir.operators import rebuild
    from weir.operators.codecs import png
    from weir.plans import policy

    line = np.frombuffer(b"\x80some words, 83939", np.uint8)
    pixels = np.full((1, len(line), 4), 255, np.uint8)
    pixels[0, :, :3] = line[:, None]
    assert b"PE\0\0" in png.encode(pixels)
    out = rebuild.image(png.encode(pixels, 1), policy.STANDARD, rebuild.Clock(None))["output"]
    assert b"PE\0\0" not in out and (png.decode(out) == pixels).all()


def test_derived_media_hold_no_signature_by_chance():
    """Uncompressed, the checksum of this picture ends in PE before the zeros of IEND, and sound of 17,695 samples has 17,744 bytes with its metadata."""
    from weir.operators.codecs import png
    from weir.sources.derived import media_bytes

    text = b"some words, 91311"
    for kind in (1, 3):
        out = media_bytes(text, kind)
        assert b"PE\0\0" not in out and png.decode(out)[0, :, 0].tobytes() == b"\x80" + text
        assert b"PE\0\0" in media_bytes(b"PE\0\0", kind)
    for size in (17694, 17695):
        out = media_bytes(b"w" * (size - 1), 0)
        assert b"PE\0\0" not in out and out.endswith(size.to_bytes(4, "little") + b"\x80" + b"w" * (size - 1) + b"\0" * (size % 2))
        assert int.from_bytes(out[4:8], "little") == len(out) - 8
    assert b"PE\0\0" in media_bytes(b"w" * 17743, 0)  # the size of the sound itself
