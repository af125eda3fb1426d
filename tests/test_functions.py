import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from weir.functions import binary, names, sniff

from . import builders as B


def values(spark, kind, items, *columns):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(items)], f"k int, v {kind}")
    return [tuple(r)[1:] for r in rows.select("k", *columns).orderBy("k").collect()]


def test_extensions(spark):
    cases = {"a.PNG": "png", "a": None, ".png": None, "a.": "", "x.y/z": None, "d/a.tar.GZ": "gz", "..": None, "a/..": None, "..png": "png", "a.b/": "b", "": None, None: None, "é.Jpg": "jpg"}
    got = values(spark, "string", list(cases), names.extension(F.col("v")))
    assert [g[0] for g in got] == list(cases.values())


def test_kinds_and_types(spark):
    cases = {"a.apng": ("animated_image", "image/png"), "a.m4a": ("audio", "application/mp4"), "a.docx": ("other", None), "a.aif": (None, "audio/aiff"), "a.xyz": (None, None), None: (None, None), "a.oga": ("audio", "audio/ogg")}
    assert values(spark, "string", list(cases), names.kind_from_name(F.col("v")), names.mime_from_name(F.col("v"))) == list(cases.values())
    mimes = {"image/GIF": "gif", "image/svg+xml": "other", "IMAGE/png": "image", "video/x": "video", "audio/": "audio", "text/a": "other", "application/x": "other", "font/a": None, None: None}
    assert [v[0] for v in values(spark, "string", list(mimes), names.kind_from_mime(F.col("v")))] == list(mimes.values())
    normal = {" Image/JPG ; q=1": "image/jpeg", "audio/x-m4a": "application/mp4", "video/mp4": "application/mp4", "a/b": "a/b", "": "", None: None, "audio/OPUS": "audio/ogg"}
    assert [v[0] for v in values(spark, "string", list(normal), names.normal_mime(F.col("v")))] == list(normal.values())


def test_double_extensions(spark):
    cases = {"invoice.exe.png": True, ".exe.png": True, "exe.png": False, "a.EXE.b.png": False, "a.b.SCR.x": True, "a.png": False, None: False}
    assert [v[0] for v in values(spark, "string", list(cases), names.double_extension(F.col("v")))] == list(cases.values())


def test_summaries(spark):
    cases = {"first\nsecond": "first", "": "empty panic message", None: "panic with non-string payload", "é\tx": "??x", "y" * 81: "y" * 80 + "…", "\nx": "empty panic message"}
    assert [v[0] for v in values(spark, "string", list(cases), names.summary_of_failure(F.col("v")))] == list(cases.values())


@pytest.mark.parametrize("key", [b"", b"k", b"x" * 64, b"y" * 200])
def test_hmac(spark, key):
    items = [b"", b"abc", bytes(range(256))]
    got = values(spark, "binary", [bytearray(x) for x in items], binary.hmac_sha256(key, F.col("v")))
    assert [g[0] for g in got] == [hmac.new(key, x, hashlib.sha256).hexdigest() for x in items]


def test_numbers_and_entropy(spark):
    data = bytes([1, 2, 3, 4, 0xFF])
    got = values(spark, "binary", [bytearray(data)], binary.unsigned(F.col("v"), 1, 4), binary.unsigned(F.col("v"), 2, 4, True), binary.unsigned(F.col("v"), 3, 4), binary.synchsafe(F.col("v"), 2), binary.byte_entropy(F.col("v")))[0]
    assert got[:3] == (0x01020304, 0xFF040302, None) and got[3] == (2 << 21 | 3 << 14 | 4 << 7 | 255) and got[4] == pytest.approx(2.321928)
    assert [round(v[0], 6) if v[0] is not None else None for v in values(spark, "binary", [bytearray(b""), None, bytearray(range(256)), bytearray(b"aa")], binary.byte_entropy(F.col("v")))] == [0.0, None, 8.0, 0.0]


def test_sniffing_and_classes(spark):
    webp = b"RIFF\x2a\0\0\0WEBPVP8X\x0a\0\0\0\x02" + b"\0" * 9
    cases = [
        (B.still(), "a.png", "image/png", "image"),
        (B.animated(), "a.png", "image/png", "animated_image"),
        (B.animated(), "a.exe.png", "image/png", "other"),
        (webp, "a.webp", "image/webp", "animated_image"),
        (webp[:20] + b"\0" + webp[21:], "a.webp", "image/webp", "image"),
        (B.moving(), None, "image/gif", "gif"),
        (B.wav(), "x", "audio/x-wav", "audio"),
        (B.mp3(), "x.mp3", "audio/mpeg", "audio"),
        (B.flac(), "x", "audio/x-flac", "audio"),
        (B.ogg(), "x", "audio/opus", "audio"),
        (B.mp4(), "x.mp4", "video/mp4", "video"),
        (B.mp4(b"M4A "), "x.m4a", "audio/m4a", "audio"),
        (B.webm(), "x", "video/webm", "video"),
        (b"hello", "x.txt", None, "other"),
        (b"", "x.png", None, "image"),
        (b"MZ\x90", None, "application/vnd.microsoft.portable-executable", "other"),
    ]
    rows = spark.createDataFrame([(k, bytearray(d), n) for k, (d, n, _, _) in enumerate(cases)], "k int, d binary, n string").withColumn("m", sniff.sniff_mime(F.col("d")))
    rows = rows.withColumn("c", sniff.classify(F.col("d"), F.col("n"), names.kind_from_mime(F.col("m")), names.kind_from_name(F.col("n"))))
    assert [(r.m, r.c) for r in rows.orderBy("k").collect()] == [c[2:] for c in cases]


def test_apng_walk():
    assert sniff.is_apng(B.animated()) and not sniff.is_apng(B.still()) and not sniff.is_apng(None)
    assert not sniff.is_apng(B.animated()[:14]) and not sniff.is_apng(b"\x89PNG\r\n\x1a\n" + b"\xff" * 20)
    many = B.PNG + B.chunk(b"IHDR", b"0" * 13) + B.chunk(b"tEXt", b"x") * 300 + B.chunk(b"acTL", b"0" * 8)
    assert not sniff.is_apng(many)
