"""MIME types from leading bytes, by a table of published signatures; and animation markers.

The table is of this package's own making; the first entry that fits counts. Kinds are what the pipeline needs.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import names
from .binary import lit_bytes

# Fixed values: (MIME type, ((offset, hex of the bytes), ...)), in order of testing.
SIGNATURES = (
    ("image/jpeg", ((0, "FFD8FF"),)),
    ("image/png", ((0, "89504E470D0A1A0A"),)),
    ("image/gif", ((0, "474946383761"),)),
    ("image/gif", ((0, "474946383961"),)),
    ("image/webp", ((0, "52494646"), (8, "57454250"))),
    ("image/tiff", ((0, "49492A00"),)),
    ("image/tiff", ((0, "4D4D002A"),)),
    ("image/bmp", ((0, "424D"), (6, "00000000"))),
    ("video/quicktime", ((4, "6674797071742020"),)),
    ("audio/m4a", ((4, "667479704D344120"),)),
    ("video/x-m4v", ((4, "667479704D345620"),)),
    ("video/mp4", ((4, "66747970"),)),
    ("video/webm", ((0, "1A45DFA3"),)),
    ("video/x-msvideo", ((0, "52494646"), (8, "41564920"))),
    ("audio/x-wav", ((0, "52494646"), (8, "57415645"))),
    ("audio/mpeg", ((0, "494433"),)),
    ("audio/mpeg", ((0, "FFFB"),)),
    ("audio/mpeg", ((0, "FFF3"),)),
    ("audio/mpeg", ((0, "FFF2"),)),
    ("audio/aac", ((0, "FFF1"),)),
    ("audio/aac", ((0, "FFF9"),)),
    ("audio/opus", ((0, "4F676753"), (28, "4F70757348656164"))),
    ("audio/ogg", ((0, "4F676753"),)),
    ("audio/x-flac", ((0, "664C6143"),)),
    ("audio/amr", ((0, "2321414D520A"),)),
    ("audio/x-aiff", ((0, "464F524D"), (8, "41494646"))),
    ("application/pdf", ((0, "25504446"),)),
    ("application/zip", ((0, "504B0304"),)),
    ("application/zip", ((0, "504B0506"),)),
    ("application/zip", ((0, "504B0708"),)),
    ("application/vnd.rar", ((0, "526172211A07"),)),
    ("application/x-7z-compressed", ((0, "377ABCAF271C"),)),
    ("application/gzip", ((0, "1F8B08"),)),
    ("application/x-ole-storage", ((0, "D0CF11E0A1B11AE1"),)),
    ("application/x-executable", ((0, "7F454C46"),)),
    ("application/x-mach-binary", ((0, "FEEDFACE"),)),
    ("application/x-mach-binary", ((0, "FEEDFACF"),)),
    ("application/x-mach-binary", ((0, "CEFAEDFE"),)),
    ("application/x-mach-binary", ((0, "CFFAEDFE"),)),
    ("application/java", ((0, "CAFEBABE"),)),
    ("application/wasm", ((0, "0061736D"),)),
    ("application/vnd.microsoft.portable-executable", ((0, "4D5A"),)),
    ("text/x-shellscript", ((0, "23212F"),)),
    ("text/xml", ((0, "3C3F786D6C"),)),
    ("text/html", ((0, "3C21444F43545950452068746D6C"),)),
    ("text/html", ((0, "3C68746D6C"),)),
)


def _at(data: Column, offset: int, digits: str) -> Column:
    want = bytes.fromhex(digits)
    return data.startswith(lit_bytes(want)) if offset == 0 else F.substring(data, offset + 1, len(want)) == lit_bytes(want)


def sniff_mime(data: Column) -> Column:
    """The first signature's MIME type, else null."""
    out = None
    for mime, parts in SIGNATURES:
        fits = _at(data, *parts[0])
        for part in parts[1:]:
            fits = fits & _at(data, *part)
        out = F.when(fits, mime) if out is None else out.when(fits, mime)
    return out


def mime_of(data: bytes) -> str | None:
    """The same for bytes at hand."""
    return next((mime for mime, parts in SIGNATURES if all(data.startswith(bytes.fromhex(digits), at) for at, digits in parts)), None)


def animated_webp(data: Column) -> Column:
    size = F.conv(F.concat(*[F.hex(F.substring(data, k, 1)) for k in (20, 19, 18, 17)]), 16, 10).cast("long")
    flags = F.conv(F.hex(F.substring(data, 21, 1)), 16, 10).cast("int")
    marked = _at(data, 0, "52494646") & _at(data, 8, "57454250") & _at(data, 12, "56503858")
    return F.coalesce(F.when((F.length(data) >= 21) & marked, (size >= 10) & (flags.bitwiseAND(F.lit(2)) != 0)), F.lit(False))


#: Bytes of a PNG that go to Python; only where the walk over its chunks leaves them, the whole object does.
AHEAD = 4096


def is_apng(data: bytes | None, whole: bool = True) -> bool | None:
    """Whether an acTL chunk stands before the first IDAT or IEND, among the first 256 chunks.

    None if `data` is only the start of the object (not whole) and doesn't reach as far as the answer.
    """
    beyond = False if whole else None
    if data is None or len(data) < 16 or data[:8] != b"\x89PNG\r\n\x1a\n":
        return False
    at = 8
    for _ in range(256):
        if at + 8 > len(data):
            return beyond
        name = data[at + 4 : at + 8]
        if name in (b"acTL", b"IDAT", b"IEND"):
            return name == b"acTL"
        at += 12 + int.from_bytes(data[at : at + 4], "big")
        if at > len(data):
            return beyond
    return False


@F.arrow_udf(BooleanType())
def animated_start(start: pa.Array, length: pa.Array) -> pa.Array:
    return pa.array([is_apng(d, n is None or len(d or b"") >= n) for d, n in zip(start.to_pylist(), length.to_pylist())], pa.bool_())


@F.arrow_udf(BooleanType())
def animated_whole(data: pa.Array) -> pa.Array:
    return pa.array([is_apng(d) for d in data.to_pylist()], pa.bool_())


def animated_png(data: Column) -> Column:
    """Walks chunks, so it is Python, but over the first bytes only wherever they tell."""
    png = _at(data, 0, "89504E470D0A1A0A")
    told = animated_start(F.when(png, F.substring(data, 1, AHEAD)), F.length(data))
    return F.coalesce(told, animated_whole(F.when(told.isNull(), data)))


def base_kind(by_mime: Column, by_name: Column) -> Column:
    return F.coalesce(by_mime, by_name, F.lit("other"))


def classify(data: Column, name: Column, by_mime: Column, by_name: Column) -> Column:
    """The kind: other for double extensions; by type, else by name; stills with an animation marker are animated."""
    base = base_kind(by_mime, by_name)
    animated = (base == "image") & (animated_webp(data) | animated_png(data))
    return F.when(names.double_extension(name), "other").when(animated, "animated_image").otherwise(base)
