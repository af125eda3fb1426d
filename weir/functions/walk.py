"""Container elements as rows: table functions to be joined laterally with objects.

    objects.createOrReplaceTempView("objects"); register(spark)
    spark.sql("SELECT object_id, e.* FROM objects, LATERAL walk_container(payload) e")

A damaged container gives the elements before the damage and then one row of name null.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weir.operators.containers import Malformed
from weir.operators.containers.apng import SIGNATURE, chunks
from weir.operators.containers.video import _atoms, vint_id, vint_size

#: Elements listed of one object.
MOST = 65536


def elements(data: bytes | None) -> Iterator[tuple[str, int, str | None, int]]:
    """(format, position in order, name, size of the body) of PNG chunks, MP4 atoms (nested ones too) and EBML top elements."""
    if not data:
        return
    if data[:8] == SIGNATURE:
        kind, found = "png", ((name.decode("latin-1"), len(body)) for name, body in chunks(data, MOST, 1 << 31))
    elif data[4:8] in (b"ftyp", b"moov", b"styp"):
        kind, found = "mp4", ((name.decode("latin-1"), end - body) for name, _, body, end in _atoms(data, 0, len(data), True))
    elif data[:4] == b"\x1a\x45\xdf\xa3":
        kind, found = "ebml", _ebml(data)
    else:
        return
    at = 0
    try:
        for at, (name, size) in enumerate(found):
            if at >= MOST:
                return
            yield kind, at, name, size
    except Malformed:
        yield kind, at + 1, None, 0


def _ebml(data: bytes) -> Iterator[tuple[str, int]]:
    at = 0
    while at < len(data):
        name, a = vint_id(data, at)
        size, b = vint_size(data, at + a)
        size = len(data) - at - a - b if size is None else size
        if at + a + b + size > len(data):
            raise Malformed("Video", "an element reaches beyond the end")
        yield f"{name:X}", size
        at += a + b + size


class WalkContainer:
    def eval(self, payload: bytes):
        yield from elements(payload)


def walk_container():
    return F.udtf(WalkContainer, returnType="format string, pos int, name string, size long")


def register(spark: SparkSession) -> None:
    spark.udtf.register("walk_container", walk_container())
