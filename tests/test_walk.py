from weir.functions import walk

from . import builders as B


def test_elements():
    assert [e[2] for e in walk.elements(B.still(text=b"x"))] == ["IHDR", "IDAT", "tEXt", "IEND"]
    assert [e[2] for e in walk.elements(B.mp4())] == ["ftyp", "moov", "mvhd", "trak", "tkhd", "udta", "udta", "free", "mdat"]
    assert [e[2] for e in walk.elements(B.webm())] == ["1A45DFA3", "18538067"]
    assert list(walk.elements(b"text")) == list(walk.elements(None)) == []
    assert list(walk.elements(B.still()[:-3]))[-1][2] is None


def test_lateral_join(spark):
    rows = spark.createDataFrame([(1, bytearray(B.still())), (2, bytearray(b"x")), (3, None)], "object_id long, payload binary")
    rows.createOrReplaceTempView("walked_objects")
    walk.register(spark)
    out = spark.sql("SELECT object_id, e.name, e.size FROM walked_objects, LATERAL walk_container(payload) e").collect()
    assert [(r.object_id, r.name) for r in out] == [(1, "IHDR"), (1, "IDAT"), (1, "IEND")] and out[0].size == 13
