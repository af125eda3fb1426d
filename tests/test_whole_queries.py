"""Registered queries against plain Python over small tables that hold the cases the given tables lack."""

import hashlib
import json

import duckdb
import pytest

from weir import queries
from weir.operators import pipeline
from weir.operators.containers.audio import ogg_page
from weir.plans import policy
from weir.sources.derived import EXTS, MAGIC, derived_objects


def tables(spark, folder, **frames):
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_strip_ogg_walks_whole_texts(spark, tmp_path):
    sizes = [0, 1, 199, 200, 201, 254, 255, 256, 510, 65024, 65025, 65026, 65280, 130049, 130050, 200_000]
    texts = {k: (f"{k}:" + "abcdefg" * (n // 7 + 1))[:n] for k, n in enumerate(sizes)}
    texts[100], texts[101], texts[102] = "z" * 300 + "one", "z" * 300 + "two", None
    head = lambda flags: b"OggS\0" + bytes([flags]) + b"\0" * 16
    got = {r.doc_id: r for r in queries.strip_ogg(spark, tables(spark, tmp_path, documents=(list(texts.items()), "doc_id long, text string"))).collect()}
    assert set(got) == set(texts)
    for k, text in texts.items():
        if text is None:
            assert (got[k].sha256, got[k].stripped, got[k].stripped_bytes) == (None, None, None)
            continue
        segments = [text.encode()[a : a + 255] for a in range(0, len(text) + 1, 255)]
        out = ogg_page(head(2), b"OpusHead" + b"x" * 11) + ogg_page(head(0), b"OpusTags" + b"\0" * 8)
        for a in range(0, len(segments), 255):
            page = segments[a : a + 255]
            out += b"OggS\0" + bytes([a > 0]) + b"\0" * 20 + bytes([len(page), *map(len, page)]) + b"".join(page)
        assert (got[k].sha256, got[k].stripped, got[k].stripped_bytes) == (hashlib.sha256(out).hexdigest(), 0, 208), k
    assert got[100].sha256 != got[101].sha256


def whole(ext, data):
    """The probe row by row."""
    if ext == "json":
        try:
            json.loads(data.decode(), parse_constant=lambda c: 1 / 0)
        except (ValueError, ZeroDivisionError, RecursionError):
            return False
    if ext == "pdf":
        return data[:5] == b"%PDF-" and b"%%EOF" in data
    if ext == "xml":
        try:
            return data.decode().lstrip("\t\n\v\f\r \x85\xa0                　").startswith("<")
        except UnicodeDecodeError:
            return False
    return data[:4] in (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08") if ext == "zip" else True


TEXTS = ["", " ", "{}", '{"a": [1, 2.5e3, null, "\\u00e9"]}', '{"a": 1} x', "{'a': 1}", "[1,]", "NaN", "01", '"s"', "true", '{"a":1,"a":2}', "1 2", "[" * 50 + "]" * 50, "<a/>", "  \n<b>", " <c", "x<", "﻿<d", "prose %%EOF", "%PDF-1.4 x %%EOF", "%PDF-1.4", "PK\x05\x06rest", "words and words"]


def test_structured_probe_judges_every_object(spark, tmp_path):
    # ids in steps of 400 have the same extension and magic bytes, so every text meets all of them
    rows = [(400 * k + d, t) for k, t in enumerate(TEXTS) for d in range(400)]
    sf = tables(spark, tmp_path, documents=(rows, "doc_id long, text string"))
    got = {r.object_id: r for r in queries.structured_probe(spark, sf).collect()}
    want = {}
    for d, text in rows:
        name = EXTS[d % 20]
        want[d] = whole(name.rsplit(".")[-1] or None, bytes.fromhex(MAGIC[d // 20 % 20]) + text.encode())
    assert {k: r.whole for k, r in got.items()} == want
    for ext in ("json", "xml", "pdf", "zip"):
        assert {r.whole for r in got.values() if r.ext == ext} == {True, False}


@pytest.mark.parametrize(
    "text, fine",
    [("1e400", False), ("-1e400", False), ("1" * 400, False), ("1e-400", True), ("Infinity", False), ('"\\ud800"', False), ('"\\ud83d\\ude00"', True), ('{"a":1,"a":"\\udc00"}', False)]
    + [("[" * 127 + "]" * 127, True), ("[" * 128 + "]" * 128, False), ('["' + "[" * 200 + '"]', True), ("[" * 10**5, False), ("9" * 5000, False), ('"\t"', False), (b'"\xff"', False), (b"\xef\xbb\xbf{}", False)],
)
def test_json_edges(text, fine):
    assert queries._json_whole(text.encode() if isinstance(text, str) else text) is fine


def test_every_blocked_object_has_an_envelope(spark, tmp_path):
    # all pairs of extension and magic bytes, and their declared types
    sf = tables(spark, tmp_path, documents=([(k, f"some words, {k}") for k in range(1200)], "doc_id long, text string"))
    results = pipeline.defend(derived_objects(spark, sf), policy.policy_table(spark)).collect()
    want = {}
    for r in results:
        if r.verdict == "blocked":
            reason = next((a.code for a in r.alerts if a.severity == 2), "blocked")
            want[r.object_id] = (r.parser_used, reason, r.sha256, r.input_bytes, r.output_bytes, [s.detail for s in r.stages])
    got = queries.quarantine_envelopes(spark, sf).collect()
    stopped = lambda w: w[0] == "pre_scan_blocked"
    assert len(got) == len(want) and {r.object_id: tuple(r)[1:] for r in got} == {k: (w[0], w[1], w[2] if stopped(w) else None, w[3]) for k, w in want.items()}
    assert {r.object_id for r in got} == {r.object_id for r in queries.pipeline_full(spark, sf).collect() if r.error_kind is None}
    assert {r.parser_used for r in got} >= {"image", "gif", "audio", "video", "animated_image", "other", "pre_scan_blocked"}


def test_containers_that_only_seem_whole_are_no_films(spark, tmp_path):
    """Texts that happen to read as EBML elements or as the end of an ftyp atom: no segment, no movie, so no structure is kept."""
    element = "@ " + "x" * 32  # a size of 32 in two bytes
    texts = {49099: element + ("Ge" + element) * 20, 49099 + 4400: element + ("Ge" + element) * 3, 2679: "twelve bytes!", 2679 + 4400: "fewer"}
    sf = tables(spark, tmp_path, documents=(list(texts.items()), "doc_id long, text string"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT object_id, parser_used, reason, input_sha256, original_size FROM ({queries.SQL['quarantine_envelopes']})").fetchall()
    got = [tuple(r) for r in queries.quarantine_envelopes(spark, sf).collect()]
    assert len(got) == 4 and {r[1] for r in got} == {"video"} and sorted(got) == sorted(want)


def test_strip_flac_answers_for_empty_texts(spark, tmp_path):
    texts = {1: "", 2: None, 3: "x", 4: "some words"}
    sf = tables(spark, tmp_path, documents=(list(texts.items()), "doc_id long, text string"))
    got = {r.doc_id: tuple(r)[1:] for r in queries.strip_flac(spark, sf).collect()}
    kept = lambda t: hashlib.sha256(b"fLaC\x80\x00\x00\x22" + b"s" * 34 + t.encode()).hexdigest()
    # no frames behind the metadata is malformed, so nothing is kept; a null text isn't the format
    assert got == {1: (None, 0, 0), 2: (None, None, None), 3: (kept("x"), 2, 12), 4: (kept("some words"), 2, 21)}


def test_released_formats_has_a_row_for_a_stopped_object(spark, tmp_path):
    sf = tables(spark, tmp_path, documents=([(1, "PE\0\0"), (4, "words")], "doc_id long, text string"))
    got = {r.object_id: (r.verdict, r.released, r.alerts, r.read) for r in queries.released_formats(spark, sf).collect()}
    assert got[1] == ("blocked", False, "signature_match", None) and got[4][:2] == ("clean", True)
