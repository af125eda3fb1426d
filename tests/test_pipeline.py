import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.operators import pipeline, signatures
from weir.operators.codecs import gif, png
from weir.plans import policy
from weir.sources import sinks

from . import builders as B

SCHEMA = "object_id long, file_name string, declared_mime string, tenant_id string, source string, payload binary, policy_id string"


def decide(spark, cases, rules=(), policies=None):
    """cases: (name, declared, payload[, policy_id]); results in order."""
    rows = [(k, c[0], c[1], None, "incoming", None if c[2] is None else bytearray(c[2]), c[3] if len(c) > 3 else None) for k, c in enumerate(cases)]
    table = policy.policy_table(spark, policies)
    out = pipeline.defend(spark.createDataFrame(rows, SCHEMA), table, rules, default=next(iter(policies or {"standard": 0})))
    return [r for r in out.orderBy("object_id").collect()]


def codes(r):
    return [a.code for a in r.alerts or []]


def test_stills_are_rebuilt_and_released(spark):
    p = B.pixels(32, 24, 7)
    a, b, c = decide(spark, [("a.png", None, B.still(7, b"marker", 32, 24)), ("b.bmp", "image/bmp", B.bmp(p)), ("c.png", None, B.still(7, b"", 32, 24), "strict")])
    for r in (a, b, c):
        assert (r.verdict, r.released, r.error_kind, codes(r)) == ("clean", True, None, ["image_metadata_stripped"])
        assert (png.decode(bytes(r.output)) == p).all() and r.sha256 == hashlib.sha256(bytes(r.output)).hexdigest() and b"marker" not in bytes(r.output)
    assert [s.stage for s in a.stages] == ["PreScan", "Detect", "Rebuild", "ImageProbe", "Rebuild", "SignatureScan", "OutputValidation", "OutputValidation"]


def test_no_object_vanishes(spark):
    cases = [("a.png", None, B.still()), ("b.png", None, B.still(), "nosuch"), ("c.png", None, None), ("d.png", None, b""), ("e.exe", None, None), ("f.png", None, B.still(), "strict")]
    twice = policy.policy_table(spark).unionByName(policy.policy_table(spark))
    for table in (policy.policy_table(spark), twice):
        rows = [(k, c[0], c[1], None, "incoming", None if c[2] is None else bytearray(c[2]), c[3] if len(c) > 3 else None) for k, c in enumerate(cases)]
        out = pipeline.defend(spark.createDataFrame(rows, SCHEMA), table).orderBy("object_id").collect()
        assert [r.error_kind for r in out[:3]] == [None, "UnknownPolicy", "MissingPayload"] and out[4].error_kind == "BlockedExtension" and len(out) == 6
        assert [r.released for r in out] == [True, False, False, False, False, True] and out[1].verdict is None and out[0].duration_ms >= 0
    slots = spark.createDataFrame([("t", 1, "nosuch")], "tenant_id string, version long, policy string")
    one = spark.createDataFrame([(1, "a.png", None, "t", "incoming", bytearray(B.still()))], SCHEMA.rsplit(",", 1)[0])
    assert [r.error_kind for r in pipeline.defend_for_tenants(one, slots, policy.policy_table(spark)).collect()] == ["UnknownPolicy"]


def test_files_above_the_limit_are_too_large(spark, tmp_path):
    from weir.sources.derived import files

    (tmp_path / "small.png").write_bytes(B.still())
    (tmp_path / "large.png").write_bytes(B.still() + b"x" * 5000)
    limit = len(B.still()) + 100
    table = policy.policy_table(spark, {"standard": policy.profile("standard", max_input_size_bytes=limit)})
    found = files(spark, str(tmp_path), limit)
    out = {r.file_name: r for r in pipeline.defend(found, table).join(found.select("object_id", "file_name"), "object_id").collect()}
    assert out["large.png"].error_kind == "FileTooLarge" and out["small.png"].released


def test_time_for_one_object_is_limited():
    from weir.operators import rebuild

    p = {**policy.STRICT, "max_handler_duration_ms": 1e-6}
    for kind, data in (("image", B.still()), ("gif", B.moving()), ("animated_image", B.animated()), ("audio", B.wav())):
        assert rebuild.one(data, kind, None, p)["error_kind"] in ("Timeout", "Audio"), kind
    assert set(rebuild.HANDLERS) == {"image", "gif", "animated_image", "audio", "video", "other"}


def test_evidence_is_listed_with_checksums(spark, tmp_path):
    folder = tmp_path / "run"
    (folder / "sub").mkdir(parents=True)
    for name in ("b.txt", "B.txt", "sub/a"):
        (folder / name).write_text(name)
    sinks.write_manifest(spark, "file://" + str(folder))
    lines = [x for f in sorted((folder / "SHA256SUMS").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == [f"{hashlib.sha256(n.encode()).hexdigest()}  {n}" for n in ("B.txt", "b.txt", "sub/a")]


def test_artifacts_in_a_store(spark, tmp_path):
    results = spark.createDataFrame([(1, True, "image/png", bytearray(b"one"))], "object_id long, released boolean, mime string, output binary")
    folder = "file://" + str(tmp_path / "out")
    for _ in range(2):
        assert [(r.problem, (tmp_path / "out" / "1.png").read_bytes()) for r in sinks.write_artifacts(results, folder).collect()] == [(None, b"one")]
    (tmp_path / "out" / "1.png").write_bytes(b"other")
    assert [r.problem for r in sinks.write_artifacts(results, folder).collect()] == ["the file exists"]


def test_output_is_a_fixed_point(spark):
    first = decide(spark, [("a.png", None, B.still(1, b"x"))])[0]
    assert bytes(decide(spark, [("a.png", None, bytes(first.output))])[0].output) == bytes(first.output)


def test_animations(spark):
    clean, short, long = decide(spark, [("a.gif", None, B.moving(comment=b"hidden")), ("b.gif", None, B.moving(delay=0)), ("c.gif", None, B.moving(frames=3, delay=3000))])
    assert clean.verdict == "clean" and b"hidden" not in bytes(clean.output) and len(gif.frames(bytes(clean.output), 9, 10**6)) == 4
    assert short.verdict == "suspicious" and codes(short) == ["gif_metadata_stripped", "gif_delay_clamped"] and bytes(short.output) == b"" and not short.released
    assert codes(long) == ["gif_metadata_stripped", "gif_excessive_duration"]


def test_apng_needs_its_type_allowed(spark):
    allowed = policy.profile("standard", output_mime_whitelist={"image": ["image/png", "image/apng"]})
    policies = {"p": policy.STANDARD, "q": allowed, "s": policy.STRICT}
    a, b, c, d = decide(spark, [("a.apng", None, B.animated()), ("a.apng", None, B.animated(), "q"), ("a.apng", None, B.animated(), "s"), ("a.apng", None, B.animated(declared=3), "q")], policies=policies)
    assert a.verdict == "blocked" and "declared_output_mime_not_allowed" in codes(a)
    assert b.verdict == "clean" and b.kind == "animated_image" and b.mime == "image/apng"
    assert c.error_kind == "UnsupportedReconstructionLevel"
    assert d.verdict == "blocked" and "output_read_failed" in codes(d)


def test_truncated_and_corrupt(spark):
    data = B.still(1, b"", 20, 20)
    broken = B.PNG + data[8:33] + B.chunk(b"IDAT", b"no zlib") + B.chunk(b"IEND")
    a, b, c = decide(spark, [("a.png", None, data[: len(data) // 2], "strict"), ("b.png", None, broken, "strict"), ("c.png", None, broken)])
    assert a.error_kind == b.error_kind == "Image" and a.verdict is None and not a.released
    assert c.verdict == "blocked" and "decoder_failure_quarantine" in codes(c) and bytes(c.output) == b""


def test_names_types_and_levels(spark):
    still = B.still()
    cases = [("x.jpg", None, still), ("x.png", "image/jpeg", still), ("x.png", "image/*", still), ("x.png", "png", still), ("x.png", "image/x-png; q=1", still), ("pattern.exe.png", None, still, "strict"), ("note.txt", None, b"hello", "strict"), ("x.exe", None, still), (None, None, still), ("", None, still), ("x.zip", None, B.still(), "paranoid")]
    got = decide(spark, cases)
    assert [r.error_kind for r in got] == ["FileTypeMismatch"] * 4 + [None] + ["UnsupportedReconstructionLevel"] * 2 + ["BlockedExtension", None, None, "BlockedExtension"]
    assert got[4].verdict == "clean" and got[8].verdict == got[9].verdict == "suspicious" and codes(got[8])[-1] == "unknown_extension"


def test_pre_scan_comes_before_type_checks(spark):
    (r,) = decide(spark, [("canary.png", "image/png", b"MZ" + b"\0" * 50, "strict")])
    assert (r.verdict, r.parser_used, r.error_kind, codes(r), r.output_bytes) == ("blocked", "pre_scan_blocked", None, ["signature_match"], 0)
    assert r.sha256 == hashlib.sha256(b"MZ" + b"\0" * 50).hexdigest() and [s.stage for s in r.stages] == ["PreScan", "OutputValidation"]
    smuggled = [bytes.fromhex(x) for x in ("7F454C46", "CAFEBABE", "D0CF11E0A1B11AE1", "0061736D", "6465780A")] + [b"#!/bin/sh\n", b"<?php echo"]
    assert {r.verdict for r in decide(spark, [("a.png", None, d + b"x" * 40) for d in smuggled])} == {"blocked"}


def test_polyglots_lose_their_tail(spark):
    (r,) = decide(spark, [("a.png", None, B.still() + b"trailing PK\x05\x06" + b"\0" * 18)])
    assert r.verdict == "clean" and b"trailing" not in bytes(r.output)


def test_limits(spark):
    sized = lambda n: policy.profile("standard", image={"max_pixels": 16}, max_input_size_bytes=n, decoder_failure_mode="Block")
    data = {w: B.still(1, b"", w, 1) for w in (15, 16, 17)}
    policies = {"p": sized(10**6), "l": sized(len(data[16])), "m": sized(len(data[16]) - 1)}
    got = decide(spark, [("a.png", None, data[w]) for w in (15, 16, 17)] + [("a.png", None, data[16], "l"), ("a.png", None, data[16], "m")], policies=policies)
    assert [r.error_kind for r in got] == [None, None, "Io", None, "FileTooLarge"] and got[1].released
    tight = {"r": policy.profile("standard", max_output_expansion_ratio=0.5), "s": policy.profile("standard", max_output_size_bytes=10)}
    a, b = decide(spark, [("a.png", None, B.still()), ("a.png", None, B.still(), "s")], policies=tight)
    assert (a.error_kind, b.error_kind) == ("OutputExpansionTooHigh", "OutputTooLarge")


def test_unknown_bytes(spark):
    (r,) = decide(spark, [("blob.bin", None, bytes(range(256)) * 4)])
    assert r.verdict == "blocked" and "unsupported_file_kind" in codes(r) and "Entropy: 8.000" in str(r.alerts)
    empty, null = decide(spark, [("a.png", None, b""), ("a.png", None, None)])
    assert not empty.released and not null.released


def test_audio_and_video_without_tools(spark):
    got = decide(spark, [("a.wav", None, B.wav(1600)), ("a.wav", None, B.wav(1600), "strict"), ("a.mp3", None, B.mp3()), ("v.mp4", None, B.mp4()), ("v.webm", None, B.webm()), ("a.amr", None, b"#!AMR\nxx")])
    a, strict, mp3, mp4, webm, amr = got
    assert a.verdict == "clean" and a.mime == "audio/wav" and bytes(a.output) == B.wav(1600, extra=b"") and codes(a) == ["audio_metadata_stripped"]
    assert strict.error_kind == "Audio" and not strict.released
    for r in (mp3, mp4, webm):
        assert r.verdict == "blocked" and "output_read_failed" in codes(r) and "reconstruction_level_not_met" not in codes(r)
    assert "ffmpeg_missing" in codes(amr) and "empty_output_artifact" in codes(amr)


def test_dry_run(spark):
    policies = {"d": policy.dry_run(policy.STANDARD)}
    hit, big = decide(spark, [("x.bin", None, b"MZ" + b"q" * 9), ("x.jpg", None, B.still())], policies=policies)
    assert hit.verdict == "suspicious" and "[dry-run: would block]" in str(hit.alerts) and not any(s.status == "Blocked" for s in hit.stages)
    assert big.error_kind == "FileTypeMismatch"


def test_user_rules(spark):
    (r,) = decide(spark, [("a.txt", None, b"some forbidden words")], [signatures.Rule("words", b"forbidden")])
    assert r.verdict == "blocked" and r.parser_used == "pre_scan_blocked"
    rule = {"name": "words", "pattern": b"forbidden", "location": "LastBytes", "limit": 5}
    own = {"u": policy.profile("standard", signature_rules=[rule])}
    a, b = decide(spark, [("a.txt", None, b"some forbidden"), ("a.txt", None, b"forbidden words at the end")], policies=own)
    assert a.parser_used == "pre_scan_blocked" and b.parser_used == "other"


def test_quarantine_and_audit(spark):
    rows = [(1, "a.png", None, "t", "outgoing", bytearray(B.still()), None), (2, "b.png", None, None, "incoming", bytearray(b"MZ"), None), (3, "c.exe", None, None, "incoming", bytearray(b"x"), None), (4, "d.bin", None, None, "incoming", bytearray(b"x"), None)]
    out = pipeline.defend(spark.createDataFrame(rows, SCHEMA), policy.policy_table(spark)).cache()
    assert sorted((r.object_id, r.verdict) for r in pipeline.audit_events(out).collect()) == [(1, "clean"), (4, "blocked")]
    envelopes = {r.object_id: r for r in pipeline.quarantine(out).collect()}
    assert envelopes[2].reason == "signature_match" and envelopes[4].reason == "reconstruction_level_not_met" and set(envelopes) == {2, 4}
    reports = {r.object_id: json.loads(r.report) for r in sinks.json_report(out, "standard").collect()}
    assert len(reports[1]) == 14 and reports[1]["status"] == "Clean" and reports[2]["output_path"] is None and len(reports[3]) + 1 == 9 and reports[3]["error"] == "BlockedExtension"
    out.unpersist()


def test_wire_format(spark):
    a, b = decide(spark, [("a.png", None, B.still()), ("b.png", None, b"MZ")])
    for r in (a, b):
        data, at, fields = sinks.wire_metadata(r.asDict(True)), 0, {}
        while at < len(data):
            key, shift = 0, 0
            number, wire = data[at] >> 3, data[at] & 7
            at += 1
            key = 0
            while True:
                key |= (data[at] & 127) << shift
                shift, at = shift + 7, at + 1
                if not data[at - 1] & 128:
                    break
            if wire == 2:
                fields.setdefault(number, []).append(data[at : at + key])
                at += key
            else:
                fields.setdefault(number, []).append(key)
        assert fields.get(1, [0])[0] == sinks.VERDICTS[r.verdict] and fields[3] == [r.mime.encode()] and fields[6] == [r.sha256.encode()]
        assert len(fields[7]) == len(r.alerts) and len(fields[8]) == len(r.stages) and fields[4] == [r.input_bytes]
    rows = spark.createDataFrame([("x",)], "x string").select(F.lit(1).alias("one"))
    assert rows.count() == 1


def test_artifacts_never_overwrite(spark, tmp_path):
    rows = [(k, "a.png", None, None, "incoming", bytearray(B.still(k)), None) for k in range(3)]
    out = pipeline.defend(spark.createDataFrame(rows, SCHEMA), policy.policy_table(spark)).cache()
    (tmp_path / "1.png").write_bytes(b"mine")
    got = {r.object_id: r for r in sinks.write_artifacts(out, str(tmp_path)).collect()}
    assert got["1"].problem == "the file exists" and (tmp_path / "1.png").read_bytes() == b"mine"
    assert got["0"].problem is None and np.array_equal(png.decode((tmp_path / "0.png").read_bytes()), B.pixels(8, 6, 0))
    assert {r.problem for r in sinks.write_artifacts(out, str(tmp_path)).collect() if r.object_id != "1"} == {None}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0.png", "1.png", "2.png"]
    with pytest.raises(FileExistsError):
        sinks.write_new(str(tmp_path / "1.png"), b"other")
    out.unpersist()


def test_command_line(spark, tmp_path, capsys):
    from weir import cli

    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.png").write_bytes(B.still(3, b"x"))
    assert cli.run(spark, ["--input", str(source), "--output-dir", str(target)]) == 0
    reports = [json.loads(p.read_text()) for p in target.glob("*.json")]
    assert len(reports) == 1 and reports[0]["released"] and reports[0]["profile"] == "dissertation" and reports[0]["report_path"].endswith(".json")
    (source / "b.png").write_bytes(b"MZ")
    assert cli.run(spark, ["--input", str(source), "--output-dir", str(tmp_path / "out2"), "--profile", "standard"]) == 2
    for bad in ([], ["--input"], ["--input", "a", "--input", "b"], ["--bogus", "x"], ["--input", "a", "--output-dir", "b", "--profile", "none"]):
        assert cli.run(spark, bad) == 1


def test_policy_documents(spark):
    good = {"version": "v1", "config": {"profile": "p", "max_input_size_bytes": 1, "max_output_size_bytes": 2, "max_output_expansion_ratio": 1.5, "blocked_extensions": ["exe"]}}
    texts = [good] + [{**good, "config": {**good["config"], k: v}} for k, v in (("profile", ""), ("max_input_size_bytes", 0), ("max_output_size_bytes", 0), ("max_output_expansion_ratio", 0.0))] + [{**good, "version": "v2"}, {"version": "v1"}]
    rows = spark.createDataFrame([(k, json.dumps(t)) for k, t in enumerate(texts)] + [(99, "not json"), (100, None)], "k int, document string")
    got = {r.k: (r.valid, r.problem) for r in policy.policy_documents(rows).collect()}
    assert got[0] == (True, None) and [got[k][0] for k in range(1, 7)] == [False] * 6 and got[2][1] == "max_input_size_bytes must be > 0" and not got[99][0] and not got[100][0]


def test_profiles():
    assert policy.profile("dissertation") == policy.STRICT and policy.profile("public") == policy.STANDARD and policy.profile("high_risk") == policy.PARANOID
    assert len(policy.BLOCKED_EXTENSIONS) == 29 and policy.PARANOID["image"] == {"output_format": "Png", "max_pixels": 20_000_000, "probe_failure_mode": "Block"}
    assert policy.dry_run(policy.STRICT)["enforcement_mode"] == "DryRun" and policy.STRICT["enforcement_mode"] == "Enforce"
