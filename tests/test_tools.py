import os
import stat

import pytest

from weir.operators import rebuild, tools
from weir.operators.containers import Malformed
from weir.plans import policy

from . import builders as B


def script(path, body):
    path.write_text("#!/bin/sh\n" + body)
    path.chmod(path.stat().st_mode | stat.S_IEXEC)
    return str(path)


def test_bounded_children(tmp_path):
    done = tools.run_bounded([script(tmp_path / "a", "echo out; echo err >&2; exit 3")], 5)
    assert (done.ok, done.out, done.err) == (False, b"out\n", b"err\n")
    with pytest.raises(Exception, match="timed out"):
        tools.run_bounded([script(tmp_path / "b", "exec sleep 30")], 0.3)
    assert len(tools.run_bounded([script(tmp_path / "c", "head -c 3000000 /dev/zero")], 20).out) == tools.KEPT_OUTPUT
    assert not tools.available(str(tmp_path / "missing"), 1)


def test_probe_lines():
    assert tools.parse_probe("bit_rate=5\nbit_rate=N/A\nbit_rate=9\nduration=1.5\nduration=2\nchannels=2") == {"duration": 2.0, "bit_rate": 9, "channels": 2}
    for bad in ("", "bit_rate=N/A", "nothing"):
        with pytest.raises(ValueError):
            tools.parse_probe(bad)


def fake(tmp_path, output, probe="duration=1\nchannels=1\nbit_rate=1000"):
    source = tmp_path / "made"
    source.write_bytes(output)
    return {"ffmpeg_bin": script(tmp_path / "enc", f'for last; do :; done; cp {source} "$last"'), "ffprobe_bin": script(tmp_path / "probe", f"printf '{probe}\\n'")}


def test_transcoding(tmp_path):
    strict = {**policy.STRICT["audio"], **fake(tmp_path, B.mp3(False))}
    got = tools.transcode("audio", B.wav(), "audio/x-wav", strict, True)
    assert got["mime"] == "audio/mpeg" and got["output"] == B.mp3(False) and got["stages"][-1][2] == "achieved_reconstruction=semantic"
    for change, output in ((({"max_duration_secs": 0}), B.mp3()), ({"max_channels": 0}, B.mp3()), ({}, b""), ({}, b"MZ..."), ({"ffmpeg_bin": "/none"}, B.mp3()), ({"ffprobe_bin": "/none"}, B.mp3())):
        os.makedirs(tmp_path / "x", exist_ok=True)
        p = {**policy.STRICT["audio"], **fake(tmp_path / "x", output), **change}
        with pytest.raises(Malformed):
            tools.transcode("audio", B.wav(), None, p, True)
    loose = {**policy.STANDARD["audio"], **fake(tmp_path / "x", b"")}
    got = tools.transcode("audio", B.wav(), None, loose, False)
    assert got["mime"] == "audio/raw" and got["output"] == B.wav() and got["alerts"][-1][0] == "ffmpeg_empty_output_audio"
    film = {**policy.STRICT["video"], **fake(tmp_path / "x", B.mp4())}
    assert tools.transcode("video", b"x", None, film, True)["mime"] == "video/mp4"
    with pytest.raises(Malformed):
        tools.transcode("video", b"", None, film, True)


def test_types_of_an_encoders_output(tmp_path):
    """The output has to be sound, of the planned type, and where the codec is kept of the original's."""
    keep = {**policy.STANDARD["audio"], "output_codec": "KeepOriginalWhenPossible"}
    cases = [("audio/mpeg", B.mp3(False), None), ("audio/mpeg", B.still(), "ffmpeg_non_audio_mime_audio"), ("audio/mpeg", B.wav(), "ffmpeg_audio_mime_mismatch"), ("audio/wav", B.wav(), None), ("audio/x-wav", B.wav(), None)]
    for k, (mime, output, code) in enumerate(cases):
        os.makedirs(tmp_path / str(k), exist_ok=True)
        p = {**keep, **fake(tmp_path / str(k), output)}
        got = tools.transcode("audio", b"input", mime, p, False)
        assert [a[0] for a in got["alerts"]] == ([code] if code else []) and got["mime"] == ("audio/raw" if code else {"audio/mpeg": "audio/mpeg"}.get(mime, "audio/wav"))
        if code:
            with pytest.raises(Malformed):
                tools.transcode("audio", b"input", mime, p, True)
    assert [tools.names.canonical_audio_of(m) for m in ("audio/ogg", "audio/opus", "audio/x-wav", "audio/amr")] == ["audio/opus", "audio/opus", "audio/wav", "audio/unknown"]


def test_original_codec():
    keep = {**policy.STANDARD["audio"], "output_codec": "KeepOriginalWhenPossible"}
    assert tools.plan_of(keep, "audio/x-flac")[0][1] == "audio/flac" and tools.plan_of(keep, "audio/amr") == (tools.CODECS["Mp3"], False)
    assert tools.plan_of({**keep, "mode": "RequireFfmpeg"}, "audio/x-flac")[0][1] == "audio/mpeg"


def test_rows_never_fail_the_task(monkeypatch):
    def broken(*a):
        raise RuntimeError("secret bytes")

    monkeypatch.setattr(rebuild, "image", broken)
    got = rebuild.one(b"x", "image", None, policy.STRICT)
    assert got["error_kind"] == "HandlerPanic" and got["error_message"] == "RuntimeError"
    quarantined = rebuild.one(b"x", "image", None, policy.STANDARD)
    assert quarantined["alerts"][-1]["code"] == "decoder_failure_quarantine" and not quarantined["read_ok"]
    assert rebuild.one(None, "image", None, policy.STANDARD) is None
