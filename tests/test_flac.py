import hashlib
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weir.operators.codecs import Undecodable, flac
from weir.operators.rebuild import Clock, one, read_again
from weir.plans.policy import STANDARD


def signed(value, n):
    return f"{value & (1 << n) - 1:0{n}b}"


def rice(value, low):
    folded = value * 2 if value >= 0 else -value * 2 - 1
    return "0" * (folded >> low) + "1" + (f"{folded & (1 << low) - 1:0{low}b}" if low else "")


def residual(rest, order, block, low, parts, escape=False):
    out, at = "00" + f"{parts:04b}", 0
    for part in range(1 << parts):
        count = (block >> parts) - (0 if part else order)
        values, at = rest[at : at + count], at + count
        if escape:
            out += "1111" + f"{20:05b}" + "".join(signed(v, 20) for v in values)
        else:
            out += f"{low:04b}" + "".join(rice(v, low) for v in values)
    return out


def subframe(x, kind, depth):
    x, block = [int(v) for v in x], len(x)
    if kind == "constant":
        return "00000000" + signed(x[0], depth)
    if kind == "verbatim":
        return "00000010" + "".join(signed(v, depth) for v in x)
    if kind == "wasted":
        return "00000011" + "01" + "".join(signed(v >> 2, depth - 2) for v in x)
    if kind.startswith("fixed"):
        order = int(kind[5])
        rest = np.diff(np.array(x), order).tolist()
        return "0" + f"{8 + order:06b}" + "0" + "".join(signed(v, depth) for v in x[:order]) + residual(rest, order, block, 4, 2, order == 3)
    weights, shift = [14, -9, 3], 3  # linear prediction
    rest = [x[i] - (sum(w * x[i - 1 - k] for k, w in enumerate(weights)) >> shift) for i in range(3, block)]
    return "0" + f"{32 + 2:06b}" + "0" + "".join(signed(v, depth) for v in x[:3]) + f"{6 - 1:04b}" + f"{shift:05b}" + "".join(signed(w, 6) for w in weights) + residual(rest, 3, block, 5, 0)


def stream(samples, kinds, pairing=None, depth=16, rate=8000, digest=None, total=None):
    """samples: (frames, channels, block)"""
    channels, block = samples.shape[1:]
    whole = samples.swapaxes(1, 2).reshape(-1, channels)
    digest = hashlib.md5(whole.astype("<i2" if depth == 16 else "<i1").tobytes()).digest() if digest is None else digest
    fields = rate << 44 | (channels - 1) << 41 | (depth - 1) << 36 | (len(whole) if total is None else total)
    out = b"fLaC\0\0\0\x22" + struct.pack(">HH", block, block) + bytes(6) + fields.to_bytes(8, "big") + digest + b"\x84\0\0\x05words"
    for n, frame in enumerate(samples):
        code = {None: channels - 1, "left": 8, "right": 9, "middle": 10}[pairing]
        depths = [depth] * channels
        if pairing:
            a, b = frame.astype(int)
            frame = {"left": (a, a - b), "right": (a - b, b), "middle": (a + b >> 1, a - b)}[pairing]
            depths[{"left": 1, "right": 0, "middle": 1}[pairing]] += 1
        head = struct.pack(">HBBBH", 0xFFF8, 7 << 4, code << 4 | {8: 1, 16: 4}[depth] << 1, n, block - 1)
        head += bytes([flac.crc8(head)])
        bits = "".join(subframe(x, kinds[k % len(kinds)], d) for k, (x, d) in enumerate(zip(frame, depths)))
        bits += "0" * (-len(bits) % 8)
        body = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
        out += body + flac.crc16(body).to_bytes(2, "big")
    return out


def tone(frames=3, channels=2, block=64):
    t = np.arange(frames * block)
    made = np.stack([np.rint(3000 * np.sin(t / (5 + k)) + 40 * np.cos(t * 1.7)) for k in range(channels)]).astype(int)
    return made.reshape(channels, frames, block).swapaxes(0, 1) // 4 * 4


def decoded(data):
    return np.stack(list(flac.frames(data)))


@pytest.mark.parametrize("kind", ["verbatim", "wasted", "fixed0", "fixed1", "fixed2", "fixed3", "fixed4", "linear"])
@pytest.mark.parametrize("pairing", [None, "left", "right", "middle"])
def test_flac_gives_back_the_samples(kind, pairing):
    samples = tone()
    kinds = ["fixed2" if pairing and kind == "wasted" else kind]
    assert np.array_equal(decoded(stream(samples, kinds, pairing)), samples)


def test_flac_of_other_shapes():
    quiet = np.full((2, 1, 16), -7)
    assert np.array_equal(decoded(stream(quiet, ["constant"], depth=8)), quiet)
    many = tone(2, 6, 32)
    assert np.array_equal(decoded(stream(many, ["verbatim", "fixed1", "linear"])), many)
    assert decoded(stream(many, ["verbatim"], digest=bytes(16), total=0)).shape == many.shape
    long = tone(1, 2, 40000)  # a frame longer than what is looked at first
    assert np.array_equal(decoded(stream(long, ["verbatim"])), long)


def test_checksums_of_known_values():
    assert flac.crc8(b"123456789") == 0xF4 and flac.crc16(b"123456789") == 0xFEE8


def test_damaged_flac_is_not_read():
    data = stream(tone(), ["fixed2", "linear"], "middle")
    start = flac.stream(data).start
    for bad in (data[:-1], data[:-5], data + b"x", data[: start + 3], stream(tone(), ["verbatim"], digest=b"d" * 16), stream(tone(), ["verbatim"], total=9), b"fLaC", b""):
        with pytest.raises(Undecodable):
            decoded(bad)
    for k in range(start, len(data)):  # every flip within a frame is noticed
        with pytest.raises(Undecodable):
            decoded(data[:k] + bytes([data[k] ^ 0x10]) + data[k + 1 :])


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=120), st.integers(4, 60))
def test_any_bytes_give_samples_or_are_unread(tail, at):
    data = stream(tone(1), ["fixed1"])
    made = one(data[:at] + tail, "audio", "audio/x-flac", STANDARD)
    assert made["mime"] if "mime" in made else made["error_kind"] == "Audio"


def test_rebuilt_flac_can_be_released():
    data = stream(tone(), ["fixed2"])
    made = one(data, "audio", "audio/x-flac", STANDARD)
    assert made["read_ok"] and b"words" not in made["output"] and np.array_equal(decoded(made["output"]), tone()) and made["read_detail"] == "all audio read, 192 sample frames"
    short = {**STANDARD, "audio": {**STANDARD["audio"], "max_channels": 1}}
    assert not one(data, "audio", "audio/x-flac", short)["read_ok"]
    assert not one(data[:-4], "audio", "audio/x-flac", STANDARD)["read_ok"]


def test_reading_again_ends_with_the_time():
    class Ending(Clock):
        checks = 0

        def check(self):
            self.checks += 1
            if self.checks > 2:
                self.end = 0.0
            super().check()

    data = stream(tone(9), ["fixed2"])
    assert read_again("audio", data, STANDARD, Clock(None))[0] and read_again("audio", data, STANDARD, Clock(60_000))[0]
    clock = Ending(60_000)
    assert read_again("audio", data, STANDARD, clock) == (False, "the time for one object is over") and clock.checks == 3
