"""Telephony codecs and the resampler, sample by sample."""

import math
import random
import struct

import numpy as np

from marram.llm import audio

STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544,
    598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635,
    13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]


def mulaw(code: int) -> int:
    code = 255 - code
    size = (2 * (code & 15) + 33) * 2 ** (code >> 4 & 7) - 33
    return -4 * size if code & 128 else 4 * size


def alaw(code: int) -> int:
    code ^= 0x55
    segment, step = code >> 4 & 7, code & 15
    size = (2 * step + 1) * 8 if segment == 0 else (2 * step + 33) * 2 ** (segment - 1) * 8
    return size if code & 128 else -size


def adpcm(block: bytes) -> list[int]:
    value, index = struct.unpack_from("<hB", block)
    index = min(index, 88)
    out = [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = STEPS[index]
            change = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
            value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
            index = max(0, min(88, index + (-1 if nibble & 7 < 4 else 2 * (nibble & 7) - 6)))
            out.append(value)
    return out


def resampled(signal: list[int], up: int, down: int) -> list[int]:
    filters = audio.polyphase(up, down).tolist()
    out = []
    for m in range(math.ceil(len(signal) * up / down)):
        at, phase = divmod(m * down, up)
        total = 1 << 13
        for k, weight in enumerate(filters[phase]):
            place = at + k - (audio.TAPS // 2 - 1)
            total += weight * (signal[place] if 0 <= place < len(signal) else 0)
        out.append(max(-32768, min(32767, total >> 14)))
    return out


def test_tables():
    assert audio.MULAW.tolist() == [mulaw(k) for k in range(256)]
    assert audio.ALAW.tolist() == [alaw(k) for k in range(256)]


def test_blocks():
    draw = random.Random(1)
    blocks = [draw.randbytes(36) for _ in range(50)] + [bytes(36), b"\xff" * 36, b"\xff\x7f\x58\x00" + b"\x77" * 32]
    got = audio.decode_blocks(np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 36))
    assert got.tolist() == [adpcm(x) for x in blocks]


def test_resampler():
    draw = random.Random(2)
    signals = [[draw.randrange(-32768, 32768) for _ in range(n)] for n in (1, 2, 7, 8, 100, 333)] + [[1000] * 60]
    for up, down in ((2, 1), (1, 2), (16000, 8000), (3, 2), (160, 441)):
        common = math.gcd(up, down)
        got = audio.resample([np.array(x, np.int16) for x in signals], up, down)
        assert [x.tolist() for x in got] == [resampled(x, up // common, down // common) for x in signals]
    assert audio.resample([np.full(60, 1000, np.int16)], 2, 1)[0][20:80].tolist() == [1000] * 60  # filters sum to one


def test_stored_pcm(spark, small):
    rows = audio.op1_telephony(spark, small).limit(20).collect()
    for r in rows:
        codec, rate, data = audio.read_wav(bytes(r["pcm"]))
        samples = np.frombuffer(data, "<i2").astype(np.int64)
        made = r["feature"].split(":")
        assert (codec, rate) == ("pcm", 16000) and len(samples) == int(made[2]) and int((samples**2).sum()) == int(made[4])
