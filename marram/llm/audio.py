"""Telephony audio columns: G.711 and IMA ADPCM in WAV containers.

``encode_telephony`` turns a binary or text column into WAV bytes whose sample
data are the payload itself; ``decode_telephony`` reads such bytes back, expands
mu-law and A-law with 256-entry tables, decodes ADPCM blocks step by step with
numpy across all blocks of a chunk, resamples with an integer polyphase filter
and stores 16-bit PCM.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_runs, table

#: WAV format tags.
FORMAT_TAGS = {"alaw": 0x0006, "mulaw": 0x0007, "adpcm": 0x0011}
CODEC_OF_TAG = {tag: name for name, tag in FORMAT_TAGS.items()}
CODECS = ("mulaw", "alaw", "adpcm")
#: Payloads are filled to a multiple of this; 16 ADPCM blocks of 36 bytes.
UNIT = 576
BLOCK = 36
#: Bytes of payload that are decoded together.
CHUNK = 1 << 20
TAPS = 8

#: IMA ADPCM step sizes and index changes.
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45,
    50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230,
    253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327,
    3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
    11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767,
], dtype=np.int32)
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


def mulaw_table() -> np.ndarray:
    """PCM value of each mu-law code."""
    bits = ~np.arange(256) & 0xFF
    size = ((((bits & 15) << 3) + 0x84) << ((bits >> 4) & 7)) - 0x84
    return np.where(bits & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM value of each A-law code."""
    bits = np.arange(256) ^ 0x55
    exponent, mantissa = (bits >> 4) & 7, (bits & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(bits & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def decode_blocks(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM mono: uint8 blocks (n, size) to int16 samples (n, 2 * size - 7).

    A block starts with its first sample and step index; an index above the
    table's end counts as the last. The loop runs over the nibble's place in a
    block, each step over all blocks at once.
    """
    n, size = blocks.shape
    out = np.empty((n, 1 + 2 * (size - 4)), dtype=np.int16)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(IMA_STEPS) - 1)
    out[:, 0] = value
    for k in range(2 * (size - 4)):
        nibble = (blocks[:, 4 + k // 2] >> (4 * (k & 1))) & 15
        step = IMA_STEPS[index]
        change = step >> 3
        change = change + np.where(nibble & 4, step, 0)
        change += np.where(nibble & 2, step >> 1, 0)
        change += np.where(nibble & 1, step >> 2, 0)
        value = np.clip(value + np.where(nibble & 8, -change, change), -32768, 32767)
        index = np.clip(index + IMA_INDEX[nibble], 0, len(IMA_STEPS) - 1)
        out[:, k + 1] = value
    return out


def polyphase(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """Integer filters (up, taps), each summing to 1 << 14: a Hann-windowed sinc."""
    cut = min(1.0, up / down)
    out = np.empty((up, taps), dtype=np.int64)
    for phase in range(up):
        at = np.arange(taps) - (taps // 2 - 1) - phase / up
        ideal = cut * np.sinc(cut * at) * (0.5 + 0.5 * np.cos(np.pi * at / (taps / 2 + 1)))
        out[phase] = np.rint(ideal / ideal.sum() * (1 << 14))
        out[phase, taps // 2 - 1] += (1 << 14) - out[phase].sum()
    return out


def resample(signals: list[np.ndarray], up: int, down: int) -> list[np.ndarray]:
    """Each int16 signal at up / down of its rate; ceil(n * up / down) samples.

    The signals lie in one array with silence between them. Arithmetic is in
    integers, so that a signal's result doesn't depend on its neighbours.
    """
    if up == down:
        return signals
    common = math.gcd(up, down)
    up, down = up // common, down // common
    filters, starts, at = polyphase(up, down), [], 0
    for x in signals:
        starts.append(at)
        at += -(-(len(x) + TAPS) // down) * down
    line = np.zeros(at + TAPS, dtype=np.int32)
    left = TAPS // 2 - 1
    for x, start in zip(signals, starts, strict=True):
        line[left + start : left + start + len(x)] = x
    out = np.empty(at // down * up, dtype=np.int16)
    for r in range(up):
        first, phase = divmod(r * down, up)
        total = np.full(at // down, 1 << 13, dtype=np.int64)
        for k in range(TAPS):
            total += filters[phase, k] * line[first + k : first + k + at : down][: at // down]
        out[r::up] = np.clip(total >> 14, -32768, 32767)
    return [out[s // down * up :][: -(-len(x) * up // down)] for x, s in zip(signals, starts, strict=True)]


def wav(codec: str, data: bytes, rate: int) -> bytes:
    """A RIFF WAVE file with one channel; ``pcm`` or a codec of FORMAT_TAGS."""
    if codec == "pcm":
        fmt = struct.pack("<HHIIHH", 1, 1, rate, 2 * rate, 2, 16)
        head = b"fmt " + struct.pack("<I", len(fmt)) + fmt
    else:
        adpcm = codec == "adpcm"
        per_block = 2 * BLOCK - 7 if adpcm else 1
        samples = len(data) // BLOCK * per_block if adpcm else len(data)
        byte_rate = rate * BLOCK // per_block if adpcm else rate
        fmt = struct.pack("<HHIIHH", FORMAT_TAGS[codec], 1, rate, byte_rate, BLOCK if adpcm else 1, 4 if adpcm else 8)
        fmt += struct.pack("<HH", 2, per_block) if adpcm else struct.pack("<H", 0)
        head = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples)
    body = b"WAVE" + head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[str, int, bytes]:
    """Codec, rate and sample data of a file that ``wav`` wrote."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, rate = 12, "", 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = CODEC_OF_TAG.get(tag, "pcm")
        elif name == b"data":
            return codec, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def to_pcm(parts: list[tuple[str, bytes]]) -> list[np.ndarray]:
    """16-bit samples of each (codec, data); all ADPCM blocks are decoded together."""
    raw = [np.frombuffer(data, dtype=np.uint8) for _, data in parts]
    out: list[np.ndarray] = [np.empty(0, np.int16)] * len(parts)
    blocked = [i for i, (codec, _) in enumerate(parts) if codec == "adpcm"]
    if blocked:
        counts = [len(raw[i]) // BLOCK for i in blocked]
        joined = np.concatenate([raw[i][: n * BLOCK] for i, n in zip(blocked, counts, strict=True)])
        samples, at = decode_blocks(joined.reshape(-1, BLOCK)), 0
        for i, n in zip(blocked, counts, strict=True):
            out[i] = samples[at : at + n].reshape(-1)
            at += n
    for i, (codec, data) in enumerate(parts):
        if codec in ("mulaw", "alaw"):
            out[i] = (MULAW if codec == "mulaw" else ALAW)[raw[i]]
        elif codec == "pcm":
            out[i] = np.frombuffer(data[: len(data) // 2 * 2], dtype="<i2")
    return out


def padded(text: Column) -> Column:
    """A text's UTF-8 bytes, filled with 255 to a positive multiple of UNIT."""
    data = F.coalesce(text.cast("binary"), F.lit(b"").cast("binary"))
    size = F.greatest(F.ceil(F.octet_length(data) / F.lit(UNIT)), F.lit(1)) * UNIT
    return F.rpad(data, size.cast("int"), F.lit(b"\xff").cast("binary"))


def encode_telephony(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 8000) -> DataFrame:
    """``(id, n_bytes, media)``: each row's bytes as the samples of a WAV file.

    The codec is mu-law, A-law or ADPCM by the payload's crc32, so equal texts
    get equal media. A null or empty text gives one unit of filling. Rows keep
    their multiplicity; a null id stays null; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x.as_buffer()) for x in batch.column(2)]
            for i, j in bounded_runs(sizes, CHUNK):
                payloads = batch.column(2).slice(i, j - i).to_pylist()
                media = [wav(CODECS[zlib.crc32(x) % 3], x, rate) for x in payloads]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        padded(F.col(text_col)).alias("payload"),
    )
    return rows.mapInArrow(run, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def decode_telephony(df: DataFrame, id_col: str = "doc_id", rate_out: int = 16000, keep_pcm: bool = True) -> DataFrame:
    """Read ``media`` back: the payload's digests, signal statistics and PCM.

    Columns: id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (the last 32
    bytes), media_bytes, media_sha256, feature, codec and, with ``keep_pcm``,
    pcm: a 16-bit WAV file at ``rate_out``. feature is codec, source rate,
    samples, peak, energy, sign changes and the crc32 of the resampled samples.
    Null media give nulls. A task holds CHUNK bytes of payload at a time, or one
    longer row.
    """
    fields = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, pcm binary"
    names = [x.split()[0] for x in fields.split(", ")]

    def described(media: list[bytes | None]) -> Iterator[tuple]:
        read = [read_wav(x) if x is not None else ("", 1, b"") for x in media]
        signals = to_pcm([(codec, data) for codec, _, data in read])
        out: list[np.ndarray] = [np.empty(0, np.int16)] * len(media)
        for rate in {rate for _, rate, _ in read}:
            own = [i for i, x in enumerate(read) if x[1] == rate]
            for i, y in zip(own, resample([signals[i] for i in own], rate_out, rate), strict=True):
                out[i] = y
        for x, (codec, rate, data), y in zip(media, read, out, strict=True):
            if x is None:
                yield (None,) * 8
                continue
            stored = y.astype("<i2").tobytes()
            energy = sum(int((y[k : k + CHUNK].astype(np.int64) ** 2).sum()) for k in range(0, len(y), CHUNK))
            shape = [len(y), max(int(y.max(initial=0)), -int(y.min(initial=0))), energy, int(np.count_nonzero((y[1:] < 0) != (y[:-1] < 0))), zlib.crc32(stored)]
            yield (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(x), hashlib.sha256(x).hexdigest(), ":".join(map(str, [codec, rate, *shape])), codec, wav("pcm", stored, rate_out) if keep_pcm else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(2)]
            for i, j in bounded_runs(sizes, CHUNK):
                rows = list(described(batch.column(2).slice(i, j - i).to_pylist()))
                found = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *found], names)

    out = df.select(F.col(id_col).alias("id"), "n_bytes", "media").mapInArrow(run, fields).withColumnRenamed("id", id_col)
    return out if keep_pcm else out.drop("pcm")


def op1_telephony(spark, sf_dir: str) -> DataFrame:
    """Every text's bytes as telephone audio: digests of what is stored, its features, and the resampled PCM as a WAV file.

    Null and empty texts are one unit of filling; equal texts have equal values;
    repeated rows keep their rows; an empty table gives no rows.
    """
    return decode_telephony(encode_telephony(table(spark, sf_dir, "documents")))
