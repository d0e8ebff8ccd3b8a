"""Telephony audio as a media column: mu-law and A-law by lookup tables, IMA ADPCM decoded across blocks, PCM resampled.

A media value is a RIFF/WAVE file with one channel at 8 kHz in one of three telephone codecs. Decoding gives 16-bit PCM, resampled to
16 kHz by a half-band filter. ADPCM is sequential inside a block but its blocks are independent, so numpy advances all blocks of a batch
one sample at a time. Files are worked on in slices of about a megabyte, so a task's memory follows its longest file and not its rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices

# WAVE format tags, ADPCM block size, and the step-index changes and step sizes of the IMA ADPCM standard.
TAGS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}
CODECS = ("mulaw", "alaw", "ima_adpcm")
BLOCK = 576
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int64)
RATE = 8000
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37,
    41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209,
    230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int64)


def mulaw_table() -> np.ndarray:
    """PCM value of each mu-law byte (G.711): inverted bits, sign, 3-bit exponent, 4-bit mantissa, bias 132."""
    u = ~np.arange(256) & 255
    value = (((u & 15) << 3) + 132 << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -value, value).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM value of each A-law byte (G.711): even bits inverted, sign, 3-bit exponent, 4-bit mantissa."""
    a = np.arange(256) ^ 0x55
    exponent, mantissa = (a >> 4) & 7, ((a & 15) << 4) + 8
    value = np.where(exponent > 0, mantissa + 256 << np.maximum(exponent - 1, 0), mantissa)
    return np.where(a & 128, value, -value).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks (one row of bytes each): a header of first sample and step index, then two samples a byte, low nibble first.

    A step index above 88 in a header counts as 88. Memory: 4 bytes a sample beside the blocks.
    """
    n, width = blocks.shape
    predictor = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(blocks[:, 2].astype(np.int64), 88)
    body = blocks[:, 4:].T
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    out[0] = predictor
    for k in range(width - 4):
        byte = body[k].astype(np.int64)
        for half, nibble in enumerate((byte & 15, byte >> 4)):
            step = STEPS[index]
            size = nibble & 7
            change = (step >> 3) + (size >> 2) * step + ((size >> 1) & 1) * (step >> 1) + (size & 1) * (step >> 2)
            predictor = np.clip(predictor + np.where(nibble & 8, -change, change), -32768, 32767)
            index = np.clip(index + INDEX_STEP[size], 0, 88)
            out[1 + 2 * k + half] = predictor
    return np.ascontiguousarray(out.T)


def wave(codec: str, data: bytes) -> bytes:
    """A one-channel 8 kHz WAVE file with ``data`` in ``codec``."""
    adpcm = codec == "ima_adpcm"
    per_block = 1 + 2 * (BLOCK - 4)
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, RATE, RATE * BLOCK // per_block if adpcm else RATE, BLOCK if adpcm else 1, 4 if adpcm else 8)
    fmt += struct.pack("<HH", 2, per_block) if adpcm else struct.pack("<H", 0)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[str, bytes]:
    """Codec and data of a file of ``wave``. Raises ValueError for anything else."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, tag, data = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
            if len(data) != size:
                raise ValueError("cut short")
        at += 8 + size + size % 2
    codec = {v: k for k, v in TAGS.items()}.get(tag)
    if codec is None or data is None:
        raise ValueError("no telephone codec or no data")
    return codec, data


def expand(codec: str, data: bytes) -> np.ndarray:
    """16-bit PCM at 8 kHz. ADPCM data after its last whole block is not sound."""
    raw = np.frombuffer(data, np.uint8)
    if codec == "ima_adpcm":
        return decode_adpcm(raw[: len(raw) // BLOCK * BLOCK].reshape(-1, BLOCK)).ravel()
    return (MULAW if codec == "mulaw" else ALAW)[raw]


def half_band(pairs: int = 6, bits: int = 14) -> np.ndarray:
    """Weights of the samples on either side of a new one, nearest first: a sinc under a Hann window, in units of ``2**-bits``; twice their sum is 1."""
    at = np.arange(pairs) + 0.5
    weight = np.sinc(at) * np.cos(np.pi * at / (2 * pairs + 1)) ** 2
    whole = np.round(weight / (2 * weight.sum()) * (1 << bits)).astype(np.int32)
    whole[0] += (1 << bits - 1) - whole.sum()
    return whole


HALF_BAND, HALF_BITS = half_band(), 14


def resample(pcm: np.ndarray) -> np.ndarray:
    """16 kHz from 8 kHz: the samples as they are, and between each two one from the half-band filter, rounded half up; the ends are held."""
    out, n, taps = np.empty(2 * len(pcm), np.int16), len(pcm), len(HALF_BAND)
    if n:
        wide = np.pad(pcm.astype(np.int32), taps, "edge")
        between = np.full(n, 1 << HALF_BITS - 1, np.int32)
        for j, w in enumerate(HALF_BAND):
            between += w * (wide[taps - j : taps - j + n] + wide[taps + 1 + j : taps + 1 + j + n])
        out[::2], out[1::2] = pcm, np.clip(between >> HALF_BITS, -32768, 32767)
    return out


def feature_of(codec: str, pcm: np.ndarray) -> str:
    """Codec, samples, peak, mean square and sign changes of resampled PCM, and its CRC."""
    wide = pcm.astype(np.int64)
    square = int(wide @ wide) // max(1, len(wide))
    signs = pcm < 0
    return f"{codec}:{len(pcm)}:{int(np.abs(wide).max(initial=0))}:{square}:{int((signs[1:] != signs[:-1]).sum())}:{zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (-len(raw) % BLOCK if raw else BLOCK)


def encode_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``media``: each text's bytes as telephone sound.

    The UTF-8 text (null: empty) is filled up with bytes 255 to a positive multiple of 576, and is the file's data as it stands, so
    nothing is lost; its checksum picks the codec. Equal texts give equal media, repeated rows and rows without id each their own. Long
    texts give long files, one at a time in memory. Other columns are not read; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                made = [payload_of(t) for t in part.column(1).to_pylist()]
                media = [wave(CODECS[zlib.crc32(p) % 3], p) for _, p in made]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame, *, keep_pcm: bool = True) -> DataFrame:
    """Decode column ``media`` (other columns stay): ``payload`` digests, ``feature`` and, with ``keep_pcm``, ``pcm`` at 16 kHz (little-endian).

    Blocks of all ADPCM files of a slice are decoded together. Null media give nulls; media that aren't such files raise ValueError.
    Columns of the names that it adds are replaced.
    """
    bounded_batches(media.sparkSession)
    added = [("payload_bytes", "long", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "long", pa.int64()), ("feature", "string", pa.string()), ("pcm", "binary", pa.binary())][: 4 + keep_pcm]
    kept = [f for f in media.schema if f.name not in ("pcm", "feature", "payload_bytes", "payload_sha256", "tail_crc32")]
    at = [f.name for f in kept].index("media")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} {t}" for n, t, _ in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                rows = decode([None if m is None else read_wave(m) for m in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([r[k] for r in rows], t) for k, (_, _, t) in enumerate(added))], names=[*part.schema.names, *(n for n, _, _ in added)])

    def decode(read: list) -> list[tuple]:
        tied = [i for i, x in enumerate(read) if x and x[0] == "ima_adpcm"]
        sound: dict[int, np.ndarray] = {}
        if tied:
            blocks = [np.frombuffer(read[i][1], np.uint8)[: len(read[i][1]) // BLOCK * BLOCK].reshape(-1, BLOCK) for i in tied]
            pcm, ends = decode_adpcm(np.concatenate(blocks)), np.cumsum([*map(len, blocks)])
            sound = {i: pcm[e - len(b) : e].ravel() for i, e, b in zip(tied, ends, blocks, strict=True)}
        rows = []
        for i, x in enumerate(read):
            if x is None:
                rows.append((None,) * len(added))
                continue
            codec, data = x
            pcm = resample(sound[i] if i in sound else expand(codec, data))
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), feature_of(codec, pcm), *([pcm.astype("<i2").tobytes()] * keep_pcm)))
        return rows

    return media.select(*(f.name for f in kept)).mapInArrow(run, schema)


def store_media(docs: DataFrame, path: str, **options: str) -> DataFrame:
    """Write each document's sound to Parquet at ``path``: the file as it came (``media``), and ``pcm`` at 16 kHz with the other columns of ``decode_media``. The table read back."""
    decode_media(encode_documents(docs, **options)).write.option("compression", "zstd").mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)
