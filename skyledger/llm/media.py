"""Media columns: telephony audio (G.711 mu-law and A-law, IMA ADPCM) to linear PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import schema_and

# Format tags of RIFF WAVE.
PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
TAGS = {"pcm": PCM, "alaw": ALAW, "mulaw": MULAW, "ima": IMA}
PAD = 64


def mulaw_table() -> np.ndarray:
    """Linear values of the 256 mu-law codes (G.711), from their sign, exponent and mantissa."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear values of the 256 A-law codes (G.711)."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def ima_steps() -> np.ndarray:
    """The 89 IMA step sizes."""
    # Fixed values of the IMA ADPCM format.
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
        2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ], dtype=np.int32)


MULAW_PCM, ALAW_PCM, STEPS = mulaw_table(), alaw_table(), ima_steps()
INDEX_MOVE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


def decode_ima(data: bytes, block: int) -> np.ndarray:
    """Mono IMA ADPCM: the loop goes over the samples of a block, each step over all blocks at once.

    A last block that is short is decoded as far as it goes; under 4 bytes it holds no sample.
    """
    if block < 5:
        raise ValueError("a block holds a header of 4 bytes and samples")
    whole = len(data) // block
    tail = data[whole * block :]
    parts = [_ima_blocks(np.frombuffer(data, np.uint8, whole * block).reshape(whole, block))] if whole else []
    if len(tail) >= 4:
        parts.append(_ima_blocks(np.frombuffer(tail, np.uint8).reshape(1, -1)))
    return np.concatenate(parts) if parts else np.zeros(0, np.int16)


def _ima_blocks(rows: np.ndarray) -> np.ndarray:
    head = rows[:, :4].astype(np.int32)
    value = (head[:, 0] | head[:, 1] << 8).astype(np.uint16).astype(np.int16).astype(np.int32)
    index = np.minimum(head[:, 2], len(STEPS) - 1)
    body = rows[:, 4:]
    out = np.empty((len(rows), 1 + 2 * body.shape[1]), np.int16)
    out[:, 0] = value
    for k in range(2 * body.shape[1]):
        nibble = (body[:, k // 2] >> (4 * (k % 2))) & 15
        step = STEPS[index]
        move = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
        value = np.clip(value + np.where(nibble & 8, -move, move), -32768, 32767)
        index = np.clip(index + INDEX_MOVE[nibble], 0, len(STEPS) - 1)
        out[:, k + 1] = value
    return out.ravel()


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation on integers: sample k lies at k * rate / to; past the last sample its value holds."""
    n = len(pcm) * to // rate
    if rate == to or not n:
        return pcm[:n].astype(np.int16)
    at = np.arange(n, dtype=np.int64) * rate
    left = at // to
    low = pcm.astype(np.int64)
    high = low[np.minimum(left + 1, len(pcm) - 1)]
    low = low[left]
    return (low + (high - low) * (at - left * to) // to).astype(np.int16)


def to_wav(data: bytes, tag: int, rate: int, bits: int, block: int = 1) -> bytes:
    """A RIFF WAVE file of one channel; odd data get the pad byte that the format asks for."""
    head = struct.pack("<HHIIHHH", tag, 1, rate, rate * bits // 8, block, bits, 0)
    chunks = b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def from_wav(stored: bytes) -> tuple[int, int, int, bytes]:
    """(tag, rate, block, data); chunks of other kinds are passed over."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, form = 12, None
    while at + 8 <= len(stored):
        kind, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if kind == b"fmt ":
            form = struct.unpack_from("<HHIIHH", stored, at + 8)
        elif kind == b"data" and form:
            return form[0], form[2], form[4], stored[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def decode(stored: bytes, rate_out: int) -> np.ndarray:
    """PCM at rate_out from a stored file of any of the four kinds."""
    tag, rate, block, data = from_wav(stored)
    if tag in (MULAW, ALAW):
        pcm = (MULAW_PCM if tag == MULAW else ALAW_PCM)[np.frombuffer(data, np.uint8)]
    elif tag == IMA:
        pcm = decode_ima(data, block)
    elif tag == PCM:
        pcm = np.frombuffer(data, "<i2", len(data) // 2)
    else:
        raise ValueError(f"format tag {tag}")
    return resample(pcm, rate, rate_out)


def feature(pcm: np.ndarray) -> str:
    """samples : peak : mean size : sign changes : checksum of the resampled little-endian PCM."""
    wide = pcm.astype(np.int32)
    turns = int(np.count_nonzero(np.signbit(wide[1:]) != np.signbit(wide[:-1])))
    size = np.abs(wide)
    return f"{len(pcm)}:{int(size.max(initial=0))}:{int(size.sum(dtype=np.int64)) // max(1, len(pcm))}:{turns}:{zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (PAD - len(raw) % PAD if len(raw) % PAD or not raw else 0)


def store_pcm(df: DataFrame, media: str = "media", rate_out: int = 16_000, out: str = "pcm") -> DataFrame:
    """df with out: the column media (stored files, null stays null) as PCM files at rate_out. Malformed files give null."""
    at = df.columns.index(media)
    schema = schema_and(df.drop(out), **{out: "binary"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for x in batch.column(at):
                try:
                    made.append(None if not x.is_valid else to_wav(decode(x.as_py(), rate_out).astype("<i2").tobytes(), PCM, rate_out, 16, 2))
                except (ValueError, struct.error):
                    made.append(None)
            keep = [i for i, n in enumerate(batch.schema.names) if n != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(made, pa.binary())], [*(batch.schema.names[i] for i in keep), out])

    return df.mapInArrow(run, schema)


def store_texts(df: DataFrame, codec: str = "mulaw", key: str = "doc_id", text: str = "text", rate: int = 8_000, rate_out: int = 16_000, with_media: bool = False) -> DataFrame:
    """Every text as the 8-bit samples of a telephony file, with what is computed from the file once read back.

    Columns: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and, with_media, the
    stored file and its resampled PCM. The payload is the UTF-8 text and zero bytes up to a positive multiple of 64 (a null
    text is empty: 64 zeros). codec: mulaw or alaw, whose samples are the payload's bytes; ima, whose blocks of 64 are.
    Texts are taken one at a time, so memory follows the longest one; equal texts give equal rows.
    """
    tag, block, bits = TAGS[codec], (PAD if codec == "ima" else 1), (4 if codec == "ima" else 8)
    kind = df.schema[key].dataType.simpleString()
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [f.split()[0] for f in fields.split(", ")] + (["media", "pcm"] if with_media else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, max(1, whole.num_rows), 1000):
                batch = whole.slice(start, 1000)
                rows = []
                for x in batch.column(1):
                    n, body = payload(x.as_py())
                    stored = to_wav(body, tag, rate, bits, block)
                    back = from_wav(stored)[3]
                    pcm = decode(stored, rate_out)
                    row = [n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(pcm)]
                    rows.append(row + [stored, to_wav(pcm.astype("<i2").tobytes(), PCM, rate_out, 16, 2)] * with_media)
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * 2 * with_media
                made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], [key, *names])

    extra = ", media binary, pcm binary" if with_media else ""
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, {fields}{extra}")
