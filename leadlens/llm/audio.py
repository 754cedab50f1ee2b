"""Telephony audio columns: G.711 mu-law and A-law by lookup tables, IMA ADPCM by numpy across blocks, resampled PCM.

Media are RIFF files. Compressed samples are stored as they are, so that the payload comes back bit for bit, and
decoded to 16-bit PCM where features or another rate are wanted.
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
from pyspark.sql import types as T

from leadlens.llm.common import slices, tidy, utf8

RATE, UNIT = 8000, 576
#: The rate that decoded PCM is stored at.
WIDE = 2 * RATE
#: Format tags of RIFF files: fixed values.
TAGS = {"pcm": 1, "alaw": 6, "mulaw": 7, "ima": 17}
#: Bytes of an IMA ADPCM block: a header of 4 and two samples a byte.
ADPCM_BLOCK = 192


def _mulaw_table() -> np.ndarray:
    x = ~np.arange(256, dtype=np.int64) & 255
    magnitude = ((((x & 15) << 3) + 132) << ((x >> 4) & 7)) - 132
    return np.where(x & 128, -magnitude, magnitude).astype(np.int16)


def _alaw_table() -> np.ndarray:
    x = np.arange(256, dtype=np.int64) ^ 0x55
    exponent, mantissa = (x >> 4) & 7, (x & 15) << 4
    magnitude = np.where(exponent == 0, mantissa + 8, (mantissa + 264) << np.maximum(exponent - 1, 0))
    return np.where(x & 128, magnitude, -magnitude).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()

#: IMA ADPCM step sizes and index moves: fixed values.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
_NIBBLE = np.arange(16)
#: Difference and next index for every (index, nibble).
_DIFF = ((STEPS[:, None] >> 3) + np.where(_NIBBLE & 1, STEPS[:, None] >> 2, 0) + np.where(_NIBBLE & 2, STEPS[:, None] >> 1, 0) + np.where(_NIBBLE & 4, STEPS[:, None], 0)) * np.where(_NIBBLE & 8, -1, 1)
_DIFF = _DIFF.astype(np.int32).ravel()
_NEXT = np.clip(np.arange(89)[:, None] + MOVES[_NIBBLE & 7], 0, 88).astype(np.int32).ravel()


def expand(samples: np.ndarray, law: str) -> np.ndarray:
    """8-bit G.711 samples as 16-bit PCM."""
    return {"mulaw": MULAW, "alaw": ALAW}[law][samples]


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM blocks, one a row, as 16-bit PCM, one block a row: all blocks advance together, sample by sample."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, 88)
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.uint8)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    for k, code in enumerate(codes):
        at = index * 16 + code
        value = np.clip(value + _DIFF[at], -32768, 32767)
        index = _NEXT[at]
        out[k + 1] = value
    return out.T


def resampled(pcm: np.ndarray, have: int, want: int) -> np.ndarray:
    """16-bit samples at another rate by linear interpolation in integers; beyond the last sample it repeats."""
    if have == want or not len(pcm):
        return pcm
    at = np.arange(-(-len(pcm) * want // have), dtype=np.int64) * have
    k, part = at // want, at % want
    a, b = pcm[k].astype(np.int64), pcm[np.minimum(k + 1, len(pcm) - 1)].astype(np.int64)
    return (a + (b - a) * part // want).astype(np.int16)


def doubled(pcm: np.ndarray) -> np.ndarray:
    """resampled() to twice the rate, with less arithmetic."""
    out = np.repeat(pcm, 2)
    out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
    return out


def riff(payload: bytes, kind: str, rate: int = RATE) -> bytes:
    """A mono RIFF file around samples that are stored as they are."""
    bits, block = {"pcm": (16, 2), "ima": (4, ADPCM_BLOCK)}.get(kind, (8, 1))
    per_block = 2 * (ADPCM_BLOCK - 4) + 1 if kind == "ima" else 1
    form = struct.pack("<HHIIHHH", TAGS[kind], 1, rate, rate * block // per_block, block, bits, 0 if kind != "ima" else 2)
    form += struct.pack("<H", per_block) if kind == "ima" else b""
    fact = struct.pack("<4sII", b"fact", 4, len(payload) // block * per_block)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(form)) + form + fact + struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def unriff(media: bytes) -> tuple[str, int, bytes]:
    """(kind, rate, samples) of a RIFF file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, kind, rate = 12, "", 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
            kind = {v: k for k, v in TAGS.items()}[tag]
        elif name == b"data":
            return kind, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def _pcm(kind: str, payload: bytes) -> np.ndarray:
    raw = np.frombuffer(payload, np.uint8)
    if kind == "ima":
        raw = raw[: len(raw) // ADPCM_BLOCK * ADPCM_BLOCK]
        return decode_adpcm(raw.reshape(-1, ADPCM_BLOCK)).ravel()
    return raw.view("<i2") if kind == "pcm" else expand(raw, kind)


def decode_media(docs: DataFrame, media: str = "media", rate: int = WIDE) -> DataFrame:
    """Adds ``pcm``, a RIFF file of 16-bit samples resampled to ``rate``, and ``pcm_rate``; columns of these names are replaced.

    Any stored rate is resampled. Null media give null; so do bytes that are no RIFF file of the four kinds. All rows and
    other columns stay.
    """
    docs = docs.drop("pcm", "pcm_rate")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media):
                pcm, rates = [], []
                for m in part.column(media).to_pylist():
                    try:
                        kind, stored, payload = unriff(m or b"")
                        pcm.append(riff(resampled(_pcm(kind, payload), stored, rate).astype("<i2").tobytes(), "pcm", rate))
                        rates.append(rate)
                    except (ValueError, KeyError, struct.error, ZeroDivisionError):
                        pcm.append(None)
                        rates.append(None)
                yield pa.record_batch([*part.columns, pa.array(pcm, pa.binary()), pa.array(rates, pa.int32())], [*part.schema.names, "pcm", "pcm_rate"])

    schema = T.StructType([*docs.schema, T.StructField("pcm", T.BinaryType()), T.StructField("pcm_rate", T.IntegerType())])
    return docs.mapInArrow(tidy(run), schema)


def features(payloads: list[bytes], pcm: list[bytes]) -> list[str]:
    """Integer features of mu-law payloads and of their stored PCM, the same for the same payload: level, zero crossings and
    peak of the PCM at 16 kHz, the payload's level under A-law, and its level decoded as ADPCM blocks."""
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    ends = np.cumsum([len(p) for p in payloads])
    blocks = decode_adpcm(raw.reshape(-1, ADPCM_BLOCK))
    levels = np.abs(blocks.astype(np.int64)).sum(axis=1)
    a = np.abs(expand(raw, "alaw").astype(np.int64))
    out, lo = [], 0
    for hi, samples in zip(ends.tolist(), pcm, strict=True):
        wide = np.frombuffer(samples, "<i2")
        crossings = int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))
        size = np.abs(wide.astype(np.int32))
        out.append(f"mulaw:{int(size.sum(dtype=np.int64)) // len(wide)}:{crossings}:{int(size.max())};alaw:{int(a[lo:hi].sum()) // (hi - lo)};ima:{int(levels[lo // ADPCM_BLOCK : hi // ADPCM_BLOCK].sum()) // ((hi - lo) // ADPCM_BLOCK * blocks.shape[1])}")
        lo = hi
    return out


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = part.column("text").to_pylist()
            media = [riff(t + b"\xff" * (-len(t) % UNIT or (UNIT if not t else 0)), "mulaw") for t in texts]
            back = [unriff(m)[2] for m in media]
            pcm = [riff(doubled(MULAW[np.frombuffer(p, np.uint8)]).astype("<i2").tobytes(), "pcm", WIDE) for p in back]
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                    "payload": pa.array(back, pa.binary()),
                    "media": pa.array(media, pa.binary()),
                    "pcm": pa.array(pcm, pa.binary()),
                    "feature": pa.array(features(back, [unriff(m)[2] for m in pcm]), pa.string()),
                }
            )


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))


def store_texts(docs: DataFrame) -> DataFrame:
    """Texts as mu-law media, read back, and their PCM at 16 kHz: doc_id, n_bytes, payload, media, pcm, feature.

    The payload is the UTF-8 text with bytes 255 up to a positive multiple of 576. Null text counts as empty; long texts
    are stored whole. Repeated rows and rows without an id are kept as they are; equal texts have equal values. Other
    columns are ignored, whatever their names. An empty table gives no rows.
    """
    return _input(docs).mapInArrow(tidy(_store), "doc_id long, n_bytes long, payload binary, media binary, pcm binary, feature string")


def digests(docs: DataFrame) -> DataFrame:
    """Sizes and checksums of what store_texts() returns for docs, in the pass that stores and reads: the media don't move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
        size = lambda xs: pa.array([len(x) for x in xs], pa.int64())
        for batch in _store(batches):
            payload, media, pcm = (batch.column(c).to_pylist() for c in ("payload", "media", "pcm"))
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": batch.column("n_bytes"),
                    "payload_bytes": size(payload),
                    "payload_sha256": sha(payload),
                    "tail_crc32": pa.array([zlib.crc32(p[-32:]) for p in payload], pa.int64()),
                    "media_bytes": size(media),
                    "media_sha256": sha(media),
                    "feature": batch.column("feature"),
                    "pcm_bytes": size(pcm),
                    "pcm_sha256": sha(pcm),
                }
            )

    return _input(docs).mapInArrow(tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string")
