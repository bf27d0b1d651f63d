"""Telephony audio columns: 8-bit mu-law and A-law, IMA ADPCM blocks, and resampled 16-bit PCM.

Companded samples are expanded by tables of 256 values; the tables are made by rule from the codec's
definition. ADPCM blocks stand as rows of one matrix and are decoded in step, a nibble of every block
at a time. PCM is resampled from 8 to 16 kHz by a short half-band filter and can be stored as WAV.

A payload is stored losslessly as the data of a WAV file of 8-bit mu-law samples (format 7, mono,
8 kHz): every byte is a code, and the stored codes are the payload. A null payload counts as empty.
Payloads are padded with zero bytes to a positive multiple of 64. Equal payloads give equal rows. Long
payloads are taken whole; an empty table gives no rows. Columns of the input are passed on if they are
named in `keep`, unless they are called like a result, which then wins.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphquarry.llm import batches as B

UNIT = 64
RATE = 8000
PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17
#: Fixed values of the IMA ADPCM format: change of the step index by nibble.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: Fixed values of the IMA ADPCM format: step sizes.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
        7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)


def mu_law_table() -> np.ndarray:
    """PCM of each mu-law code: inverted sign, 3 bits of exponent, 4 of mantissa, bias 33 at 14 bits."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 15) << 1) + 33) << ((code >> 4) & 7)) - 33
    return (np.where(code & 0x80, -size, size) * 4).astype(np.int16)


def a_law_table() -> np.ndarray:
    """PCM of each A-law code: even bits inverted, 3 bits of exponent, 4 of mantissa, 13 bits."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    low, exponent = ((code & 15) << 1) + 1, (code >> 4) & 7
    size = np.where(exponent > 0, (low + 32) << np.maximum(exponent - 1, 0), low)
    return (np.where(code & 0x80, size, -size) * 8).astype(np.int16)


MU_LAW_PCM, A_LAW_PCM = mu_law_table(), a_law_table()


def adpcm_blocks(data: np.ndarray, block: int = UNIT) -> np.ndarray:
    """PCM of IMA ADPCM blocks, a row each: the sample of the header, then two for each further byte, low nibble first.

    A step index beyond the table counts as its last; block headers hold a 16-bit sample, the index and a spare byte.
    """
    rows = data.reshape(-1, block)
    value = rows[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(rows[:, 2].astype(np.int32), len(STEPS) - 1)
    out = np.empty((1 + 2 * (block - 4), len(rows)), np.int16)
    out[0] = value
    columns = np.ascontiguousarray(rows[:, 4:].T)
    for i in range(2 * (block - 4)):
        nibble = (columns[i // 2] >> (4 * (i & 1))) & 15
        step = STEPS[index]
        change = step >> 3
        change += np.where(nibble & 4, step, 0)
        change += np.where(nibble & 2, step >> 1, 0)
        change += np.where(nibble & 1, step >> 2, 0)
        value = np.clip(np.where(nibble & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[nibble], 0, len(STEPS) - 1)
        out[i + 1] = value
    return out.T


def resampled(pcm: np.ndarray) -> np.ndarray:
    """Twice the samples: each one, and between each two the half-band value (-1 5 5 -1) / 8; ends repeat."""
    if not len(pcm):
        return pcm.astype(np.int16)
    x = np.concatenate([pcm[:1], pcm, pcm[-1:], pcm[-1:]]).astype(np.int32)
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    out[1::2] = np.clip((5 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 4) >> 3, -32768, 32767)
    return out


def wav(data: bytes, kind: int = MU_LAW, rate: int = RATE, bits: int = 8, align: int = 1, samples: int | None = None) -> bytes:
    """A mono WAV file of the data; formats other than PCM state their number of samples."""
    extra = struct.pack("<HH", 2, 2 * (align - 4) + 1) if kind == IMA_ADPCM else b"" if kind == PCM else struct.pack("<H", 0)
    per_second = rate * align if kind != IMA_ADPCM else rate * align // (2 * (align - 4) + 1)
    form = struct.pack("<HHIIHH", kind, 1, rate, per_second, align, bits) + extra
    fact = b"" if kind == PCM else struct.pack("<4sII", b"fact", 4, len(data) if samples is None else samples)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(form)) + form + fact + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) & 1)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def wav_data(file: bytes) -> tuple[int, int, int, bytes]:
    """(format, rate, align, data) of a mono WAV file."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data = 12, None, None
    while at + 8 <= len(file):
        name, size = struct.unpack_from("<4sI", file, at)
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", file, at + 8)
        elif name == b"data":
            data = file[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if form is None or data is None:
        raise ValueError("a WAV file without format or data")
    return form[0], form[2], form[4], data


def decoded(kind: int, data: bytes, align: int) -> np.ndarray:
    """16-bit PCM of stored data."""
    raw = np.frombuffer(data, np.uint8)
    if kind == MU_LAW:
        return MU_LAW_PCM[raw]
    if kind == A_LAW:
        return A_LAW_PCM[raw]
    if kind == IMA_ADPCM:
        return adpcm_blocks(raw[: len(raw) // align * align], align).reshape(-1)
    if kind == PCM:
        return raw[: len(raw) // 2 * 2].view("<i2")
    raise ValueError(f"unknown format {kind}")


def features(pcm: np.ndarray) -> str:
    """Samples, peak, root mean square, zero crossings and mean of a signal, in whole numbers."""
    if not len(pcm):
        return "n=0 peak=0 rms=0 zc=0 mean=0"
    x = pcm.astype(np.int64)
    return f"n={len(x)} peak={int(np.abs(x).max())} rms={int(np.sqrt(float(x @ x) / len(x)))} zc={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))} mean={int(x.sum()) // len(x)}"


def telephony(docs: DataFrame, payload, keep: tuple[str, ...] = ("doc_id",), kind: int = MU_LAW, files: bool = True) -> DataFrame:
    """Payloads (a binary column expression) as stored audio.

    The columns `keep`, then n_bytes (unpadded), payload_bytes, payload_sha256 and tail_crc32 of the data
    read back from the stored form, media_bytes and media_sha256 of the stored form, and feature. With
    files: also media (the stored WAV) and pcm (16 kHz, 16-bit PCM as WAV). The feature describes the
    expanded signal, its resampled form (with a checksum), and the payload read as A-law and as ADPCM blocks.
    """
    if kind not in (MU_LAW, A_LAW, IMA_ADPCM):
        raise ValueError("8-bit codes or ADPCM blocks only")
    align = UNIT if kind == IMA_ADPCM else 1
    own = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "pcm")
    keep = tuple(c for c in keep if c not in own)
    source = docs.select(B.packed(docs, keep), F.coalesce(payload, F.lit(b"")).alias("payload"))
    string, long, binary = T.StringType(), T.LongType(), T.BinaryType()
    made = [("n_bytes", long), ("payload_bytes", long), ("payload_sha256", string), ("tail_crc32", long), ("media_bytes", long), ("media_sha256", string), ("feature", string)] + [("media", binary), ("pcm", binary)] * files
    schema = T.StructType([source.schema[B.ROW], *(T.StructField(n, t) for n, t in made)])
    names = schema.names

    def rows(payloads: list[bytes]):
        stored = [wav(p + b"\0" * (-len(p) % UNIT or UNIT * (not p)), kind, bits=4 if kind == IMA_ADPCM else 8, align=align) for p in payloads]
        read = [wav_data(x) for x in stored]
        blocks = adpcm_blocks(np.frombuffer(b"".join(x[3] for x in read), np.uint8))
        end = 0
        for p, media, (form, rate, width, data) in zip(payloads, stored, read, strict=True):
            begin, end = end, end + len(data) // UNIT
            own = decoded(form, data, width) if form != IMA_ADPCM else blocks[begin:end].reshape(-1)
            wide = resampled(own)
            raw = np.frombuffer(data, np.uint8)
            law = A_LAW_PCM[raw] if form != A_LAW else MU_LAW_PCM[raw]
            feature = f"{features(own)} | 16k crc={zlib.crc32(wide.astype('<i2', copy=False)):08x} peak={int(np.abs(wide.astype(np.int32)).max(initial=0))} | law {features(law)} | adpcm {features(blocks[begin:end].reshape(-1))}"
            row = [len(p), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature]
            yield [*row, media, wav(wide.astype("<i2", copy=False).tobytes(), PCM, 2 * rate, 16, 2)] if files else row

    def run(parts):
        for part in parts:
            for a, z, data, off in B.chunks(*B.buffers(part.column(1))):
                columns = zip(*rows([data[i:j].tobytes() for i, j in zip(off.tolist(), off[1:].tolist(), strict=False)]), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, z - a), *(pa.array(x, t) for x, t in zip(columns, [pa.binary() if n in ("media", "pcm") else pa.int64() if t is long else pa.string() for n, t in made], strict=True))], names)

    return B.unpacked(B.ship(source).mapInArrow(run, schema), [*keep, *(n for n, _ in made)], {n: n for n, _ in made})
