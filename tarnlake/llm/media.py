"""Telephony audio columns: companded (mu-law, A-law) and ADPCM bytes in WAVE files, expanded by tables and by numpy
across blocks, resampled and kept as PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.arrowtext import pieces, tidy
from tarnlake.llm.store import fresh

RATE = 8000
#: Bytes of an ADPCM block: a header of 4, then two samples in each byte.
BLOCK = 64
CODECS = ("mulaw", "alaw", "adpcm")
#: Format tags of WAVE files. Fixed values of the format.
_TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
#: What the step index moves by after each 4-bit code. Fixed values of the IMA format.
_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: Step sizes. Fixed values of the IMA format.
_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def _mulaw() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(part == 0, low + 8, (low + 264) << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw(), _alaw()


def _change() -> np.ndarray:
    """What a 4-bit code adds to the sample, by step index and code."""
    code = np.arange(16)
    step = _STEPS[:, None]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.where(code & 8, -size, size).astype(np.int32)


_CHANGE = _change()


def adpcm(data: np.ndarray) -> np.ndarray:
    """Samples of IMA blocks (whole ones), all blocks at once: a step for each place in a block, not for each sample."""
    blocks = data.reshape(-1, BLOCK)
    last = blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8
    last = np.where(last >= 32768, last - 65536, last)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out = np.empty((1 + 2 * (BLOCK - 4), len(blocks)), np.int16)
    out[0] = last
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for i, byte in enumerate(codes):
        for j, code in enumerate((byte & 15, byte >> 4)):
            last = np.clip(last + _CHANGE[index, code], -32768, 32767)
            index = np.clip(index + _MOVES[code], 0, 88)
            out[1 + 2 * i + j] = last
    return out.T.reshape(-1)


def expand(codec: str, data: np.ndarray) -> np.ndarray:
    """16-bit samples of stored bytes."""
    return adpcm(data) if codec == "adpcm" else (MULAW if codec == "mulaw" else ALAW)[data]


def doubled(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, and the mean of it and the next (the last is held)."""
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    wide = pcm.astype(np.int32)
    out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
    out[-1:] = pcm[-1:]
    return out


def stored(codec: str, payload: bytes) -> bytes:
    """The payload as a WAVE file of one channel."""
    unit, per, more = (BLOCK, 1 + 2 * (BLOCK - 4), True) if codec == "adpcm" else (1, 1, False)
    rate = RATE * unit // per
    form = struct.pack("<HHIIHH", _TAGS[codec], 1, RATE, rate, unit, 4 if more else 8) + (struct.pack("<HH", 2, per) if more else struct.pack("<H", 0))
    fact = struct.pack("<I", len(payload) // unit * per)
    chunks = b"".join(name + struct.pack("<I", len(x)) + x for name, x in ((b"fmt ", form), (b"fact", fact), (b"data", payload)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def loaded(file: bytes) -> tuple[str, bytes]:
    """Codec and payload of a WAVE file; ValueError for another kind of file."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    codec, at = None, 12
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"fmt ":
            codec = {v: k for k, v in _TAGS.items()}.get(struct.unpack_from("<H", file, at + 8)[0])
        elif name == b"data":
            if codec is None or at + 8 + size > len(file):
                raise ValueError("no known codec, or cut off")
            return codec, file[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text in UTF-8, and those with 0 appended up to a positive multiple of 64. Null counts as empty."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % BLOCK or BLOCK * (not raw))


def pick(payload: bytes) -> str:
    """The codec, by the payload's checksum, so equal payloads are stored alike."""
    return CODECS[zlib.crc32(payload) % len(CODECS)]


def feature(codec: str, pcm: np.ndarray, out: bytes) -> str:
    """Codec, samples, peak, mean square, crossings of zero, and the checksum of the resampled PCM."""
    wide = pcm.astype(np.int64)
    return f"{codec}:{len(pcm)}:{int(np.abs(wide).max())}:{int((wide * wide).sum()) // len(pcm)}:{int(((pcm[1:] < 0) != (pcm[:-1] < 0)).sum())}:{zlib.crc32(out):08x}"


def audio_of(texts: list[str | None], outputs: tuple[str, ...]) -> dict[str, list]:
    """All outputs for some texts; see audio_columns. What one codec has stored is expanded together."""
    sizes, files = [], []
    for t in texts:
        n, payload = padded(t)
        sizes.append(n)
        files.append(stored(pick(payload), payload))
    back = [loaded(f) for f in files]
    pcm: list[np.ndarray] = [np.zeros(0, np.int16)] * len(texts)
    for codec in CODECS:
        on = [k for k, x in enumerate(back) if x[0] == codec]
        if on:
            all_of = expand(codec, np.frombuffer(b"".join(back[k][1] for k in on), np.uint8))
            per = (1 + 2 * (BLOCK - 4)) / BLOCK if codec == "adpcm" else 1
            ends = np.cumsum([round(len(back[k][1]) * per) for k in on]).tolist()
            for k, a, b in zip(on, [0, *ends], ends, strict=False):
                pcm[k] = all_of[a:b]
    out = [doubled(x).tobytes() for x in pcm]
    made = {
        "n_bytes": lambda: sizes,
        "payload_bytes": lambda: [len(x) for _, x in back],
        "payload_sha256": lambda: [hashlib.sha256(x).hexdigest() for _, x in back],
        "tail_crc32": lambda: [zlib.crc32(x[-BLOCK:]) for _, x in back],
        "media_bytes": lambda: [len(f) for f in files],
        "media_sha256": lambda: [hashlib.sha256(f).hexdigest() for f in files],
        "feature": lambda: [feature(x[0], p, o) for x, p, o in zip(back, pcm, out, strict=True)],
        "media": lambda: files,
        "pcm": lambda: out,
    }
    return {name: made[name]() for name in outputs}


_KINDS = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "media": "binary", "pcm": "binary"}


def audio_columns(docs: DataFrame, text: str = "text", outputs: tuple[str, ...] = tuple(_KINDS)) -> DataFrame:
    """Stores each text's bytes as telephony audio, reads them back and adds `outputs`.

    media is the WAVE file, pcm its samples at twice the rate (16 bits, little end first). Null and empty texts are 64
    bytes of 0. Repeated rows get equal values, an empty table gives an empty one, and columns named like the outputs
    are replaced.
    """
    (work,) = fresh(docs, "tl_text")
    out = docs.drop(*outputs).withColumn(work, F.col(text))
    schema = out.drop(work).schema
    for name in outputs:
        schema = schema.add(name, _KINDS[name])
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(work)
            for piece in pieces(batch, work):
                found = audio_of(piece.column(at).to_pylist(), outputs)
                columns = [c for i, c in enumerate(piece.columns) if i != at]
                columns += [pa.array(found[name], types[_KINDS[name]]) for name in outputs]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return out.mapInArrow(tidy(run), schema)
