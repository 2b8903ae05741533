"""WAV files: a RIFF chunk parser and ranges of samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..spec import IngestError


@dataclass(frozen=True)
class Wav:
    rate: int
    channels: int
    bits: int
    is_float: bool
    offset: int
    frames: int

    @property
    def frame_bytes(self) -> int:
        return self.channels * ((self.bits + 7) // 8)


def parse(data: bytes) -> Wav:
    """The file's whole bytes."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise IngestError("not a WAV file")
    at, fmt = 12, None
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = at + 8
        if kind == b"fmt ":
            if size < 16 or body + size > len(data):
                raise IngestError("WAV format is cut off")
            code, channels, rate = (int.from_bytes(data[body + a : body + b], "little") for a, b in ((0, 2), (2, 4), (4, 8)))
            block, bits = (int.from_bytes(data[body + a : body + b], "little") for a, b in ((12, 14), (14, 16)))
            if code == 0xFFFE and size >= 26:
                code = int.from_bytes(data[body + 24 : body + 26], "little")
            fmt = (code, channels, rate, block, bits)
        elif kind == b"data":
            if fmt is None:
                raise IngestError("WAV samples before their format")
            code, channels, rate, block, bits = fmt
            if code not in (1, 3) or (code == 3 and bits != 32) or not 1 <= bits <= 32:
                raise IngestError(f"WAV format {code} with {bits} bits is not supported")
            if not 1 <= channels <= 32:
                raise IngestError(f"{channels} channels are not supported")
            if not 8_000 <= rate <= 192_000:
                raise IngestError(f"a rate of {rate} Hz is not supported")
            width = (bits + 7) // 8 * channels
            if block != width:
                raise IngestError("WAV frame size is inconsistent")
            if size > len(data) - body:
                raise IngestError(f"WAV is cut off: {size} bytes of samples declared, {len(data) - body} there")
            if size % width:
                raise IngestError("WAV ends within a frame")
            if not size:
                raise IngestError("WAV has no samples")
            return Wav(rate, channels, bits, code == 3, body, size // width)
        at = body + size + size % 2
    raise IngestError("WAV has no samples")


def frames(data: bytes, wav: Wav, first: int, last: int) -> np.ndarray:
    """Frames [first, last) as float32, a column for each channel. Integers are divided by 2 ** (bits - 1)."""
    first, last = max(0, first), min(last, wav.frames)
    raw = np.frombuffer(data, np.uint8, max(0, last - first) * wav.frame_bytes, wav.offset + first * wav.frame_bytes)
    if wav.is_float:
        out = raw.view("<f4").astype(np.float32)
        if not np.isfinite(out).all():
            raise IngestError("audio has samples that are not finite")
    else:
        width = (wav.bits + 7) // 8
        if width == 1:
            whole = raw.astype(np.int32) - 128
        else:
            wide = np.zeros((len(raw) // width, 4), np.uint8)
            wide[:, 4 - width :] = raw.reshape(-1, width)
            whole = wide.view("<i4").ravel() >> (32 - 8 * width)
        out = (whole / float(1 << (wav.bits - 1))).astype(np.float32)
    return out.reshape(-1, wav.channels)


def write(samples: np.ndarray, rate: int, bits: int = 16, is_float: bool = False) -> bytes:
    """A WAV file; samples are a column for each channel, from -1 to 1."""
    samples = np.atleast_2d(np.asarray(samples, np.float32).T).T
    if is_float:
        body, bits = samples.astype("<f4").tobytes(), 32
    else:
        whole = np.clip(np.round(samples.astype(np.float64) * (1 << (bits - 1))), -(1 << (bits - 1)), (1 << (bits - 1)) - 1).astype("<i4")
        width = (bits + 7) // 8
        body = (whole.astype(np.uint8) + 128).tobytes() if width == 1 else np.ascontiguousarray(whole).view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
    width = samples.shape[1] * ((bits + 7) // 8)
    head = (3 if is_float else 1).to_bytes(2, "little") + samples.shape[1].to_bytes(2, "little") + rate.to_bytes(4, "little") + (rate * width).to_bytes(4, "little") + width.to_bytes(2, "little") + bits.to_bytes(2, "little")
    chunks = b"fmt " + len(head).to_bytes(4, "little") + head + b"data" + len(body).to_bytes(4, "little") + body
    return b"RIFF" + (len(chunks) + 4).to_bytes(4, "little") + b"WAVE" + chunks
