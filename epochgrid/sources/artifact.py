"""The epoch table as an Arrow IPC file: written once, verified, and read without copying."""

from __future__ import annotations

import bisect
import contextlib
import hashlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from .. import __version__
from ..functions.kernels import FFT, HOP, MELS, RATE
from ..spec import IngestError, IngestSpec


def schema(spec: IngestSpec, has_audio: bool, has_video: bool, matrix: str = "none") -> pa.Schema:
    """Columns and metadata of an artifact. Without video its two columns are left out."""
    fields = [pa.field("timestamp_ms", pa.int64(), False), pa.field("audio_valid_frames", pa.int64(), False)]
    item = pa.field("item", pa.float32(), False)
    side = spec.resolution
    if has_video:
        fields += [pa.field("video_timestamp_ms", pa.int64(), False), pa.field("video_tensor", pa.list_(item, 3 * side * side), False)]
    fields.append(pa.field("audio_mel_tensor", pa.list_(item, spec.frames * MELS), False))
    # Descriptions that readers of the format know.
    metadata = {
        "engine_version": __version__,
        "window_ms": str(spec.window_ms),
        "audio_shape": f"{spec.frames},{MELS}",
        "audio_sample_rate": str(RATE),
        "audio_feature": "log10-mel-power",
        "video_normalization": "RGB CHW [-1,1]",
        "video_matrix": matrix if has_video else "none",
        "has_audio": str(has_audio).lower(),
        "audio_hop_samples": str(HOP),
        "audio_fft_samples": str(FFT),
        "audio_window": "symmetric Hann, left-aligned, zero-pad EOF",
        "audio_mel_scale": "HTK, 0..8000Hz, 64 triangular bands, no area normalization",
        "audio_log_floor": "log10(power + 1e-10)",
        "audio_resampler": "129-tap Blackman sinc, 1024 phases, cutoff 0.95*min(1,16000/source_rate)",
        "audio_downmix": "arithmetic channel mean",
        "video_sampling": "nearest presentation frame, earlier on tie; repeat last through audio tail",
        "video_resize": "nearest, align-corners, square stretch",
        "timestamp_origin": "movie presentation timeline after edit lists; epoch starts",
    }
    if has_video:
        metadata["video_shape"] = f"3,{side},{side}"
    return pa.schema(fields, metadata)


def to_batch(rows: list[dict], kind: pa.Schema) -> pa.RecordBatch:
    columns = []
    for f in kind:
        values = [r[f.name] for r in rows]
        if pa.types.is_fixed_size_list(f.type):
            flat = np.concatenate(values) if values else np.zeros(0, np.float32)
            if len(flat) != len(values) * f.type.list_size:
                raise IngestError(f"{f.name} has a wrong shape")
            columns.append(pa.FixedSizeListArray.from_arrays(pa.array(flat, pa.float32()), type=f.type))
        else:
            columns.append(pa.array(values, f.type))
    return pa.RecordBatch.from_arrays(columns, schema=kind)


def write(path: str, kind: pa.Schema, rows: Iterable[dict], batch_epochs: int) -> int:
    """A new file, in batches; it is checked after writing, and removed if anything fails. Never overwrites."""
    try:
        handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
    except FileExistsError:
        raise IngestError(f"{path} exists, and is never replaced") from None
    try:
        n, held = 0, []
        with os.fdopen(handle, "wb") as f, pa.ipc.new_file(f, kind) as out:
            for row in rows:
                if row["timestamp_ms"] != n * int(kind.metadata[b"window_ms"]):
                    raise IngestError("epochs are out of order")
                held.append(row)
                n += 1
                if len(held) == batch_epochs:
                    out.write_batch(to_batch(held, kind))
                    held = []
            if held:
                out.write_batch(to_batch(held, kind))
            out.close()
            f.flush()
            os.fsync(f.fileno())
        if not n:
            raise IngestError("no epochs produced")
        with pa.memory_map(path) as source:
            found = pa.ipc.open_file(source)
            if sum(found.get_batch(i).num_rows for i in range(found.num_record_batches)) != n:
                raise IngestError("the written file is not complete")
        return n
    except BaseException:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(path)
        raise


class EpochDataset:
    """Random access to an artifact. With copy=False the arrays alias the mapped file: never change them."""

    def __init__(self, path: str, copy: bool = False) -> None:
        self.copy = copy
        self.source = pa.memory_map(os.fspath(path))
        self.reader = pa.ipc.open_file(self.source)
        self.schema = self.reader.schema
        about = self.schema.metadata or {}
        shape = lambda key: tuple(map(int, about[key].decode().split(",")))
        self.has_audio = about.get(b"has_audio", b"true") == b"true"
        self.has_video = "video_tensor" in self.schema.names
        self.audio_shape = shape(b"audio_shape")
        self.video_shape = shape(b"video_shape") if self.has_video else None
        self._ends = list(np.cumsum([self.reader.get_batch(i).num_rows for i in range(self.reader.num_record_batches)], dtype=int))

    def __len__(self) -> int:
        return int(self._ends[-1]) if self._ends else 0

    def get_batch(self, index: int) -> dict[str, np.ndarray]:
        batch = self.reader.get_batch(index)
        out = {}
        for name in self.schema.names:
            column = batch.column(name)
            if name.endswith("_tensor"):
                key = "video" if name == "video_tensor" else "audio"
                values = column.flatten().to_numpy(zero_copy_only=True).reshape(batch.num_rows, *(self.video_shape if key == "video" else self.audio_shape))
            else:
                key, values = name, column.to_numpy(zero_copy_only=True)
            out[key] = values.copy() if self.copy else values
        return out

    def iter_batches(self) -> Iterator[dict[str, np.ndarray]]:
        for i in range(len(self._ends)):
            yield self.get_batch(i)

    def __getitem__(self, index: int) -> dict[str, np.ndarray]:
        at = index + len(self) if index < 0 else index
        if not 0 <= at < len(self):
            raise IndexError(index)
        batch = bisect.bisect_right(self._ends, at)
        return {k: v[at - (self._ends[batch - 1] if batch else 0)] for k, v in self.get_batch(batch).items()}

    def close(self) -> None:
        self.source.close()

    def __enter__(self) -> EpochDataset:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


def digest(path: str) -> dict:
    """rows, and a SHA-256 of each column's values in order: equal for equal content, whatever the batches."""
    found: dict[str, hashlib._Hash] = {}
    with EpochDataset(path) as d:
        for i in range(len(d._ends)):
            batch = d.reader.get_batch(i)
            for name in d.schema.names:
                column = batch.column(name)
                values = column.flatten() if pa.types.is_fixed_size_list(column.type) else column
                found.setdefault(name, hashlib.sha256()).update(values.to_numpy(zero_copy_only=True).tobytes())
        return {"rows": len(d), "columns": {n: h.hexdigest() for n, h in found.items()}}


def load(path: str, *, copy: bool = False) -> EpochDataset:
    return EpochDataset(path, copy)
