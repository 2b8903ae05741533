"""Options of a conversion, with their defaults and limits."""

from __future__ import annotations

from dataclasses import dataclass


class UsageError(ValueError):
    """An option outside its limits."""


class IngestError(RuntimeError):
    """An input that can't be converted."""


#: The least and most of each option.
_LIMITS = (
    ("window_sec", 0.05, 10, " s"),
    ("resolution", 32, 1024, ""),
    ("batch_epochs", 1, 1024, ""),
    ("queue_mib", 0, 64, " MiB"),
    ("queue_depth", 1, 4, ""),
    ("video_workers", 0, 64, ""),
    ("chunk_target_ms", 250, 60_000, " ms"),
    ("video_buffer_mib", 1, 1024, " MiB"),
    ("audio_tail_tolerance_ms", 0, 1000, " ms"),
)
_CHOICES = (("execution", ("sequential", "concurrent")), ("decoder_threads", (0, 1, 2, 4)))
MAX_BATCH_BYTES = 256 << 20


@dataclass(frozen=True)
class IngestSpec:
    """Only window_sec, resolution, audio_tail_tolerance_ms and the input change values; the rest shapes the work."""

    window_sec: float = 0.5
    resolution: int = 224
    batch_epochs: int = 32
    execution: str = "concurrent"
    queue_mib: int = 4
    queue_depth: int = 2
    decoder_threads: int = 0
    video_workers: int | None = None
    skip_nonref: bool = True
    audio_decode_thread: bool = True
    chunk_target_ms: int = 2000
    video_buffer_mib: int = 64
    audio_tail_tolerance_ms: int = 25
    profile: bool = False
    verbose: bool = False

    def __post_init__(self) -> None:
        for name, low, high, unit in _LIMITS:
            value = getattr(self, name)
            if value is not None and not low <= value <= high:
                raise UsageError(f"{name} is {value}, outside of {low} to {high}{unit}")
        for name, known in _CHOICES:
            if getattr(self, name) not in known:
                raise UsageError(f"{name} is {getattr(self, name)!r}, not one of {', '.join(map(str, known))}")
        hops = self.window_sec * 100
        if abs(hops - round(hops)) >= 1e-6:
            raise UsageError(f"window_sec is {self.window_sec}: a window holds whole hops of 0.01 s")
        if self.decoder_threads and self.video_workers not in (None, 1):
            raise UsageError("with decoder_threads there is one video worker, so video_workers has to be left out or 1")
        if self.row_bytes * self.batch_epochs > MAX_BATCH_BYTES:
            raise UsageError(f"{self.batch_epochs} epochs of {self.row_bytes} bytes are more than a batch of {MAX_BATCH_BYTES} bytes holds")

    @property
    def frames(self) -> int:
        return round(self.window_sec * 100)

    @property
    def window_ms(self) -> int:
        return round(self.window_sec * 1000)

    @property
    def row_bytes(self) -> int:
        return (3 * self.resolution**2 + 64 * self.frames) * 4
