"""Decoders plug in here: none is part of the engine.

A video decoder takes (config, samples) and yields (pts_ms, y, u, v, width, height) in presentation order; an audio
decoder takes (config, samples) and yields float32 arrays, a column for each channel. Samples are (Sample, bytes) pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from ..spec import IngestError

NAMES = {"avc1": "H.264", "hvc1": "H.265", "hev1": "H.265", "mp4a": "AAC"}
_DECODERS: dict[str, Callable] = {}


def register(code: str, decoder: Callable) -> None:
    _DECODERS[code] = decoder


def register_all(decoders: dict[str, Callable] | None) -> None:
    """In a task's process: functions that came with the task."""
    _DECODERS.update(decoders or {})


def decoder(code: str) -> Callable:
    if code not in _DECODERS:
        raise IngestError(f"no decoder for {NAMES.get(code, code)} is installed; register one under '{code}'")
    return _DECODERS[code]
