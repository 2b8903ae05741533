"""Timeline arithmetic as column expressions: container ticks to milliseconds, sample counts and epoch counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUDIO_RATE = 16_000
HOP, FFT, MELS = 160, 400, 64


def ticks_to_seconds(ticks: Column, scale: Column | float, skip: Column | float = 0.0, delay: Column | float = 0.0) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return ticks.cast("double") / as_col(scale) - as_col(skip) + as_col(delay)


def seconds_to_ms(seconds: Column) -> Column:
    """Half away from zero."""
    return F.round(seconds * 1000.0).cast("long")


def in_range(pts_ms: Column, duration_sec: Column) -> Column:
    return (pts_ms >= 0) & (pts_ms.cast("double") < duration_sec * 1000.0)


def div(a: Column, b: Column | int) -> Column:
    """Integer division, for operands that are not negative."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b)).cast("long")


def ceil_div(a: Column, b: Column | int) -> Column:
    b = b if isinstance(b, Column) else F.lit(b)
    return div(a + b - 1, b)


def output_samples(length: Column, rate: Column, delay: Column | int = 0) -> Column:
    return div(length * AUDIO_RATE, rate) + delay


def audio_ms(samples: Column) -> Column:
    return ceil_div(samples * 1000, AUDIO_RATE)


def total_epochs(video_ms: Column, sound_ms: Column, window_ms: int) -> Column:
    return ceil_div(F.greatest(video_ms, sound_ms), window_ms)


def valid_hops(end: Column, epoch: Column, frames_per_epoch: int) -> Column:
    """Hops of an epoch that start before ``end`` output samples."""
    return F.greatest(F.lit(0), F.least(F.lit(frames_per_epoch), ceil_div(end, HOP) - epoch * frames_per_epoch)).cast("long")


def tolerated_samples(tolerance_ms: int, rate: Column) -> Column:
    return div(F.lit(tolerance_ms).cast("long") * rate, 1000)


def resolve_edits(edits: Column, track_duration: Column, timescale: Column, media_scale: Column) -> Column:
    """struct(status, skip, delay, duration), seconds. edits: array of struct(media_time, duration, rate).

    At most two edits at rate 1. An empty edit (media time -1) may only lead a second one and delays it. Exactly one edit
    is active: its media time is the skip; a duration of 0 means the rest of the track. The duration includes the delay.
    """
    n = F.size(edits)
    empty = lambda e: e["media_time"] == -1
    first = F.get(edits, F.lit(0))
    delayed = (n == 2) & empty(first)
    active = F.get(edits, F.when(delayed, 1).otherwise(0))
    delay = F.when(delayed, first["duration"] / timescale).otherwise(0.0)
    skip = F.when(n > 0, active["media_time"] / media_scale).otherwise(0.0)
    length = F.when((n > 0) & (active["duration"] > 0), active["duration"] / timescale).otherwise(track_duration - skip)
    total = length + delay
    status = (
        F.when(n > 2, "too many edits")
        .when(F.exists(edits, lambda e: e["rate"] != 1.0), "rate")
        .when(F.size(F.filter(edits, lambda e: ~empty(e))) != F.when(n > 0, 1).otherwise(0), "active edits")
        .when(F.coalesce(empty(active), F.lit(False)), "empty edit")
        .when(total <= 0, "duration")
        .otherwise("ok")
    )
    ok = status == "ok"
    return F.struct(status.alias("status"), F.when(ok, skip).alias("skip"), F.when(ok, delay).alias("delay"), F.when(ok, total).alias("duration"))
