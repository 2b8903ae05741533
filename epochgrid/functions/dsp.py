"""Signal processing as column expressions over arrays, for signals that are rows. Long signals use the NumPy kernels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kernels import PHASES, RADIUS
from .timeline import div


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def channel_mean(frame: Column) -> Column:
    return total(frame) / F.size(frame)


def hann(size: int) -> Column:
    """Symmetric; a literal, computed once."""
    return F.array(*[F.lit(0.5 * (1 - math.cos(2 * math.pi * i / (size - 1)))) for i in range(size)])


def frames(signal: Column, size: int, hop: int, count: int) -> Column:
    """Left-aligned windows; zeros fill up behind the end."""
    padded = F.concat(signal, F.array_repeat(F.lit(0.0), size))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.slice(padded, i * hop + 1, F.lit(size)))


def power(frame: Column, size: int) -> Column:
    """Squared magnitudes of the discrete Fourier transform for bins 0 to size / 2."""
    bins = []
    for k in range(size // 2 + 1):
        cos = F.array(*[F.lit(math.cos(2 * math.pi * k * n / size)) for n in range(size)])
        sin = F.array(*[F.lit(math.sin(2 * math.pi * k * n / size)) for n in range(size)])
        re, im = dot(frame, cos), dot(frame, sin)
        bins.append(re * re + im * im)
    return F.array(*bins)


def hz_to_mel(hz: Column) -> Column:
    return F.log10(hz / 700.0 + 1.0) * 2595.0


def mel_to_hz(mel: Column) -> Column:
    return (F.pow(F.lit(10.0), mel / 2595.0) - 1.0) * 700.0


def triangle(x: Column, low: Column, middle: Column, high: Column) -> Column:
    return F.when((x > low) & (x < middle), (x - low) / (middle - low)).when((x >= middle) & (x < high), (high - x) / (high - middle)).otherwise(0.0)


def mel_point(i: Column, mels: int, rate: int, fft: int) -> Column:
    """The i-th corner in fractional bins."""
    top = 2595.0 * math.log10(1 + rate / 2 / 700.0)
    return mel_to_hz(i * top / float(mels + 1)) * float(fft) / float(rate)


def raw_sinc_weight(phase: Column, tap: Column, rate: int, target: int = 16_000) -> Column:
    """Before a phase is normalised. tap counts from -RADIUS."""
    cutoff = 0.95 * min(1.0, target / rate)
    x = tap - phase / float(PHASES)
    px = x * cutoff * math.pi
    sinc = F.when(F.abs(x * cutoff) < 1e-12, 1.0).otherwise(F.sin(px) / px)
    at = (x + float(RADIUS)) / float(2 * RADIUS)
    window = F.when((at >= 0) & (at <= 1), F.lit(0.42) - F.cos(at * (2 * math.pi)) * 0.5 + F.cos(at * (4 * math.pi)) * 0.08).otherwise(0.0)
    return sinc * window * cutoff


def phase_of(fraction: Column) -> Column:
    return F.least(F.round(fraction * float(PHASES)), F.lit(PHASES - 1)).cast("long")


def nearest(target: Column, size_to: int, size_from: Column | int) -> Column:
    """Aligned corners."""
    return div(target * (size_from - 1), size_to - 1) if size_to > 1 else F.lit(0).cast("long")


def chroma(source: Column, size_from: Column | int) -> Column:
    """The place in a plane of half the size, rounded up."""
    size = size_from if isinstance(size_from, Column) else F.lit(size_from)
    return F.least(div(source, 2), div(size.cast("long") + 1, 2) - 1)


def yuv_to_rgb(y: Column, u: Column, v: Column, bt709: Column, full: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue from 0 to 255."""
    c = F.when(full, y).otherwise(F.greatest(y - 16.0, F.lit(0.0)) * (255 / 219))
    chroma = F.when(full, 1.0).otherwise(255 / 224)
    kr, kb = F.when(bt709, 0.2126).otherwise(0.299), F.when(bt709, 0.0722).otherwise(0.114)
    kg = F.lit(1.0) - kr - kb
    d, e = u - 128.0, v - 128.0
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), x))
    red = c + (F.lit(2.0) - kr * 2) * e * chroma
    green = c - kb * 2 * (F.lit(1.0) - kb) / kg * d * chroma - kr * 2 * (F.lit(1.0) - kr) / kg * e * chroma
    blue = c + (F.lit(2.0) - kb * 2) * d * chroma
    return clamp(red), clamp(green), clamp(blue)
