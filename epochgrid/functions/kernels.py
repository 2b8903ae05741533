"""NumPy kernels for samples and planes. They depend on absolute positions only, so any range of output can be computed
apart from the rest."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

RATE, HOP, FFT, MELS = 16_000, 160, 400, 64
RADIUS, PHASES = 64, 1024
SILENCE = np.float32(-10.0)


def downmix(frames: np.ndarray) -> np.ndarray:
    """Mean over channels, summed from left to right in float32."""
    out = np.zeros(len(frames), dtype=np.float32)
    for c in range(frames.shape[1]):
        out += frames[:, c].astype(np.float32)
    return out / np.float32(frames.shape[1])


@lru_cache(maxsize=16)
def sinc_table(rate: int) -> np.ndarray:
    """Weights of the 129 taps for each of 1,024 phases; each phase sums to 1."""
    cutoff = 0.95 * min(1.0, RATE / rate)
    x = np.arange(-RADIUS, RADIUS + 1)[None, :] - (np.arange(PHASES) / PHASES)[:, None]
    at = (x + RADIUS) / (2 * RADIUS)
    window = np.where((at >= 0) & (at <= 1), 0.42 - 0.5 * np.cos(2 * np.pi * at) + 0.08 * np.cos(4 * np.pi * at), 0.0)
    weights = np.sinc(x * cutoff) * window * cutoff
    total = weights.sum(axis=1, keepdims=True)
    return (weights.astype(np.float32) / total.astype(np.float32)).astype(np.float32)


def source_range(first: int, last: int, rate: int, delay: int = 0) -> tuple[int, int]:
    """The source samples that output samples [first, last) read."""
    low, high = max(0, first - delay), max(0, last - 1 - delay)
    return max(0, low * rate // RATE - RADIUS), high * rate // RATE + RADIUS + 1


def resample(source: np.ndarray, start: int, length: int, rate: int, first: int, last: int, delay: int = 0, total: int | None = None) -> np.ndarray:
    """Output samples [first, last). source holds the samples from ``start`` on of a signal of ``length`` samples.

    Positions repeat their phases after a few outputs. Outputs of one phase read windows at a constant distance, so each
    phase is one product of a strided view with its 129 weights; nothing is gathered.
    """
    out = np.zeros(last - first, dtype=np.float32)
    stop = total if total is not None else delay + length * RATE // rate
    low, high = max(first, delay), min(last, stop)
    if high <= low:
        return out
    n0, count = low - delay, high - low
    if rate == RATE:
        a, b = max(n0, start), min(n0 + count, start + len(source), length)
        if b > a:
            out[low - first + a - n0 : low - first + b - n0] = source[a - start : b - start]
        return out
    taps = 2 * RADIUS + 1
    step = math.gcd(rate, RATE)
    outputs, inputs = RATE // step, rate // step
    repeat = -(-taps // inputs)
    outputs, inputs = outputs * repeat, inputs * repeat
    begin = n0 * rate // RATE - RADIUS
    end = (n0 + count - 1) * rate // RATE + RADIUS + 1
    window = np.zeros(end - begin + inputs, dtype=np.float32)
    a, b = max(begin, start, 0), min(end, start + len(source), length)
    if b > a:
        window[a - begin : b - begin] = source[a - start : b - start]
    table, size = sinc_table(rate), window.itemsize
    part = out[low - first : high - first]
    for k in range(min(outputs, count)):
        n = n0 + k
        rows = -(-(count - k) // outputs)
        phase = min((n * rate % RATE * PHASES * 2 + RATE) // (2 * RATE), PHASES - 1)
        view = np.lib.stride_tricks.as_strided(window[n * rate // RATE - RADIUS - begin :], (rows, taps), (inputs * size, size))
        part[k::outputs] = view @ table[phase]
    return out


@lru_cache(maxsize=4)
def mel_filters(rate: int = RATE, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangles over fractional bins, equally spaced on the HTK scale, without area normalisation."""
    top = 2595.0 * np.log10(1 + rate / 2 / 700.0)
    points = fft * (700.0 * (10.0 ** (top * np.arange(mels + 2) / (mels + 1) / 2595.0) - 1)) / rate
    low, mid, high = points[:-2, None], points[1:-1, None], points[2:, None]
    x = np.arange(fft // 2 + 1)[None, :]
    return np.where((x > low) & (x < mid), (x - low) / (mid - low), np.where((x >= mid) & (x < high), (high - x) / (high - mid), 0.0)).astype(np.float32)


HANN = (0.5 * (1 - np.cos(2 * np.pi * np.arange(FFT) / (FFT - 1)))).astype(np.float32)


def log_mel(samples: np.ndarray, frames: int) -> np.ndarray:
    """frames x 64: log10 of mel energies; samples begin at the first frame and are filled with zeros."""
    need = (frames - 1) * HOP + FFT
    x = np.zeros(need, dtype=np.float32)
    x[: min(need, len(samples))] = samples[:need]
    shaped = np.lib.stride_tricks.sliding_window_view(x, FFT)[::HOP][:frames] * HANN
    spectrum = np.fft.rfft(shaped, axis=1)
    power = spectrum.real**2 + spectrum.imag**2
    return np.log10(power @ mel_filters().T + np.float32(1e-10)).astype(np.float32)


def epoch_mels(source: np.ndarray, start: int, length: int, rate: int, epoch: int, epochs: int, frames: int, delay: int, total: int, available: int) -> tuple[np.ndarray, np.ndarray]:
    """Mel tensors (a row of frames * 64 for each epoch) and valid hops of the epochs from ``epoch`` on.

    Frames that start after the audio are silence. Samples that neighbouring frames share are computed once.
    """
    first, stop = epoch * frames * HOP, min(available, total)
    valid = np.clip(-(-stop // HOP) - np.arange(epoch, epoch + epochs) * frames, 0, frames)
    out = np.full((epochs * frames, MELS), SILENCE, dtype=np.float32)
    n = int(valid.sum())
    if n:
        x = resample(source, start, length, rate, first, first + (n - 1) * HOP + FFT, delay, stop)
        out[:n] = log_mel(x, n)
    return out.reshape(epochs, frames * MELS), valid


def epoch_mel(source: np.ndarray, start: int, length: int, rate: int, epoch: int, frames: int, delay: int, total: int, available: int) -> tuple[np.ndarray, int]:
    mel, valid = epoch_mels(source, start, length, rate, epoch, 1, frames, delay, total, available)
    return mel[0], int(valid[0])


def nearest_index(target: int, source: int) -> np.ndarray:
    """Aligned corners."""
    return np.arange(target) * (source - 1) // (target - 1) if target > 1 else np.zeros(1, dtype=np.int64)


def to_tensor(y: np.ndarray, u: np.ndarray, v: np.ndarray, width: int, height: int, size: int, bt709: bool, full: bool) -> np.ndarray:
    """Resized, converted and normalised picture: 3 * size * size values, channel by channel, in [-1, 1].

    Planes are flat bytes; their row length follows from their size. Missing luma is 16, missing chroma 128.
    """
    rows, columns = nearest_index(size, height), nearest_index(size, width)
    half_h, half_w = -(-height // 2), -(-width // 2)

    def gather(plane, count, least, r, c, missing):
        plane = np.frombuffer(plane, np.uint8) if isinstance(plane, (bytes, bytearray, memoryview)) else np.asarray(plane, np.uint8).ravel()
        index = r[:, None] * max(len(plane) // count, least) + c[None, :]
        return np.where(index < len(plane), plane[np.minimum(index, max(len(plane) - 1, 0))] if len(plane) else missing, missing).astype(np.float32)

    f = np.float32
    luma = gather(y, height, width, rows, columns, 16)
    r2, c2 = np.minimum(rows // 2, half_h - 1), np.minimum(columns // 2, half_w - 1)
    d, e = gather(u, half_h, half_w, r2, c2, 128) - f(128), gather(v, half_h, half_w, r2, c2, 128) - f(128)
    c = luma if full else np.maximum(luma - f(16), f(0)) * f(255 / 219)
    chroma = f(1) if full else f(255 / 224)
    kr, kb = (0.2126, 0.0722) if bt709 else (0.299, 0.114)
    kg = 1 - kr - kb
    red = c + f(2 - 2 * kr) * e * chroma
    green = c - f(2 * kb * (1 - kb) / kg) * d * chroma - f(2 * kr * (1 - kr) / kg) * e * chroma
    blue = c + f(2 - 2 * kb) * d * chroma
    return (np.clip(np.stack([red, green, blue]), 0, 255) / f(127.5) - f(1)).astype(np.float32).ravel()


def ulp_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Steps between float32 values in their order."""
    def ordered(x):
        i = np.asarray(x, np.float32).view(np.int32).astype(np.int64)
        return np.where(i < 0, -(i & 0x7FFFFFFF), i)

    return np.abs(ordered(a) - ordered(b))
