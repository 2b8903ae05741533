"""From one media file's bytes to its epoch rows. Pure functions; Spark runs them for many files at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ..functions import kernels, nal, sps
from ..spec import IngestError, IngestSpec
from . import codecs, mp4, wav


#: Epochs whose audio is computed at once, whatever the size of batches.
TOGETHER = 16


@dataclass
class Sound:
    """Mono samples at the source's rate, and where they lie on the timeline (in output samples)."""

    mono: np.ndarray
    rate: int
    length: int
    delay: int
    total: int
    available: int


def _checked_tail(read: int, length: int, rate: int, delay: int, spec: IngestSpec) -> int:
    """Output samples that hold audio; fails if more of the declared length is missing than is tolerated."""
    missing = max(0, length - read)
    if missing > spec.audio_tail_tolerance_ms * rate // 1000:
        raise IngestError(f"audio ends {missing} samples ({missing * 1000 / rate:.3f} ms) before its declared duration")
    return delay + (read if missing else length) * kernels.RATE // rate


def wav_sound(data: bytes, spec: IngestSpec) -> Sound:
    info = wav.parse(data)
    step = 1 << 16
    mono = np.concatenate([kernels.downmix(wav.frames(data, info, i, i + step)) for i in range(0, info.frames, step)])
    total = info.frames * kernels.RATE // info.rate
    return Sound(mono, info.rate, info.frames, 0, total, total)


@dataclass
class Span:
    """Where a track's sound lies: samples to leave out, output samples before and in all, and its length at its rate."""

    skip: int
    delay: int
    length: int
    total: int


def audio_span(track: mp4.Track, movie_scale: int) -> Span:
    skip, delay, duration = mp4.timeline(track, movie_scale)
    if track.codec == "mp4a" and track.config:
        _, track.rate, track.channels = mp4.audio_config(track.config)
    before = round(delay * kernels.RATE)
    length = round((duration - delay) * track.rate)
    return Span(round(skip * track.rate), before, length, length * kernels.RATE // track.rate + before)


def mp4_sound(data: bytes, track: mp4.Track, movie_scale: int, spec: IngestSpec) -> Sound:
    span = audio_span(track, movie_scale)
    units = mp4.samples(track, len(data))
    if any(u.dts != sum_ or u.cts != u.dts for u, sum_ in zip(units, np.cumsum([0] + [u.duration for u in units[:-1]]).tolist(), strict=True)):
        raise IngestError("audio units are not contiguous")
    parts = [kernels.downmix(np.asarray(x, np.float32).reshape(len(x), -1)) for x in codecs.decoder(track.codec)(track.config, [(u, data[u.offset : u.offset + u.size]) for u in units])]
    mono = np.concatenate(parts) if parts else np.zeros(0, np.float32)
    if not np.isfinite(mono).all():
        raise IngestError("audio has samples that are not finite")
    mono = mono[span.skip :]
    return Sound(mono[: span.length], track.rate, span.length, span.delay, span.total, min(span.total, _checked_tail(len(mono), span.length, track.rate, span.delay, spec)))


@dataclass
class Pictures:
    """Chosen pictures: time and half-open range of epochs; and how to decode them."""

    track: mp4.Track
    duration_ms: float
    units: list[tuple[mp4.Sample, int]]


def mp4_pictures(data: bytes, track: mp4.Track, movie_scale: int) -> Pictures:
    skip, delay, duration = mp4.timeline(track, movie_scale)
    half_up = lambda x: int(np.floor(x + 0.5)) if x >= 0 else -int(np.floor(-x + 0.5))
    units = [(u, half_up((u.cts / track.timescale - skip + delay) * 1000)) for u in mp4.samples(track, len(data))]
    return Pictures(track, duration * 1000, units)


def epoch_count(sound: Sound | Span | None, pictures: Pictures | None, spec: IngestSpec) -> int:
    """Epochs that the longer of the two fills."""
    sound_ms = -(-sound.total * 1000 // kernels.RATE) if sound else 0
    picture_ms = int(np.ceil(pictures.duration_ms)) if pictures else 0
    return -(-max(sound_ms, picture_ms) // spec.window_ms)


def choose(times: list[int], window_ms: int, total: int) -> list[tuple[int, int, int]]:
    """(time, first epoch, epoch behind the last) of each picture that serves an epoch; times ascend."""
    out, begin = [], 0
    for i, t in enumerate(times):
        end = total if i + 1 == len(times) else min(total, max(-1, t + (times[i + 1] - t) // 2) // window_ms + 1)
        if end > begin:
            out.append((t, begin, end))
            begin = end
    return out


def needed(units: list[tuple[mp4.Sample, int]], chosen: set[int], track: mp4.Track, data: bytes, skip_nonref: bool) -> list[tuple[mp4.Sample, int]]:
    """Units without those that nothing refers to and no epoch needs."""
    if not skip_nonref:
        return units
    raw = lambda u: data[u.offset : u.offset + u.size]
    if track.codec == "avc1":
        prefix = (track.config[4] & 3) + 1
        free = lambda u: nal.avc_disposable(raw(u), prefix)
    else:
        prefix = nal.hevc_record(track.config)[0]
        top = max((h[2] for u, _ in units for h in nal.hevc_headers(raw(u), prefix)), default=0)
        free = lambda u: nal.hevc_disposable(raw(u), prefix, top)
    return [(u, t) for u, t in units if t in chosen or not free(u)]


def epochs(name: str, data: bytes, spec: IngestSpec) -> tuple[dict, Iterator[dict]]:
    """What the file holds, and its epoch rows in order, one at a time."""
    kind = name.rpartition(".")[2].lower() if "." in name else ""
    if kind not in ("mp4", "wav"):
        raise IngestError(f"unsupported extension '{kind}'; .mp4 (H.264 or H.265 video, AAC-LC audio) and .wav are read")
    if not data:
        raise IngestError(f"{name} holds no bytes")
    sound = pictures = None
    if kind == "wav":
        sound = wav_sound(data, spec)
    else:
        scale, tracks = mp4.parse(data)
        audio, video = mp4.check(tracks)
        if video is not None:
            codecs.decoder(video.codec)
            pictures = mp4_pictures(data, video, scale)
        if audio is not None:
            sound = mp4_sound(data, audio, scale, spec)
    total = epoch_count(sound, pictures, spec)
    if not total:
        raise IngestError("no epochs produced")
    matrix = "none"
    if pictures:
        bt709, full = colours(pictures.track)
        matrix = nal.colour_name(bt709, full)
    about = {"has_audio": sound is not None, "has_video": pictures is not None, "matrix": matrix, "epochs": total}

    def rows() -> Iterator[dict]:
        frames = video_rows(pictures, data, spec, total, bt709, full) if pictures else None
        for e in range(total):
            row = {"timestamp_ms": e * spec.window_ms}
            if sound:
                if e % TOGETHER == 0:
                    mels, valid = kernels.epoch_mels(sound.mono, 0, sound.length, sound.rate, e, min(TOGETHER, total - e), spec.frames, sound.delay, sound.total, sound.available)
                row["audio_mel_tensor"], row["audio_valid_frames"] = mels[e % TOGETHER], int(valid[e % TOGETHER])
            else:
                row["audio_mel_tensor"], row["audio_valid_frames"] = np.full(spec.frames * kernels.MELS, kernels.SILENCE, np.float32), 0
            if frames is not None:
                row["video_timestamp_ms"], row["video_tensor"] = next(frames)
            yield row

    return about, rows()


def parameter_sets(track: mp4.Track) -> tuple[int, set[bytes], list[sps.Sps]]:
    """Prefix length, the declared sets, and the parsed sequence sets."""
    try:
        if track.codec == "avc1":
            prefix, sequence, picture = nal.avc_record(track.config)
            return prefix, {*sequence, *picture}, [sps.avc(u) for u in sequence]
        prefix, raw = nal.hevc_record(track.config)
        units = [u for u in raw.split(nal.START_CODE) if u]
        return prefix, set(units), [sps.hevc(u) for u in units if u[0] >> 1 & 63 == 33]
    except ValueError as e:
        raise IngestError(f"decoder configuration is malformed: {e}") from None


def colours(track: mp4.Track) -> tuple[bool, bool]:
    """(BT.709, full range), after all checks of the track's parameter sets."""
    _, _, sets = parameter_sets(track)
    return sps.colour(sets, track.width, track.height, track.colour, track.codec != "avc1")


def guard_sets(track: mp4.Track, units: list[tuple[mp4.Sample, int]], data: bytes) -> None:
    """Parameter sets in the stream must be those that were declared."""
    prefix, declared, _ = parameter_sets(track)
    kinds = (7, 8) if track.codec == "avc1" else (32, 33, 34)
    for s, _ in units:
        for u in nal.units(data[s.offset : s.offset + s.size], prefix):
            if u is None:
                raise IngestError("malformed access unit")
            if (u[0] & 31 if track.codec == "avc1" else u[0] >> 1 & 63) in kinds and u not in declared:
                raise IngestError("parameter sets change within the video")


def video_rows(pictures: Pictures, data: bytes, spec: IngestSpec, total: int, bt709: bool, full: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Time and tensor for each epoch: a chosen picture is converted once, however many epochs it serves."""
    times = sorted(t for _, t in pictures.units if 0 <= t < pictures.duration_ms)
    if not times:
        raise IngestError("no picture is presented")
    chosen = choose(times, spec.window_ms, total)
    wanted = {t for t, _, _ in chosen}
    units = needed(pictures.units, wanted, pictures.track, data, spec.skip_nonref)
    for pts, tensor, beg, fin in pictures_of(pictures.track, units, data, iter(chosen), spec, bt709, full):
        for _ in range(fin - beg):
            yield pts, tensor


def pictures_of(track: mp4.Track, units: list[tuple[mp4.Sample, int]], data: bytes, chosen: Iterator[tuple[int, int, int]], spec: IngestSpec, bt709: bool, full: bool) -> Iterator[tuple[int, np.ndarray, int, int]]:
    """Time, tensor and epochs of the chosen pictures, which ascend, decoded from these units."""
    guard_sets(track, units, data)
    span = next(chosen, None)
    if span is None:
        return
    for pts, y, u, v, width, height in codecs.decoder(track.codec)(track.config, [(s, t, data[s.offset : s.offset + s.size]) for s, t in units]):
        if pts != span[0]:
            continue
        if (width, height) != (track.width, track.height):
            raise IngestError("resolution changes within the video")
        yield pts, kernels.to_tensor(y, u, v, width, height, spec.resolution, bt709, full), span[1], span[2]
        span = next(chosen, None)
        if span is None:
            return
    raise IngestError("a picture that an epoch needs was not decoded")
