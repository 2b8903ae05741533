"""MP4 files: the sample tables of their tracks, without decoding anything."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from ..spec import IngestError

MAX_INDEX = 16 << 20
_CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts")


@dataclass
class Track:
    kind: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    width: int = 0
    height: int = 0
    channels: int = 0
    rate: int = 0
    entries: int = 0
    config: bytes = b""
    colour: tuple[int, int, bool] | None = None
    edits: list[tuple[int, int, float]] = field(default_factory=list)
    tables: dict[bytes, bytes] = field(default_factory=dict)


@dataclass(frozen=True)
class Sample:
    dec_idx: int
    dts: int
    cts: int
    duration: int
    is_sync: bool
    offset: int
    size: int


def boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of each box's body."""
    while at + 8 <= end:
        size, kind, body = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], at + 8
        if size == 1:
            if at + 16 > end:
                raise IngestError("MP4 box is cut off")
            size, body = int.from_bytes(data[at + 8 : at + 16], "big"), at + 16
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise IngestError("MP4 box has a wrong size")
        yield kind, body, at + size
        at += size


def _u(data: bytes, at: int, n: int, signed: bool = False) -> int:
    if at + n > len(data):
        raise IngestError("MP4 table is cut off")
    return int.from_bytes(data[at : at + n], "big", signed=signed)


def parse(data: bytes) -> tuple[int, list[Track]]:
    """The movie's time scale and its tracks."""
    moov = [(a, b) for kind, a, b in boxes(data, 0, len(data)) if kind == b"moov"]
    if len(moov) != 1:
        raise IngestError("MP4 has no index")
    if moov[0][1] - moov[0][0] > MAX_INDEX:
        raise IngestError("MP4 index exceeds 16 MiB")
    scale, tracks = 0, []
    for kind, a, b in boxes(data, *moov[0]):
        if kind == b"mvhd":
            scale = _u(data, a + (20 if data[a] == 1 else 12), 4)
        elif kind == b"trak":
            tracks.append(Track())
            _track(data, a, b, tracks[-1])
    return scale, tracks


def _track(data: bytes, a: int, b: int, track: Track) -> None:
    for kind, x, y in boxes(data, a, b):
        if kind in _CONTAINERS:
            _track(data, x, y, track)
        elif kind == b"mdhd":
            long = data[x] == 1
            track.timescale = _u(data, x + (20 if long else 12), 4)
            track.duration = _u(data, x + (24 if long else 16), 8 if long else 4)
        elif kind == b"hdlr":
            track.kind = {b"vide": "video", b"soun": "audio"}.get(data[x + 8 : x + 12], "other")
        elif kind == b"elst":
            long, n = data[x] == 1, _u(data, x + 4, 4)
            at, step = x + 8, 20 if data[x] == 1 else 12
            if n * step > y - at:
                raise IngestError("MP4 edit list is cut off")
            for i in range(n):
                p, w = at + i * step, 8 if long else 4
                rate = _u(data, p + 2 * w, 2, True) + _u(data, p + 2 * w + 2, 2) / 65536
                track.edits.append((_u(data, p + w, w, True), _u(data, p, w), rate))
        elif kind == b"stsd":
            _entry(data, x, y, track)
        elif kind in (b"stts", b"ctts", b"stss", b"stsz", b"stsc", b"stco", b"co64"):
            track.tables[kind] = data[x:y]


def _entry(data: bytes, x: int, y: int, track: Track) -> None:
    track.entries = _u(data, x + 4, 4)
    for kind, a, b in boxes(data, x + 8, y):
        track.codec = kind.decode("latin-1")
        if track.kind == "video" or kind in (b"avc1", b"hvc1", b"hev1"):
            track.width, track.height, inner = _u(data, a + 24, 2), _u(data, a + 26, 2), a + 78
        else:
            track.channels, track.rate, inner = _u(data, a + 16, 2), _u(data, a + 24, 4) >> 16, a + 28
        for k, p, q in boxes(data, inner, b):
            if k in (b"avcC", b"hvcC", b"esds"):
                track.config = data[p:q]
            elif k == b"colr" and data[p : p + 4] == b"nclx":
                track.colour = (_u(data, p + 6, 2), _u(data, p + 8, 2), bool(_u(data, p + 10, 1) & 128))
        return


def audio_config(esds: bytes) -> tuple[int, int, int]:
    """Object type, rate and channels of an esds box; only plain AAC-LC with up to six channels is accepted."""
    at, config = 4, None
    while at + 2 <= len(esds):
        tag, at, size = esds[at], at + 1, 0
        for _ in range(4):
            if at >= len(esds):
                raise IngestError("audio configuration is cut off")
            byte, at = esds[at], at + 1
            size = size << 7 | byte & 127
            if not byte & 128:
                break
        if tag == 3:
            flags = esds[at + 2] if at + 2 < len(esds) else 0
            at += 3 + (2 if flags & 128 else 0) + (2 if flags & 32 else 0)
        elif tag == 4:
            at += 13
        elif tag == 5:
            config = esds[at : at + size]
            break
        else:
            at += size
    if config is None or len(config) < 2:
        raise IngestError("audio configuration is missing")
    bits = int.from_bytes(config[:8].ljust(8, b"\0"), "big")
    take = lambda start, n: bits >> (64 - start - n) & ((1 << n) - 1)
    kind, index, place = take(0, 5), take(5, 4), 9
    rates = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
    if index == 15:
        rate, place = take(9, 24), 33
    elif index < len(rates):
        rate = rates[index]
    else:
        raise IngestError("audio rate is not known")
    channels = take(place, 4)
    if kind != 2:
        raise IngestError(f"audio object type {kind} is not AAC-LC")
    if not 1 <= channels <= 6:
        raise IngestError(f"{channels} audio channels are not supported")
    return kind, rate, channels


def check(tracks: list[Track]) -> tuple[Track | None, Track | None]:
    """The audio and the video track."""
    audio, video = ([t for t in tracks if t.kind == k] for k in ("audio", "video"))
    if len(audio) > 1 or len(video) > 1:
        raise IngestError("more than one audio or video track")
    if not audio and not video:
        raise IngestError("no track")
    if video and video[0].codec not in ("avc1", "hvc1", "hev1"):
        raise IngestError(f"video is {video[0].codec}, not H.264 or H.265")
    if any(t.entries != 1 for t in audio + video):
        raise IngestError("a track needs exactly one sample description")
    return (audio or [None])[0], (video or [None])[0]


def samples(track: Track, length: int) -> list[Sample]:
    """In decode order; length is that of the file."""
    t = track.tables
    if not {b"stts", b"stsz", b"stsc"} <= t.keys() or not {b"stco", b"co64"} & t.keys():
        raise IngestError("MP4 track has no sample table")
    fixed, n = _u(t[b"stsz"], 4, 4), _u(t[b"stsz"], 8, 4)
    if n > MAX_INDEX:
        raise IngestError("MP4 track has too many samples")
    sizes = [fixed] * n if fixed else [_u(t[b"stsz"], 12 + 4 * i, 4) for i in range(n)]
    runs = lambda box, signed: [(_u(t[box], 8 + 8 * i, 4), _u(t[box], 12 + 8 * i, 4, signed)) for i in range(_u(t[box], 4, 4))]

    def spread(pairs):
        out: list[int] = []
        for count, value in pairs:
            if count > n - len(out):
                raise IngestError("MP4 time table is too long")
            out += [value] * count
        if len(out) != n:
            raise IngestError("MP4 time table is too short")
        return out

    durations = spread(runs(b"stts", False))
    shifts = spread(runs(b"ctts", t[b"ctts"][0] == 1)) if b"ctts" in t else [0] * n
    sync = {_u(t[b"stss"], 8 + 4 * i, 4) - 1 for i in range(_u(t[b"stss"], 4, 4))} if b"stss" in t else None
    wide = b"co64" in t
    places = t[b"co64" if wide else b"stco"]
    starts = [_u(places, 8 + (8 if wide else 4) * i, 8 if wide else 4) for i in range(_u(places, 4, 4))]
    groups = [(_u(t[b"stsc"], 8 + 12 * i, 4), _u(t[b"stsc"], 12 + 12 * i, 4)) for i in range(_u(t[b"stsc"], 4, 4))]
    out, dts, k, g = [], 0, 0, 0
    for chunk, at in enumerate(starts, 1):
        while g + 1 < len(groups) and groups[g + 1][0] <= chunk:
            g += 1
        for _ in range(groups[g][1] if groups else 0):
            if k == n:
                break
            if at + sizes[k] > length:
                raise IngestError("MP4 sample lies beyond the file")
            out.append(Sample(k, dts, dts + shifts[k], durations[k], sync is None or k in sync, at, sizes[k]))
            at += sizes[k]
            dts += durations[k]
            k += 1
    if k != n:
        raise IngestError("MP4 chunk table is too short")
    return out


def timeline(track: Track, movie_scale: int) -> tuple[float, float, float]:
    """Skip, delay and duration in seconds, after the edit list."""
    scale, edits = track.timescale, track.edits
    if not scale:
        raise IngestError("MP4 track has no time scale")
    skip = delay = 0.0
    duration = track.duration / scale
    if edits:
        if len(edits) > 2 or any(rate != 1 for _, _, rate in edits) or not movie_scale:
            raise IngestError("edit list is not supported")
        if len(edits) == 2 and edits[0][0] == -1:
            delay, edits = edits[0][1] / movie_scale, edits[1:]
        if len(edits) != 1 or edits[0][0] < 0:
            raise IngestError("edit list is not supported")
        skip = edits[0][0] / scale
        duration = (edits[0][1] / movie_scale if edits[0][1] else duration - skip) + delay
    if not duration > 0:
        raise IngestError("track has no duration")
    return skip, delay, duration
