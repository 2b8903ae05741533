"""Kernels, unit headers, WAV and MP4 files, artifacts, and conversion from end to end."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from epochgrid import cli
from epochgrid.functions import kernels, nal, sps
from epochgrid.sources import artifact, codecs, convert, mp4, wav
from epochgrid.sources.datasource import EpochReader, EpochSource, EpochWriter
from epochgrid.sources.ingest import epoch_table, ingest, ingest_many, read_files, sample_table
from epochgrid.spec import IngestError, IngestSpec, UsageError


def tone(hz, rate, seconds, channels=1, amp=0.5):
    x = amp * np.sin(2 * np.pi * hz * np.arange(round(rate * seconds)) / rate)
    return np.repeat(x[:, None], channels, axis=1).astype(np.float32)


# --- kernels ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rate", [44100, 48000])
def test_resampler_keeps_low_and_drops_high(rate):
    for hz, check in ((1000, lambda r: abs(r - 0.353553) < 0.003), (12000, lambda r: 20 * np.log10(r / 0.353553) < -60)):
        x = tone(hz, rate, 1)[:, 0]
        y = kernels.resample(x, 0, len(x), rate, 0, 16000)
        assert check(np.sqrt(np.mean(y[1000:-1000].astype(float) ** 2)))


def test_any_range_equals_the_whole():
    x = tone(997, 44100, 1)[:, 0]
    whole = kernels.resample(x, 0, len(x), 44100, 0, 16000)
    for first in range(0, 16000, 317):
        last = min(16000, first + 317)
        a, b = kernels.source_range(first, last, 44100)
        part = kernels.resample(x[a:b], a, len(x), 44100, first, last)
        assert np.allclose(part, whole[first:last], atol=1e-6)


def test_downmix():
    assert kernels.downmix(np.array([[1, -1], [0.5, 0.5]])).tolist() == [0, 0.5]
    assert kernels.downmix(np.array([[1, 0, -1, 1, 0, -1]])).tolist() == [0]


def test_mel_bank_and_silence():
    assert (kernels.mel_filters().max(axis=1) > 0).all() and kernels.mel_filters().shape == (64, 201)
    x = np.full(80, 0.5, np.float32)
    mel, valid = kernels.epoch_mel(x, 0, 80, 16000, 0, 50, 0, 80, 80)
    assert valid == 1 and (mel[:64] > -5).any() and np.allclose(mel[64:], -10, atol=1e-5)


def test_black_and_planes():
    y, u = np.full(64, 16, np.uint8), np.full(16, 128, np.uint8)
    assert np.allclose(kernels.to_tensor(y, u, u, 8, 8, 5, False, False), -1, atol=0.03)
    assert kernels.to_tensor(np.full(64, 255, np.uint8), u, u, 8, 8, 4, True, True).max() == 1
    assert kernels.nearest_index(5, 8).tolist() == [0, 1, 3, 5, 7] and kernels.nearest_index(1, 9).tolist() == [0]


def test_ulp():
    a = np.float32(1)
    assert kernels.ulp_distance([a, a, -0.0], [a, np.nextafter(a, np.float32(2)), 0.0]).tolist() == [0, 1, 0]


# --- unit headers -----------------------------------------------------------------------------------------------------


def unit(*units, prefix=4):
    return b"".join(len(u).to_bytes(prefix, "big") + u for u in units)


def test_avc_units():
    free, kept, idr, sei = b"\x01\x80", b"\x21\x80", b"\x65\x80", b"\x06\x05"
    for prefix in (1, 2, 4):
        assert nal.avc_disposable(unit(free, prefix=prefix), prefix) and nal.avc_annex_b(unit(free, sei, prefix=prefix), prefix) == nal.START_CODE + free + nal.START_CODE + sei
    assert nal.avc_disposable(unit(sei, free, free), 4)
    for bad in (unit(kept), unit(free, kept), unit(sei), b"", unit(free)[:-1], unit(b"\x81"), b"\0\0\0\0", unit(b"\x07")):
        assert not nal.avc_disposable(bad, 4)
    assert not nal.avc_disposable(unit(free), 0) and not nal.avc_disposable(unit(free), 5)
    assert nal.avc_idr(unit(sei, idr), 4) and not nal.avc_idr(unit(idr, free), 4) and not nal.avc_idr(unit(sei), 4) and not nal.avc_idr(unit(idr)[:-1], 4)
    for bad in (b"", unit(free)[:-1], b"\0\0\0\0", unit(b"\x80"), unit(b"\x60")):
        with pytest.raises(ValueError):
            nal.avc_annex_b(bad, 4)


def hevc(kind, layer=0, temporal=0):
    return bytes([kind << 1 | layer >> 5, (layer & 31) << 3 | temporal + 1, 0x80])


def test_hevc_units():
    assert nal.hevc_disposable(unit(hevc(0, temporal=2), hevc(39)), 4, 2)
    for bad in (unit(hevc(0, temporal=1)), unit(hevc(1, temporal=2)), unit(hevc(0, 1, 2)), unit(hevc(39)), unit(hevc(0, temporal=2))[:-1], unit(b"\0")):
        assert not nal.hevc_disposable(bad, 4, 2)
    assert nal.hevc_classify(unit(hevc(21)), 4) == (True, False) and nal.hevc_classify(unit(hevc(8), hevc(9)), 4) == (False, True)
    assert nal.hevc_classify(unit(hevc(21), hevc(1)), 4) == (False, False) and nal.hevc_classify(unit(hevc(21, 1)), 4) == (False, False)
    record = bytes([1, *[0] * 20, 3, 2]) + b"\x20\0\1\0\3abc" + b"\x21\0\1\0\2de"
    assert nal.hevc_record(record) == (4, nal.START_CODE + b"abc" + nal.START_CODE + b"de")
    with pytest.raises(ValueError):
        nal.hevc_record(record[:-1])
    with pytest.raises(ValueError):
        nal.hevc_record(bytes([1, *[0] * 20, 3, 0, 0]))
    with pytest.raises(ValueError):
        nal.hevc_annex_b(unit(hevc(1, 1)), 4)


def test_avc_record():
    record = b"\1\x42\0\x1e\xff\xe1\0\2ab\1\0\3cde"
    assert nal.avc_record(record) == (4, [b"ab"], [b"cde"])
    with pytest.raises(ValueError):
        nal.avc_record(record[:-1])


# --- WAV --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("bits", "is_float"), [(8, False), (16, False), (24, False), (32, False), (32, True)])
@pytest.mark.parametrize("channels", [1, 2, 6])
def test_wav_round_trip(bits, is_float, channels):
    x = tone(440, 22050, 0.1, channels)
    data = wav.write(x, 22050, bits, is_float)
    info = wav.parse(data)
    assert (info.rate, info.channels, info.frames) == (22050, channels, len(x))
    assert np.allclose(wav.frames(data, info, 0, len(x)), x, atol=2 / (1 << min(bits - 1, 22)))
    assert np.array_equal(wav.frames(data, info, 100, 120), wav.frames(data, info, 0, len(x))[100:120])


def test_broken_wavs():
    data = wav.write(tone(440, 16000, 0.05), 16000)
    r = random.Random(7)
    for _ in range(200):
        broken = bytearray(data[: r.randrange(len(data))])
        for _ in range(r.randrange(4)):
            if broken:
                broken[r.randrange(len(broken))] = r.randrange(256)
        try:
            convert.epochs("x.wav", bytes(broken), IngestSpec())
        except IngestError:
            pass
    with pytest.raises(IngestError):
        convert.epochs("x.wav", wav.write(np.array([[np.nan]]), 16000, is_float=True), IngestSpec())
    with pytest.raises(IngestError):
        wav.parse(wav.write(tone(440, 16000, 0.01), 4000))


# --- MP4 --------------------------------------------------------------------------------------------------------------


def box(kind, *parts):
    body = b"".join(parts)
    return (len(body) + 8).to_bytes(4, "big") + kind + body


def u32(*values):
    return b"".join((v & 0xFFFFFFFF).to_bytes(4, "big") for v in values)


class Writer:
    """Bits of a parameter set."""

    def __init__(self):
        self.bits = ""

    def u(self, *pairs):
        for n, v in pairs:
            self.bits += f"{v:0{n}b}" if n else ""
        return self

    def ue(self, *values):
        for v in values:
            code = f"{v + 1:b}"
            self.bits += "0" * (len(code) - 1) + code
        return self

    def done(self, head):
        bits = self.bits + "1"
        bits += "0" * (-len(bits) % 8)
        raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
        out = bytearray()
        for b in raw:
            if out[-2:] == b"\0\0" and b <= 3:
                out.append(3)
            out.append(b)
        return head + bytes(out)


def avc_set(width=8, height=8, depth=0, progressive=1, matrix=None, full=0):
    w = Writer().u((8, 100), (8, 0), (8, 30)).ue(0, 1, depth, depth).u((1, 0), (1, 0)).ue(0, 2, 1).u((1, 0)).ue(-(-width // 16) - 1, -(-height // (16 if progressive else 32)) - 1).u((1, progressive))
    if not progressive:
        w.u((1, 0))
    w.u((1, 0), (1, 1)).ue(0, (-width % 16) // 2, 0, (-height % 16) // 2)
    w.u((1, matrix is not None))
    if matrix is not None:
        w.u((1, 0), (1, 0), (1, 1), (3, 5), (1, full), (1, 1), (8, 1), (8, 1), (8, matrix))
    return w.done(b"\x67")


def hevc_set(width=64, height=36, depth=0, profile=1, matrix=1, full=1):
    w = Writer().u((4, 0), (3, 0), (1, 1), (3, 0), (5, profile), (32, 1 << (31 - profile)), (1, 1), (1, 0), (46, 0), (8, 93)).ue(0, 1, -(-width // 8) * 8, -(-height // 8) * 8)
    w.u((1, 1)).ue(0, (-width % 8) // 2, 0, (-height % 8) // 2).ue(depth, depth, 4).u((1, 1)).ue(4, 0, 0, 0, 1, 0, 3, 0, 0).u((1, 0), (2, 0), (1, 0)).ue(2)
    w.ue(1, 0).ue(0).u((1, 1)).u((1, 1)).u((1, 0)).ue(0).u((1, 1), (1, 0), (1, 0))
    w.u((1, 0), (2, 0), (1, 1), (1, 1), (8, 1), (1, 0), (1, 1), (3, 5), (1, full), (1, 1), (8, 1), (8, 1), (8, matrix))
    return w.done(b"\x42\x01")


def test_parameter_sets():
    s = sps.avc(avc_set(1920, 1080, matrix=1, full=1))
    assert (s.profile, s.width, s.height, s.matrix, s.transfer, s.full) == (100, 1920, 1080, 1, 1, True)
    assert sps.colour([s], 1920, 1080, None, False) == (True, True)
    assert sps.colour([sps.avc(avc_set())], 8, 8, (6, 6, False), False) == (False, False)
    assert sps.colour([sps.avc(avc_set())], 8, 8, None, False) == (False, False)
    h = sps.hevc(hevc_set())
    assert (h.width, h.height, h.matrix, h.full, h.main) == (64, 36, 1, True, True) and sps.colour([h], 64, 36, None, True) == (True, True)
    for bad, size, box in ((avc_set(depth=2), (8, 8), None), (avc_set(progressive=0, height=32), (8, 32), None), (avc_set(), (8, 16), None), (avc_set(matrix=9), (8, 8), None), (avc_set(matrix=1), (8, 8), (1, 6, False)), (avc_set(8192, 8), (8192, 8), None), (avc_set(), (8, 8), (16, 2, False))):
        with pytest.raises(IngestError):
            sps.colour([sps.avc(bad)], *size, box, False)
    for bad in (hevc_set(profile=2), hevc_set(depth=2), hevc_set(matrix=9)):
        with pytest.raises(IngestError):
            sps.colour([sps.hevc(bad)], 64, 36, None, True)
    with pytest.raises(IngestError):
        sps.colour([], 8, 8, None, False)
    with pytest.raises(IngestError):
        sps.avc(avc_set()[:5])


def test_audio_config():
    esds = lambda config: bytes(4) + b"\x03\x19\0\0\0\x04\x11" + bytes(13) + b"\x05" + bytes([len(config)]) + config
    assert mp4.audio_config(esds(b"\x12\x10")) == (2, 44100, 2) and mp4.audio_config(esds(b"\x14\x30")) == (2, 16000, 6)
    for bad in (b"\x2a\x10", b"\x12\x38", b"\x12"):
        with pytest.raises(IngestError):
            mp4.audio_config(esds(bad))


def test_digest(tmp_path):
    (tmp_path / "a.wav").write_bytes(wav.write(tone(440, 16000, 1.1), 16000))
    ingest(str(tmp_path / "a.wav"), str(tmp_path / "1.arrow"), batch_epochs=1)
    ingest(str(tmp_path / "a.wav"), str(tmp_path / "2.arrow"))
    assert artifact.digest(str(tmp_path / "1.arrow")) == artifact.digest(str(tmp_path / "2.arrow")) and artifact.digest(str(tmp_path / "1.arrow"))["rows"] == 3


def movie(units, shifts, sync, step=1, scale=30, edits=(), codec=b"avc1", extra=()):
    payload = b"".join(units)
    sets = avc_set()
    config = box(b"avcC", b"\1\x64\0\x1e\xff\xe1" + len(sets).to_bytes(2, "big") + sets + b"\1\0\3\x68de")
    entry = box(codec, bytes(24), (8).to_bytes(2, "big"), (8).to_bytes(2, "big"), bytes(50), config)

    def tracks(at):
        stbl = [box(b"stsd", u32(0, 1), entry), box(b"stts", u32(0, 1, len(units), step)), box(b"ctts", u32(1 << 24, len(units)), *(u32(1, s) for s in shifts)), box(b"stss", u32(0, len(sync), *(s + 1 for s in sync))), box(b"stsz", u32(0, 0, len(units), *map(len, units))), box(b"stsc", u32(0, 1, 1, len(units), 1)), box(b"stco", u32(0, 1, at))]
        parts = [box(b"mdia", box(b"mdhd", u32(0, 0, 0, scale, len(units) * step, 0)), box(b"hdlr", u32(0, 0), b"vide", bytes(12)), box(b"minf", box(b"stbl", *stbl)))]
        if edits:
            parts.append(box(b"edts", box(b"elst", u32(0, len(edits)), *(u32(d, m) + b"\0\1\0\0" for m, d in edits))))
        return box(b"moov", box(b"mvhd", u32(0, 0, 0, 1000, 0)), box(b"trak", *parts), *extra)

    head = box(b"ftyp", b"isom", u32(0))
    return head + tracks(len(head) + len(tracks(0)) + 8) + box(b"mdat", payload)


def fake_decoder(config, samples):
    """A picture whose luma is its unit's last byte."""
    for _, t, raw in sorted(samples, key=lambda s: s[1]):
        yield t, bytes([raw[-1]]) * 64, b"\x80" * 16, b"\x80" * 16, 8, 8


def clip():
    order = [0, 3, 1, 2, 4, 7, 5, 6]
    units = [unit((b"\x65" if i in (0, 4) else b"\x41" if i % 4 == 1 else b"\x01") + bytes([100 + order[i]])) for i in range(8)]
    return movie(units, [o - i for i, o in enumerate(order)], [0, 4])


def test_mp4_sample_table():
    scale, tracks = mp4.parse(clip())
    s = mp4.samples(tracks[0], len(clip()))
    assert scale == 1000 and tracks[0].codec == "avc1" and (tracks[0].width, tracks[0].height) == (8, 8)
    assert [x.cts for x in s] == [0, 3, 1, 2, 4, 7, 5, 6] and [x.is_sync for x in s] == [i in (0, 4) for i in range(8)]
    assert [clip()[x.offset + x.size - 1] for x in s] == [100 + x.cts for x in s]


def test_edit_lists():
    t = mp4.Track(timescale=100, duration=1000)
    for edits, want in (([], (0, 0, 10)), ([(50, 0, 1.0)], (0.5, 0, 9.5)), ([(-1, 2000, 1.0), (0, 3000, 1.0)], (0, 2, 5))):
        t.edits = edits
        assert mp4.timeline(t, 1000) == want
    for edits in ([(-1, 5, 1.0)], [(0, 5, 2.0)], [(0, 5, 1.0)] * 2, [(0, 5, 1.0)] * 3):
        t.edits = edits
        with pytest.raises(IngestError):
            mp4.timeline(t, 1000)


def test_broken_mp4s():
    codecs.register("avc1", fake_decoder)
    data, r = clip(), random.Random(3)
    for _ in range(300):
        broken = bytearray(data[: r.randrange(len(data))] if r.random() < 0.5 else data)
        for _ in range(r.randrange(1, 4)):
            if broken:
                broken[r.randrange(len(broken))] = r.randrange(256)
        try:
            _, rows = convert.epochs("x.mp4", bytes(broken), IngestSpec(resolution=32, window_sec=0.05))
            for _, _row in zip(range(50), rows, strict=False):
                pass
        except (IngestError, ValueError):
            pass


def test_no_decoder():
    codecs._DECODERS.clear()
    with pytest.raises(IngestError, match="H.264"):
        convert.epochs("x.mp4", clip(), IngestSpec())


@pytest.mark.parametrize("skip_nonref", [True, False])
def test_video_from_end_to_end(tmp_path, skip_nonref):
    codecs.register("avc1", fake_decoder)
    (tmp_path / "a.mp4").write_bytes(clip())
    out = ingest(str(tmp_path / "a.mp4"), str(tmp_path / "a.arrow"), resolution=32, window_sec=0.05, skip_nonref=skip_nonref)
    with artifact.load(out["output"]) as d:
        times = [0, 33, 67, 100, 133, 167, 200, 233]
        want = [t for t, a, b in convert.choose(times, 50, 6) for _ in range(b - a)]
        assert len(d) == 6 and [int(d[i]["video_timestamp_ms"]) for i in range(6)] == want
        assert not d.has_audio and d.video_shape == (3, 32, 32) and float(d[0]["audio"].max()) == -10
        luma = [round(float((d[i]["video"][0, 0, 0] + 1) * 127.5 * 219 / 255 + 16)) for i in range(6)]
        assert luma == [100 + times.index(t) for t in want]


def long_clip(groups=6, codec=b"avc1"):
    """Groups of eight pictures in decode order I P B B P B B P, each after a refresh; times step by 40 ms."""
    order = [0, 3, 1, 2, 6, 4, 5, 7]
    units, shifts = [], []
    for g in range(groups):
        for i, o in enumerate(order):
            header = b"\x65" if i == 0 else b"\x41" if i in (1, 4, 7) else b"\x01"
            units.append(unit(header + bytes([20 + (8 * g + o) * 3 % 200])))
            shifts.append(8 * g + o - len(shifts))
    return movie(units, shifts, [8 * g for g in range(groups)], scale=25, codec=codec)


@pytest.mark.parametrize("skip_nonref", [True, False])
def test_chunks_decode_apart(spark, tmp_path, skip_nonref):
    """A file is decoded in several tasks, with the rows of one task; options take effect."""
    from epochgrid.sources import chunked

    codecs.register("avc1", fake_decoder)
    (tmp_path / "a.mp4").write_bytes(long_clip())
    (tmp_path / "b.mp4").write_bytes(long_clip(3))
    files = read_files(spark, str(tmp_path / "*.mp4"))
    spec = IngestSpec(resolution=32, window_sec=0.1, batch_epochs=2, chunk_target_ms=300, skip_nonref=skip_nonref)
    want = {}
    for name in ("a", "b"):
        _, rows = convert.epochs("x.mp4", (tmp_path / f"{name}.mp4").read_bytes(), spec)
        want[f"{name}.mp4"] = [(r["timestamp_ms"], r["audio_valid_frames"], r["video_timestamp_ms"], r["video_tensor"].tolist(), r["audio_mel_tensor"].tolist()) for r in rows]
    counts = {os.path.basename(r.path): (r.chunks, r.decoded) for r in chunked.chunk_counts(files, spec).collect()}
    assert counts["a.mp4"][0] == 6 and counts["b.mp4"][0] == 3 and (counts["a.mp4"][1] < 48) == skip_nonref
    longer = chunked.chunk_counts(files, IngestSpec(resolution=32, window_sec=0.1, chunk_target_ms=700)).collect()
    assert {os.path.basename(r.path): r.chunks for r in longer} == {"a.mp4": 2, "b.mp4": 1}  # groups last 320 ms
    table = chunked.chunked_epoch_table(files, spec, {"avc1": fake_decoder})
    rows = table.collect()
    assert len({r.pid for r in table.select("path", F.spark_partition_id().alias("pid")).collect()}) > 2
    for name in want:
        mine = sorted((r.timestamp_ms, r.audio_valid_frames, r.video_timestamp_ms, r.video_tensor, r.audio_mel_tensor) for r in rows if r.path.endswith(name))
        assert mine == want[name]


def test_a_broken_file_does_not_stop_the_others(spark, wavs):
    (wavs / "broken.wav").write_bytes((wavs / "a.wav").read_bytes()[:60])
    files = read_files(spark, *[str(wavs / f"{n}.wav") for n in ("a", "b", "broken")])
    rows = epoch_table(files, quarantine=True).collect()
    assert sorted({os.path.basename(r.path) for r in rows if r.error is None}) == ["a.wav", "b.wav"]
    assert [os.path.basename(r.path) for r in rows if r.error] == ["broken.wav"]
    with pytest.raises(Exception, match="IngestError|ValueError"):
        epoch_table(files).collect()


def test_changed_sets_are_refused():
    codecs.register("avc1", fake_decoder)
    good = clip()
    about, rows = convert.epochs("a.mp4", good, IngestSpec(resolution=32))
    assert about["matrix"] == "BT.601 limited" and len(list(rows)) == 1
    other = movie([unit(b"\x67changed", b"\x65\x80")] * 2, [0, 0], [0])
    with pytest.raises(IngestError, match="change"):
        list(convert.epochs("a.mp4", other, IngestSpec(resolution=32))[1])


def test_sample_table_in_spark(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(clip())
    rows = sample_table(read_files(spark, str(tmp_path / "a.mp4"))).orderBy("dec_idx").collect()
    assert [r.cts for r in rows] == [0, 3, 1, 2, 4, 7, 5, 6]


# --- conversion -------------------------------------------------------------------------------------------------------


@pytest.fixture
def wavs(tmp_path):
    for name, rate, channels in (("a", 44100, 2), ("b", 48000, 1), ("c", 16000, 6)):
        (tmp_path / f"{name}.wav").write_bytes(wav.write(tone(440, rate, 1.27, channels), rate))
    return tmp_path


def test_window(wavs):
    out = ingest(str(wavs / "a.wav"), str(wavs / "a.arrow"), window_sec=0.33, profile=True)
    with artifact.load(out["output"]) as d:
        assert d.audio_shape == (33, 64) and [int(d[i]["timestamp_ms"]) for i in range(4)] == [0, 330, 660, 990]
        assert int(d[-1]["timestamp_ms"]) == 990 and out["epochs"] == 4 and not d.has_video
        assert sum(int(d[i]["audio_valid_frames"]) for i in range(4)) == 127
        with pytest.raises(IndexError):
            d[4]
        with pytest.raises(ValueError):
            d.get_batch(0)["audio"][0] = 0
    assert "stages_seconds" in out["profile"]


def test_batches_do_not_matter(wavs):
    seen = []
    for n in (1, 2, 32):
        ingest(str(wavs / "b.wav"), str(wavs / f"{n}.arrow"), batch_epochs=n)
        with artifact.load(str(wavs / f"{n}.arrow"), copy=True) as d:
            assert d.reader.num_record_batches == -(-3 // n)
            seen.append(np.concatenate([b["audio"] for b in d.iter_batches()]))
    assert np.array_equal(seen[0], seen[1]) and np.array_equal(seen[0], seen[2])


def test_against_double_precision(wavs):
    """An independent evaluation of the definition, one frame at a time."""
    data = (wavs / "a.wav").read_bytes()
    _, rows = convert.epochs("a.wav", data, IngestSpec())
    mel = next(rows)["audio_mel_tensor"].reshape(50, 64)
    x = tone(440, 44100, 1.27)[:, 0].astype(float)
    cutoff, bank = 0.95 * 16000 / 44100, kernels.mel_filters().astype(float)
    for frame in (5, 20, 49):
        y = []
        for n in range(frame * 160, frame * 160 + 400):
            src = n * 44100 / 16000
            k = np.arange(int(src) - 64, int(src) + 65)
            off = k - int(src) - round((src - int(src)) * 1024) / 1024
            w = np.sinc(off * cutoff) * np.where(abs(off) <= 64, 0.42 - 0.5 * np.cos(2 * np.pi * (off + 64) / 128) + 0.08 * np.cos(4 * np.pi * (off + 64) / 128), 0)
            y.append((w / w.sum() * np.where((k >= 0) & (k < len(x)), x[np.clip(k, 0, len(x) - 1)], 0)).sum())
        power = abs(np.fft.rfft(np.array(y) * 0.5 * (1 - np.cos(2 * np.pi * np.arange(400) / 399)))) ** 2
        want = np.log10(bank @ power + 1e-10)
        loud = want > -5
        assert abs(mel[frame][loud] - want[loud]).max() < 2e-2


def test_nothing_is_overwritten_or_left(wavs):
    (wavs / "x.arrow").write_text("mine")
    with pytest.raises(IngestError, match="exists"):
        ingest(str(wavs / "a.wav"), str(wavs / "x.arrow"))
    assert (wavs / "x.arrow").read_text() == "mine"
    for name, body in (("empty.wav", b""), ("bad.wav", b"RIFF"), ("song.mp3", b"xx")):
        (wavs / name).write_bytes(body)
        with pytest.raises(IngestError):
            ingest(str(wavs / name), str(wavs / "y.arrow"))
        assert not (wavs / "y.arrow").exists()

    def rows():
        yield {"timestamp_ms": 0, "audio_valid_frames": 0, "audio_mel_tensor": np.zeros(3200, np.float32)}
        raise RuntimeError

    with pytest.raises(RuntimeError):
        artifact.write(str(wavs / "z.arrow"), artifact.schema(IngestSpec(), True, False), rows(), 1)
    assert not (wavs / "z.arrow").exists()


def test_options():
    for bad in ({"window_sec": 0.333}, {"window_sec": 11}, {"resolution": 16}, {"batch_epochs": 0}, {"resolution": 1024, "batch_epochs": 1024}, {"execution": "x"}, {"decoder_threads": 3}, {"decoder_threads": 2, "video_workers": 2}, {"chunk_target_ms": 1}, {"queue_depth": 5}):
        with pytest.raises(UsageError):
            IngestSpec(**bad)
    assert [IngestSpec(decoder_threads=n).decoder_threads for n in (0, 1, 2, 4)] == [0, 1, 2, 4]


def test_tail():
    spec = IngestSpec()
    assert convert._checked_tail(47983, 48000, 48000, 0, spec) == 15994
    with pytest.raises(IngestError, match="200.000 ms"):
        convert._checked_tail(38400, 48000, 48000, 0, spec)
    assert convert._checked_tail(47040, 48000, 48000, 0, IngestSpec(audio_tail_tolerance_ms=25)) == 15680
    with pytest.raises(IngestError, match="1 samples"):
        convert._checked_tail(47999, 48000, 48000, 0, IngestSpec(audio_tail_tolerance_ms=0))


def test_cli(wavs, capsys):
    assert cli.main(["-i", str(wavs / "a.wav"), "-o", str(wavs / "cli.arrow"), "--batch-epochs", "2"]) == 0
    assert "3 epochs" in capsys.readouterr().err
    assert cli.main(["-i", str(wavs / "none.wav"), "-o", str(wavs / "n.arrow"), "-q"]) == 1


def test_public_names_and_batch(spark, wavs, capsys):
    import epochgrid
    from epochgrid import batch

    assert epochgrid.ingest is ingest and epochgrid.load is artifact.load and issubclass(epochgrid.IngestError, RuntimeError) and issubclass(epochgrid.UsageError, ValueError)
    with pytest.raises(AttributeError):
        epochgrid.nothing  # noqa: B018
    assert batch.main(["--out-dir", str(wavs / "o"), "--jobs", "2", str(wavs / "a.wav"), str(wavs / "b.wav")]) == 0
    assert capsys.readouterr().err.count("3 epochs") == 2
    assert batch.main(["--out-dir", str(wavs / "o"), str(wavs / "a.wav")]) == 1
    assert batch.main(["--out-dir", str(wavs / "o"), "--skip-existing", str(wavs / "a.wav")]) == 0


def test_many_files(spark, wavs):
    (wavs / "bad.wav").write_bytes(b"RIFFxxxx")
    names = [str(wavs / f"{n}.wav") for n in ("a", "b", "c", "bad")]
    got = {os.path.basename(r.path): r for r in ingest_many(spark, names, str(wavs / "out")).collect()}
    assert got["a.wav"].epochs == 3 and got["bad.wav"].error and sorted(os.listdir(wavs / "out")) == ["a.arrow", "b.arrow", "c.arrow"]
    again = ingest_many(spark, names[:3], str(wavs / "out"), skip_existing=True).collect()
    assert all(r.error is None and r.epochs == 3 for r in again)
    with pytest.raises(UsageError):
        ingest_many(spark, [names[0], "/elsewhere/a.mp4"], str(wavs / "out"))


def test_epoch_table_and_source(spark, wavs):
    df = epoch_table(read_files(spark, *[str(wavs / f"{n}.wav") for n in "abc"]), IngestSpec(batch_epochs=2))
    rows = df.groupBy("path").agg(F.count("*").alias("n"), F.max("timestamp_ms").alias("last"), F.sum("audio_valid_frames").alias("valid")).collect()
    assert sorted((r.n, r.last, r.valid) for r in rows) == [(3, 1000, 127)] * 3
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EpochSource)
    out = str(wavs / "table")
    one = df.where(F.col("path").endswith("a.wav")).select("timestamp_ms", "audio_valid_frames", "audio_mel_tensor")
    one.write.format("epochs").mode("append").save(out)
    back = spark.read.format("epochs").load(out)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, one.collect()))
    assert [r.timestamp_ms for r in spark.read.format("epochs").load(out).where("timestamp_ms >= 1000").collect()] == [1000]
    assert not [f for f in os.listdir(out) if f.endswith(".part")]
    assert pa.ipc.open_file(os.path.join(out, sorted(os.listdir(out))[0])).schema.field("audio_mel_tensor").type == pa.list_(pa.float32(), 3200)
    one.where("timestamp_ms > 0").write.format("epochs").mode("overwrite").save(out)
    assert sorted(r.timestamp_ms for r in spark.read.format("epochs").load(out).collect()) == [500, 1000]


def test_broken_part_leaves_old_files(tmp_path):
    kind = pa.schema([("timestamp_ms", pa.int64())])
    for rows in (1, 2):
        writer = EpochWriter(str(tmp_path), True)
        done = [writer.write(iter([pa.record_batch([pa.array([at])], schema=kind)])) for at in range(rows)]
        writer.commit([*done, None])
        assert sorted(r for b in EpochReader(str(tmp_path), from_arrow_schema(kind)).partitions() for r in [b.index]) == [0] * rows
    writer = EpochWriter(str(tmp_path), True)
    good, bad = (writer.write(iter([pa.record_batch([pa.array([7])], schema=kind)])) for _ in range(2))
    before = sorted(f for f in os.listdir(tmp_path) if f.endswith(".arrow"))
    bad.rows += 1
    with pytest.raises(IngestError, match="not complete"):
        writer.commit([good, bad])
    writer.abort([])
    assert sorted(os.listdir(tmp_path)) == before and len(before) == 2


# --- streams ----------------------------------------------------------------------------------------------------------


def test_file_stream(spark, wavs, tmp_path):
    from epochgrid.streaming.tracks import epoch_stream, file_stream

    (wavs / "a.wav").rename(tmp_path / "in.wav") if not (tmp_path / "in.wav").exists() else None
    q = epoch_stream(file_stream(spark, str(wavs), "*.wav")).writeStream.format("memory").queryName("epochs_seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select count(distinct path), count(*) from epochs_seen").first()[:] == (3, 9)


def test_presentation_order_in_a_stream(spark, tmp_path):
    from epochgrid.streaming.tracks import presented

    def run(rows, name):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, "clip_id string, dec_idx long, pts long").coalesce(1).write.parquet(folder)
        s = spark.readStream.schema("clip_id string, dec_idx long, pts long").parquet(folder)
        q = presented(s).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        return [r.pts for r in spark.table(name).collect()]

    order = [p for g in range(30) for p in (g * 4, g * 4 + 3, g * 4 + 1, g * 4 + 2)]
    assert run([("a", i, p) for i, p in enumerate(order)] + [("a", len(order), None)], "ordered") == list(range(120))
    with pytest.raises(Exception, match="comes after"):
        run([("a", i, p) for i, p in enumerate([*range(1, 71), 0])], "late")


def test_presentation_order_over_triggers(spark, tmp_path):
    """Pictures that come before their turn wait for those before; a clip's end removes its state."""
    from epochgrid.streaming.tracks import presented

    folder = tmp_path / "in"
    order = [p for g in range(30) for p in (g * 4, g * 4 + 3, g * 4 + 1, g * 4 + 2)]
    rows = [(c, i, p) for c in "ab" for i, p in enumerate(order)] + [("a", 120, None)]
    random.Random(5).shuffle(rows)
    for k in range(4):
        spark.createDataFrame(rows[k::4], "clip_id string, dec_idx long, pts long").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema("clip_id string, dec_idx long, pts long").option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = presented(stream).writeStream.format("memory").queryName("over_triggers").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("over_triggers").collect()
    assert [r.pts for r in got if r.clip_id == "a"] == list(range(120))
    assert [r.pts for r in got if r.clip_id == "b"] == list(range(120 - 34))
    states = [op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]]
    assert states[-1] == 1
