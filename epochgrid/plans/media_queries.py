"""The functions that conversions run, on bytes and samples made of the tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, nal
from ..operators import compare
from ..sources import convert, mp4
from ..spec import IngestError, IngestSpec
from .registry import E6, TRACK_SQL, query, read, scaled, track
from .signal_queries import _SINC, _corners


def mapped(rows: DataFrame, schema: str, work: Callable[..., list[tuple]]) -> DataFrame:
    """work(lists, one for each column) gives the rows of a batch."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out = work(*(c.to_pylist() for c in batch.columns))
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return rows.mapInArrow(run, schema)


@query("""
WITH u AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 7 + l_partkey) % 64 AS kind, l_suppkey % 2 AS layer, CAST(l_linenumber % 3 AS BIGINT) AS tid FROM lineitem)
SELECT l_orderkey, l_linenumber, kind, layer, tid, layer = 0 AND kind <= 14 AND kind % 2 = 0 AND tid = 2 AS disposable, layer = 0 AND kind BETWEEN 16 AND 23 AS irap, layer = 0 AND kind IN (8, 9) AS rasl FROM u""")
def hevc_classify(spark, sf_dir):
    """One H.265 unit for each line item: classes from its two header bytes."""
    kind = (F.col("l_orderkey") * 7 + F.col("l_partkey")) % 64
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"), (F.col("l_suppkey") % 2).alias("layer"), (F.col("l_linenumber") % 3).cast("long").alias("tid"))

    def work(order, line, kinds, layers, tids):
        out = []
        for o, n, k, layer, t in zip(order, line, kinds, layers, tids, strict=True):
            unit = b"\0\0\0\3" + bytes([k << 1 | layer >> 5, (layer & 31) << 3 | t + 1, 0x80])
            out.append((o, n, k, layer, t, nal.hevc_disposable(unit, 4, 2), *nal.hevc_classify(unit, 4)))
        return out

    out = mapped(rows, "l_orderkey long, l_linenumber long, kind long, layer long, tid long, disposable boolean, irap boolean, rasl boolean", work)
    return out.withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


def _start_codes(header: str) -> str:
    return f"sha256(unhex(string_agg('00000001{header}' || hex(encode(line)), '' ORDER BY pos)))"


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)
SELECT doc_id, count(*) AS units, {_start_codes("01")} AS avc, {_start_codes("0201")} AS hevc FROM l GROUP BY doc_id""")
def start_codes(spark, sf_dir):
    """Lines of a document as units with a prefix of four bytes, rewritten to start codes, under headers of both codecs."""

    def work(ids, texts):
        out = []
        for i, text in zip(ids, texts, strict=True):
            lines = [x.encode() for x in (text or "").split("\n")]
            packed = [b"".join((len(h) + len(x)).to_bytes(4, "big") + h + x for x in lines) for h in (b"\x01", b"\x02\x01")]
            out.append((i, len(lines), hashlib.sha256(nal.avc_annex_b(packed[0], 4)).hexdigest(), hashlib.sha256(nal.hevc_annex_b(packed[1], 4)).hexdigest()))
        return out

    return mapped(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id long, units long, avc string, hevc string", work)


@query(f"""
WITH {TRACK_SQL}, d AS (SELECT clip_id, event_type, rn, first_value(event_type) OVER (PARTITION BY clip_id ORDER BY rn) AS declared FROM track)
SELECT clip_id, count(*) AS units, CASE WHEN count(*) FILTER (rn % 40 = 0 AND event_type <> declared AND clip_id % 2 = 0) > 0 THEN 'refused' ELSE 'kept' END AS verdict FROM d GROUP BY clip_id""")
def declared_sets(spark, sf_dir):
    """Every 40th unit of a clip is a parameter set named like its event; of even clips with that name, of odd ones with the declared."""
    rows = track(spark, sf_dir).groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("rn", "event_type"))).alias("units"))

    def work(clips, units):
        out = []
        for clip, own in zip(clips, units, strict=True):
            named = lambda kind: bytes([32 << 1, 1]) + kind.encode()
            declared = named(own[0]["event_type"])
            config = bytes([1, *[0] * 20, 3, 1, 32, 0, 1]) + len(declared).to_bytes(2, "big") + declared
            data, samples = b"", []
            for u in own:
                raw = (named(u["event_type"]) if clip % 2 == 0 else declared) if u["rn"] % 40 == 0 else bytes([2, 1, 0x80])
                raw = len(raw).to_bytes(4, "big") + raw
                samples.append((mp4.Sample(u["rn"], 0, 0, 0, False, len(data), len(raw)), u["rn"]))
                data += raw
            try:
                convert.guard_sets(mp4.Track(codec="hvc1", config=config), samples, data)
                verdict = "kept"
            except IngestError:
                verdict = "refused"
            out.append((clip, len(own), verdict))
        return out

    return mapped(rows, "clip_id long, units long, verdict string", work)


@query(f"""
WITH x AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(len(embedding))) AS pos FROM embeddings), d AS (SELECT a.label, a.v, abs(a.v - b.v) AS d FROM x a JOIN x b ON b.vec_id = a.vec_id + 1 AND b.pos = a.pos)
SELECT label, count(*) AS n, CAST(round(max(d) * {E6}) AS BIGINT) AS most_e6, CAST(round(avg(d) * {E6}) AS BIGINT) AS mae_e6, count(*) FILTER (v > 0) AS n_masked, CAST(round(avg(d) FILTER (v > 0) * {E6}) AS BIGINT) AS mae_masked_e6 FROM d GROUP BY label""")
def artifact_compare(spark, sf_dir):
    """Each vector against the next one, as two artifacts joined on their keys."""
    x = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "v"))
    met = compare.differences(x, x.select((F.col("vec_id") - 1).alias("vec_id"), "pos", "v"), ["vec_id", "pos"], "v")
    m = compare.metrics(met, ["label"], F.col("reference") > 0)
    return m.select("label", "n", scaled(F.col("most")).alias("most_e6"), scaled(F.col("mae")).alias("mae_e6"), "n_masked", scaled(F.col("mae_masked")).alias("mae_masked_e6"))


@query("""
WITH s AS (SELECT p_partkey, CAST(p_size AS BIGINT) + 4 AS hops, 32 + p_partkey % 200 AS size FROM part)
SELECT p_partkey, hops AS frames, hops * 10 AS window_ms, (3 * size * size + 64 * hops) * 4 AS row_bytes, CASE WHEN (3 * size * size + 64 * hops) * 4 * 400 <= 268435456 THEN 'fits' ELSE 'refused' END AS batch FROM s""")
def window_options(spark, sf_dir):
    """Options of a conversion: frames of a window, its length, and whether a batch of 400 epochs is allowed."""

    def work(keys, sizes):
        out = []
        for key, size in zip(keys, sizes, strict=True):
            spec = IngestSpec(window_sec=(size + 4) / 100, resolution=32 + key % 200, batch_epochs=1)
            try:
                IngestSpec(window_sec=(size + 4) / 100, resolution=32 + key % 200, batch_epochs=400)
                batch = "fits"
            except ValueError:
                batch = "refused"
            out.append((key, spec.frames, spec.window_ms, spec.row_bytes, batch))
        return out

    return mapped(read(spark, sf_dir, "part").select("p_partkey", "p_size").where("p_size > 0"), "p_partkey long, frames long, window_ms long, row_bytes long, batch string", work)


@query("""
WITH p AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(abs(x) * 1000) AS BIGINT) % 256) AS y FROM embeddings),
g AS (SELECT vec_id, y, unnest(range(75)) AS cell FROM p)
SELECT vec_id, cell, CAST(round((least(255e0, greatest(y[(cell % 25 // 5 * 7 // 4) * 8 + cell % 5 * 7 // 4 + 1] - 16, 0) * (255e0 / 219)) / 127.5e0 - 1) * 1000) AS BIGINT) AS v_e3 FROM g""")
def picture_tensor(spark, sf_dir):
    """Planes of 8 x 8 in rows of 10 bytes, without colour, as tensors of 3 x 5 x 5."""

    def work(ids, vectors):
        out = []
        for i, x in zip(ids, vectors, strict=True):
            plane = np.zeros((8, 10), np.uint8)
            plane[:, :8] = (np.floor(np.abs(np.asarray(x, np.float64)) * 1000) % 256).reshape(8, 8)
            grey = b"\x80" * 16
            tensor = kernels.to_tensor(plane.tobytes(), grey, grey, 8, 8, 5, False, False).astype(np.float64)
            out += [(i, k, int(np.floor(v * 1000 + 0.5)) if v >= 0 else -int(np.floor(-v * 1000 + 0.5))) for k, v in enumerate(tensor.tolist())]
        return out

    return mapped(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id long, cell long, v_e3 long", work)


@query(f"""
WITH h AS (SELECT vec_id, list_transform(range(64), lambda n: CAST(embedding[n + 1] AS DOUBLE) * 0.5e0 * (1 - cos(2 * pi() * n / 399))) AS h FROM embeddings),
wave AS (SELECT k, list_transform(range(64), lambda n: cos(2 * pi() * k * n / 400)) AS re, list_transform(range(64), lambda n: sin(2 * pi() * k * n / 400)) AS im FROM (SELECT unnest(range(201)) AS k)),
p AS (SELECT vec_id, k, power(list_dot_product(h, re), 2) + power(list_dot_product(h, im), 2) AS e FROM h, wave),
{_corners(64, 400)},
m AS (SELECT vec_id, m, log10(sum(w * e) + 1e-10) AS v FROM p JOIN (SELECT * FROM bank WHERE w > 0) b ON b.k = p.k GROUP BY ALL)
SELECT vec_id, arg_max(m, v) AS loudest, arg_min(m, v) AS quietest FROM m GROUP BY vec_id""")
def mel_bands(spark, sf_dir):
    """A frame of 400 samples, 201 bins and 64 bands, as conversions compute it: the loudest and the quietest band."""

    def work(ids, vectors):
        out = []
        for i, x in zip(ids, vectors, strict=True):
            mel = kernels.log_mel(np.asarray(x, np.float32), 1)[0]
            out.append((i, int(mel.argmax()), int(mel.argmin())))
        return out

    return mapped(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id long, loudest long, quietest long", work)


@query(f"""
WITH {_SINC.format(cutoff="(0.95e0 * 16000 / 24000)")},
o AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, unnest(range(42)) AS pos FROM embeddings),
c AS (SELECT *, pos * 24000e0 / 16000 AS src FROM o),
y AS (SELECT c.vec_id, c.pos, sum(c.x[CAST(floor(src) AS BIGINT) + s.t + 1] * s.w) AS y FROM c JOIN sinc s ON s.p = least(round((src - floor(src)) * 1024), 1023) AND floor(src) + s.t BETWEEN 0 AND 63 GROUP BY ALL)
SELECT vec_id, arg_max(pos, y) AS highest, arg_min(pos, y) AS lowest FROM y GROUP BY vec_id""")
def resample_peaks(spark, sf_dir):
    """64 samples at 24 kHz resampled as conversions do: where the result is highest and lowest."""

    def work(ids, vectors):
        out = []
        for i, x in zip(ids, vectors, strict=True):
            y = kernels.resample(np.asarray(x, np.float32), 0, 64, 24_000, 0, 42, 0, 42)
            out.append((i, int(np.argmax(y)), int(np.argmin(y))))
        return out

    return mapped(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id long, highest long, lowest long", work)


@query("""
WITH t AS (SELECT o_orderkey, [8000, 16000, 44100, 48000][CAST(o_orderkey % 4 + 1 AS BIGINT)] AS rate, o_custkey % 2000 AS skip_units, 1 + CAST(floor(o_totalprice) AS BIGINT) % 90000 AS units FROM orders)
SELECT o_orderkey, skip_units AS skipped, units AS length, units * 16000 // rate AS total FROM t""")
def priming_trim(spark, sf_dir):
    """Priming samples that an edit list leaves out of a track, and what is left, in samples of the source and of the output."""

    def work(keys, rates, skips, units):
        out = []
        for key, rate, skip, n in zip(keys, rates, skips, units, strict=True):
            span = convert.audio_span(mp4.Track(kind="audio", codec="sowt", timescale=rate, rate=rate, duration=skip + n, edits=[(skip, n, 1.0)], entries=1), rate)
            out.append((key, span.skip, span.length, span.total))
        return out

    rate = F.element_at(F.array(*[F.lit(r) for r in (8000, 16000, 44100, 48000)]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", rate.alias("rate"), (F.col("o_custkey") % 2000).alias("skip"), (F.floor("o_totalprice") % 90000 + 1).alias("units"))
    return mapped(rows, "o_orderkey long, skipped long, length long, total long", work)
