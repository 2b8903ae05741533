"""python -m epochgrid.batch --out-dir DIR FILE... : one artifact for each file, many files at once."""

from __future__ import annotations

import argparse
import os
import sys

from .operators.planning import jobs_and_workers
from .spec import IngestError, UsageError


#: Options of a conversion that go on to every file.
PASSED = ("resolution", "batch_epochs", "chunk_target_ms", "video_buffer_mib", "audio_tail_tolerance_ms", "decoder_threads")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="epochgrid.batch")
    p.add_argument("files", nargs="+")
    p.add_argument("--out-dir", required=True)
    p.add_argument("--cores", type=int, default=os.cpu_count() or 1)
    p.add_argument("--jobs", type=int)
    p.add_argument("--workers-per-file", type=int)
    p.add_argument("--max-rss-mib", type=int)
    p.add_argument("--skip-existing", action="store_true")
    p.add_argument("--window-sec", type=float)
    for name in PASSED:
        p.add_argument(f"--{name.replace('_', '-')}", type=int)
    p.add_argument("--no-skip-nonref", dest="skip_nonref", action="store_false", default=None)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    jobs, workers = jobs_and_workers(len(args.files), args.cores, args.jobs, args.workers_per_file, args.max_rss_mib)
    options = {k: v for k, v in ((n, getattr(args, n)) for n in ("window_sec", "skip_nonref", *PASSED)) if v is not None}
    if not options.get("decoder_threads"):
        options["video_workers"] = workers
    from pyspark.sql import SparkSession

    from .sources.ingest import ingest_many

    active = SparkSession.getActiveSession()
    spark = active or SparkSession.builder.master(f"local[{jobs}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        rows = ingest_many(spark, [os.path.abspath(f) for f in args.files], os.path.abspath(args.out_dir), args.skip_existing, **options).collect()
    except (IngestError, UsageError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        if active is None:
            spark.stop()
    for r in sorted(rows, key=lambda r: r.path):
        print(f"{r.path}: {r.error or f'{r.epochs} epochs in {r.seconds:.3f} s'}", file=sys.stderr)
    return int(any(r.error for r in rows))


if __name__ == "__main__":
    sys.exit(main())
