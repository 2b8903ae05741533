"""python -m epochgrid.cli -i INPUT -o OUTPUT [options]"""

from __future__ import annotations

import argparse
import json
import sys

from .sources.ingest import ingest
from .spec import IngestError, IngestSpec, UsageError


def parser() -> argparse.ArgumentParser:
    d = IngestSpec()
    p = argparse.ArgumentParser(prog="epochgrid")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-w", "--window-sec", type=float, default=d.window_sec)
    for name in ("resolution", "batch_epochs", "queue_mib", "queue_depth", "decoder_threads", "video_workers", "chunk_target_ms", "video_buffer_mib", "audio_tail_tolerance_ms"):
        p.add_argument(f"--{name.replace('_', '-')}", type=int, default=getattr(d, name))
    p.add_argument("--execution", choices=("sequential", "concurrent"), default=d.execution)
    p.add_argument("--no-skip-nonref", dest="skip_nonref", action="store_false")
    p.add_argument("--no-audio-decode-thread", dest="audio_decode_thread", action="store_false")
    p.add_argument("--profile", action="store_true")
    p.add_argument("-q", "--quiet", dest="verbose", action="store_false")
    return p


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    source, output = args.pop("input"), args.pop("output")
    try:
        result = ingest(source, output, **args)
    except (IngestError, UsageError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if args["verbose"]:
        print(f"{result['epochs']} epochs in {result['seconds']:.3f} s", file=sys.stderr)
        if "profile" in result:
            print(json.dumps(result["profile"]), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
