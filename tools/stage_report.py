"""Stage and task times from a Spark event log (no UI needed).

Usage:
  BENCH_EVENT_LOG=$(mktemp -d /tmp/run-XXXXXX) python bench.py
  python tools/stage_report.py $BENCH_EVENT_LOG [top_n]
Reads the newest application log in the folder (plain, rolling or
zstd-compressed) and prints the slowest stages with task counts and the
shuffle bytes they wrote and read.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def _lines(path: str):
    files = sorted(glob.glob(os.path.join(path, "events_*"))) if os.path.isdir(path) else [path]
    for f in files:
        raw = open(f, "rb")
        if f.endswith(".zstd"):
            import zstandard

            raw = zstandard.ZstdDecompressor().stream_reader(raw)
        yield from io.TextIOWrapper(raw, encoding="utf-8")


def main() -> None:
    folder = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    apps = sorted(glob.glob(os.path.join(folder, "*")), key=os.path.getmtime)
    stages = {}
    for line in _lines(apps[-1]):
        e = json.loads(line)
        if e["Event"] == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            acc = {a.get("Name"): a.get("Value") for a in si.get("Accumulables", [])}
            stages[si["Stage ID"]] = {
                "name": si["Stage Name"].split(" at ")[0][:40],
                "tasks": si["Number of Tasks"],
                "ms": si.get("Completion Time", 0) - si.get("Submission Time", 0),
                "shuffle_write": int(acc.get("internal.metrics.shuffle.write.bytesWritten", 0) or 0),
                "shuffle_read": int(acc.get("internal.metrics.shuffle.read.localBytesRead", 0) or 0)
                + int(acc.get("internal.metrics.shuffle.read.remoteBytesRead", 0) or 0),
            }
    total = sum(s["ms"] for s in stages.values())
    print(f"{len(stages)} stages, {total / 1000:.1f} s of stage time")
    for sid, s in sorted(stages.items(), key=lambda kv: -kv[1]["ms"])[:top]:
        print(f"stage {sid:5d} {s['ms']:7d} ms {s['tasks']:5d} tasks  shuffle w {s['shuffle_write']:>10d} B  r {s['shuffle_read']:>10d} B  {s['name']}")


if __name__ == "__main__":
    main()
