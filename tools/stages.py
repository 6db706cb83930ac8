"""Summarise a Spark event log (written by ``bench.py`` with BENCH_EVENT_LOG_DIR)
into per-job stage and task times - the stage view without a web UI.

    BENCH_EVENT_LOG_DIR=$(mktemp -d /tmp/run-XXXXXX) python bench.py q09_dissatisfied_categories
    python tools/stages.py <that folder>
"""

from __future__ import annotations

import glob
import json
import os
import sys


def _lines(path: str):
    with open(path, "rb") as fh:
        raw = fh.read()
    if path.endswith(".zstd"):
        import zstandard
        with open(path, "rb") as fh:
            raw = zstandard.ZstdDecompressor().stream_reader(fh).read()
    return raw.decode("utf-8", "replace").splitlines()


def summarise(folder: str) -> None:
    files = sorted(glob.glob(os.path.join(folder, "**", "events*"), recursive=True)
                   + glob.glob(os.path.join(folder, "*", "*")), key=os.path.getmtime)
    jobs, stages, tasks, groups = {}, {}, {}, {}
    for f in dict.fromkeys(files):
        if os.path.isdir(f) or "appstatus" in os.path.basename(f):
            continue
        for line in _lines(f):
            try:
                ev = json.loads(line)
            except ValueError:
                continue
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                jobs[ev["Job ID"]] = [ev["Submission Time"], None]
                groups[ev["Job ID"]] = (ev.get("Properties") or {}).get("spark.job.description", "")
            elif kind == "SparkListenerJobEnd" and ev["Job ID"] in jobs:
                jobs[ev["Job ID"]][1] = ev["Completion Time"]
            elif kind == "SparkListenerStageCompleted":
                si = ev["Stage Info"]
                stages[si["Stage ID"]] = (si["Number of Tasks"],
                                          si.get("Completion Time", 0) - si.get("Submission Time", 0))
            elif kind == "SparkListenerTaskEnd":
                ti = ev["Task Info"]
                tasks.setdefault(ev["Stage ID"], []).append(ti["Finish Time"] - ti["Launch Time"])
    for jid, (start, end) in sorted(jobs.items()):
        print(f"job {jid:4d}  {((end or start) - start):6d} ms  {groups.get(jid, '')[:60]}")
    print("stage  tasks  wall_ms  slowest_task_ms  median_task_ms")
    for sid, (n, ms) in sorted(stages.items()):
        ts = sorted(tasks.get(sid, [0]))
        print(f"{sid:5d}  {n:5d}  {ms:7d}  {ts[-1]:15d}  {ts[len(ts) // 2]:14d}")


if __name__ == "__main__":
    summarise(sys.argv[1])
