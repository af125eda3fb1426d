"""Command line: weir.cli --input PATH --output-dir DIR [--profile NAME] [--mime TYPE] [--ffmpeg BIN] [--ffprobe BIN].

Decides all files under a path (or one file) and writes released artifacts and a report for each. Exit codes: 0 all
released, 2 some withheld, 1 wrong usage or a file above the profile's limit.
"""

from __future__ import annotations

import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weir.operators.pipeline import defend
from weir.plans.policy import PROFILE_ALIASES, PROFILES, merged, policy_table, profile
from weir.sources.derived import files
from weir.sources.sinks import json_report, write_artifacts, write_new

FLAGS = ("--input", "--output-dir", "--profile", "--mime", "--ffmpeg", "--ffprobe")


def parse(args: list[str]) -> dict[str, str]:
    """Flags with values; a repeated or unknown flag, or one without a value, is an error."""
    out: dict[str, str] = {}
    rest = list(args)
    while rest:
        flag = rest.pop(0)
        if flag not in FLAGS:
            raise ValueError(f"unknown argument {flag}")
        if flag in out:
            raise ValueError(f"{flag} is given twice")
        if not rest or rest[0].startswith("--"):
            raise ValueError(f"{flag} has no value")
        out[flag] = rest.pop(0)
    for flag in ("--input", "--output-dir"):
        if flag not in out:
            raise ValueError(f"{flag} is missing")
    name = out.get("--profile", "dissertation")
    if name not in PROFILES and name not in PROFILE_ALIASES:
        raise ValueError(f"unknown profile {name}")
    return out


def run(spark: SparkSession, args: list[str]) -> int:
    try:
        flags = parse(args)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    name, folder = flags.get("--profile", "dissertation"), flags["--output-dir"]
    policy = profile(name)
    for flag, key in (("--ffmpeg", "ffmpeg_bin"), ("--ffprobe", "ffprobe_bin")):
        if flag in flags:
            policy = merged(policy, {"audio": {key: flags[flag]}, "video": {key: flags[flag]}})
    found = files(spark, flags["--input"], policy["max_input_size_bytes"])
    if not found.filter("payload IS NULL").isEmpty():
        print("a file is above the profile's limit", file=sys.stderr)
        return 1
    if "--mime" in flags:
        found = found.withColumn("declared_mime", F.lit(flags["--mime"]))
    os.makedirs(folder, exist_ok=True)
    results = defend(found, policy_table(spark, {name: policy}), default=name).persist()
    written = {r["object_id"]: r for r in write_artifacts(results, folder).toLocalIterator()}
    code = 0
    for r in json_report(results, name).join(results.select("object_id", "released"), "object_id").toLocalIterator():
        report, path = json.loads(r["report"]), os.path.join(folder, f"{r['object_id']}.json")
        report["output_path"] = written[str(r["object_id"])]["path"] if r["released"] else None
        report["report_path"] = path
        write_new(path, json.dumps(report, indent=2, ensure_ascii=False).encode())
        code = code if r["released"] else 2
    results.unpersist()
    return code


def main() -> None:
    spark = SparkSession.builder.appName("weir").getOrCreate()
    code = run(spark, sys.argv[1:])
    spark.stop()
    sys.exit(code)


if __name__ == "__main__":
    main()
