"""Sinks: released artifacts, JSON reports, wire metadata, audit and evidence tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions import names

# Numbers on the wire.
VERDICTS = {"clean": 0, "suspicious": 1, "blocked": 2}
KINDS = {"image": 0, "gif": 1, "video": 2, "audio": 3, "other": 4, "animated_image": 5}
STAGE_NUMBERS = {"PreScan": 0, "ImageProbe": 1, "GifProbe": 2, "VideoProbe": 3, "AudioProbe": 4, "OtherProbe": 5, "Detect": 6, "Rebuild": 7, "SignatureScan": 8, "OutputValidation": 9}
STATUSES = {"Success": 0, "Warning": 1, "Blocked": 2}


def output_extension(mime: Column) -> Column:
    """The extension of a released file, null for types that have none."""
    return names.looked_up(mime, names.EXTENSION_OF_MIME)


def write_new(path: str, data: bytes) -> None:
    """A whole file or none, never over an existing one: written aside, synced, then linked into place."""
    folder = os.path.dirname(path) or "."
    handle, passing = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.link(passing, path)  # fails if the path exists
    finally:
        os.unlink(passing)


def write_new_to_store(uri: str, data: bytes) -> None:
    """The same for a store without links: written aside and moved into place if nothing is there."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if store.get_file_info(path).type != fs.FileType.NotFound:
        raise FileExistsError(uri)
    folder = os.path.dirname(path)
    store.create_dir(folder, recursive=True)
    passing = f"{folder}/_passing-{uuid.uuid4().hex}"
    with store.open_output_stream(passing) as f:
        f.write(data)
    store.move(passing, path)


def read_whole(path: str) -> bytes:
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_input_stream(place) as f:
        return f.read()


def write_artifacts(results: DataFrame, folder: str) -> DataFrame:
    """Released bytes as files <object_id>.<extension> of a folder that all executors reach; object_id, path, problem.

    The folder is a mounted path, or a URI (scheme://) of a store that pyarrow.fs opens. A task that is run again finds its
    files in place and reports them if they hold the same bytes.
    """
    write = write_new_to_store if "://" in folder else write_new
    rows = results.filter("released").select(F.col("object_id").cast("string").alias("id"), output_extension(F.col("mime")).alias("ext"), "output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "://" not in folder:
            os.makedirs(folder, exist_ok=True)
        for batch in batches:
            paths, problems = [], []
            for name, ext, data in zip(*(c.to_pylist() for c in batch.columns)):
                path, problem = f"{folder.rstrip('/')}/{name}.{ext}", None
                if ext is None:
                    path, problem = None, "no extension for this type"
                else:
                    try:
                        write(path, data)
                    except FileExistsError:
                        problem = None if read_whole(path) == data else "the file exists"
                paths.append(path)
                problems.append(problem)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(problems, pa.string())], ["object_id", "path", "problem"])

    return rows.mapInArrow(run, "object_id string, path string, problem string")


def json_report(results: DataFrame, profile: str, version: str = "1") -> DataFrame:
    """object_id, report: 14 fields for a decision, 8 for an error, nulls kept."""
    severity = lambda a: F.element_at(F.array(F.lit("Info"), F.lit("Warning"), F.lit("Blocking")), a["severity"] + 1)
    lead = [F.lit("weir").alias("program"), F.lit(version).alias("version"), F.lit(profile).alias("profile"), F.col("object_id").cast("string").alias("input_name")]
    path = F.when(F.col("released"), F.concat(F.col("object_id").cast("string"), F.lit("."), output_extension(F.col("mime")))).alias("output_path")
    decided = F.struct(
        *lead,
        F.initcap("verdict").alias("status"),
        F.col("released"),
        path,
        F.col("mime"),
        F.col("input_bytes"),
        F.col("output_bytes").alias("candidate_bytes"),
        F.col("sha256").alias("candidate_sha256"),
        F.col("duration_ms"),
        F.transform("alerts", lambda a: F.struct(a["code"].alias("code"), a["message"].alias("message"), severity(a).alias("severity"))).alias("alerts"),
        F.col("stages"),
    )
    failed = F.struct(*lead, F.lit("Blocked").alias("status"), F.lit(False).alias("released"), F.col("error_kind").alias("error"), F.lit(None).cast("string").alias("output_path"))
    keep = {"ignoreNullFields": "false"}
    return results.select("object_id", F.when(F.col("error_kind").isNull(), F.to_json(decided, keep)).otherwise(F.to_json(failed, keep)).alias("report"))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n) if n else b""


def _text(field: int, data: bytes, always: bool = False) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data if data or always else b""


def wire_metadata(r: dict[str, Any]) -> bytes:
    """A decision as a protocol-buffer message: verdict 1, kind 2, mime 3, sizes 4 and 5, digest 6, alerts 7, stages 8."""
    alerts = [_text(1, a["code"].encode()) + _text(2, a["message"].encode()) + _number(3, int(a["severity"] == 2)) for a in r["alerts"]]
    stages = [_number(1, STAGE_NUMBERS[s["stage"]]) + _number(2, STATUSES[s["status"]]) + _text(3, s["detail"].encode()) for s in r["stages"]]
    head = _number(1, VERDICTS[r["verdict"]]) + _number(2, KINDS[r["kind"]]) + _text(3, r["mime"].encode()) + _number(4, r["input_bytes"]) + _number(5, r["output_bytes"]) + _text(6, r["sha256"].encode())
    return head + b"".join(_text(7, a, True) for a in alerts) + b"".join(_text(8, s, True) for s in stages)


def wire(results: DataFrame) -> DataFrame:
    """object_id, metadata (bytes) of every decision; errors have no message."""
    rows = results.filter("error_kind IS NULL").select("object_id", "verdict", "kind", "mime", "input_bytes", "output_bytes", "sha256", "alerts", "stages")
    id_type = rows.schema["object_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [wire_metadata(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["object_id", "metadata"])

    return rows.mapInArrow(run, f"object_id {id_type}, metadata binary")


def write_evidence(evidence: DataFrame, folder: str) -> None:
    """The evidence relation as JSON lines and CSV."""
    evidence.write.mode("errorifexists").json(f"{folder}/results")
    flat = evidence.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else c for c, t in evidence.dtypes])
    flat.write.mode("errorifexists").option("header", True).csv(f"{folder}/cases")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), bytes and sha256 of every file there, in ordinal order of the path (by its bytes)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.split("://", 1)[-1].rstrip("/") + "/"
    below = F.substring_index("path", root, -1)
    return files.select(below.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def ordinal_manifest(files: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The digest of each run's manifest (keys; files: path, sha256): lines of digest, two blanks and path, in ordinal order of the path."""
    lines = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    text = F.array_join(F.transform(lines, lambda f: F.concat(f["sha256"], F.lit("  "), f["path"], F.lit("\n"))), "")
    return files.groupBy(*keys).agg(F.count("*").alias("files"), F.sha2(text.cast("binary"), 256).alias("manifest_sha256"))


def write_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The checksums of an evidence folder, written into it as SHA256SUMS (one part file, ordinal order)."""
    sums = checksums(spark, folder)
    sums.select(F.concat("sha256", F.lit("  "), "path")).coalesce(1).write.mode("errorifexists").text(f"{folder}/SHA256SUMS")
    return sums
