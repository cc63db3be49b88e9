"""Compaction of a table's many small runs, behind a manifest that readers follow.

A load writes a folder per day and run. Compaction rewrites the runs of a day as one, in ranges of the
sort key, and then publishes a manifest: for each compacted day the run that stands for it, and the
last load run that it holds. Readers take the newest manifest and list exactly the folders it leaves
alive, so they see the runs of a day or what replaces them, never both and never neither. A manifest
is one file that appears by a rename; folders that nobody needs are removed later.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMPACTED = "c"


def _open(spark: SparkSession, path: str):
    """The file system of a path, and a way to name paths in it."""
    name = spark._jvm.org.apache.hadoop.fs.Path
    return name(path).getFileSystem(spark._jsc.hadoopConfiguration()), name


def _runs(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Run names by day, of all run folders of the table."""
    fs, name = _open(spark, path)
    found: dict[str, list[str]] = {}
    for status in fs.globStatus(name(f"{path}/day=*/batch_id=*")) or ():
        day, run = status.getPath().getParent().getName(), status.getPath().getName()
        found.setdefault(day.split("=", 1)[1], []).append(run.split("=", 1)[1])
    return {day: sorted(runs) for day, runs in sorted(found.items())}


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published manifests, oldest first."""
    fs, name = _open(spark, path)
    return sorted(int(s.getPath().getName()[1:-5]) for s in fs.globStatus(name(f"{path}/_manifest/v*.json")) or ())


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[str, dict[str, str]]:
    """Of compacted days the `run` that stands for them and `upto`, the last load run in it."""
    if version is None:
        version = max(versions(spark, path), default=0)
    if not version:
        return {}
    fs, name = _open(spark, path)
    stream = fs.open(name(_file(path, version)))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _file(path: str, version: int) -> str:
    return f"{path}/_manifest/v{version:012d}.json"


def _alive(runs: Sequence[str], entry: dict[str, str] | None) -> list[str]:
    loads = [r for r in runs if not r.startswith(_COMPACTED)]
    if entry is None:
        return loads
    return [entry["run"], *[r for r in loads if r > entry["upto"]]]


def live_folders(spark: SparkSession, path: str, days: tuple[date, date] | None = None) -> list[str]:
    """The run folders that a reader takes now, of all days or of `days` (first, last)."""
    manifest = _manifest(spark, path)
    first, last = (None, None) if days is None else (f"{days[0]:%Y-%m-%d}", f"{days[1]:%Y-%m-%d}")
    return [
        f"{path}/day={day}/batch_id={run}" for day, runs in _runs(spark, path).items()
        if days is None or first <= day <= last for run in _alive(runs, manifest.get(day))]


def prepare(spark: SparkSession, path: str, sort_by: Sequence[str], least_runs: int = 2) -> dict[str, dict[str, str]]:
    """Rewrite every day that has `least_runs` live runs or more. Nothing changes for readers yet.

    The answer is the manifest that `publish` puts in force. Days are read and written together, in
    ranges of day and sort key, so a large day is split and small days cost no job of their own. A
    preparation that is never published is overwritten by the next one.
    """
    manifest, run = _manifest(spark, path), f"{_COMPACTED}{max(versions(spark, path), default=0) + 1:011d}"
    folders, entries = [], {}
    for day, runs in _runs(spark, path).items():
        alive = _alive(runs, manifest.get(day))
        if len(alive) < least_runs:
            continue
        folders += [f"{path}/day={day}/batch_id={r}" for r in alive]
        loads = [r for r in alive if not r.startswith(_COMPACTED)]
        entries[day] = {"run": run, "upto": max(loads, default=manifest.get(day, {}).get("upto", ""))}
    if not entries:
        return manifest
    rows = spark.read.option("basePath", path).parquet(*folders).drop("batch_id")
    (
        rows.withColumn("batch_id", F.lit(run)).repartitionByRange("day", *sort_by)
        .sortWithinPartitions("day", *sort_by)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(path)
    )
    return manifest | entries


def publish(spark: SparkSession, path: str, manifest: dict[str, dict[str, str]]) -> int:
    """Put a prepared manifest in force, as the next version. Of two at once one fails."""
    version = max(versions(spark, path), default=0) + 1
    if any(entry["run"] > f"{_COMPACTED}{version:011d}" for entry in manifest.values()):
        raise ValueError("the manifest was prepared for a later version")
    fs, name = _open(spark, path)
    draft = name(f"{path}/_manifest/.v{version:012d}.tmp")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    finally:
        stream.close()
    if not fs.rename(draft, name(_file(path, version))):
        raise RuntimeError(f"manifest {version} of {path} is there already")
    return version


def compact(spark: SparkSession, path: str, sort_by: Sequence[str], least_runs: int = 2) -> int | None:
    """Prepare and publish; None where no day had enough runs."""
    manifest = prepare(spark, path, sort_by, least_runs)
    return publish(spark, path, manifest) if manifest != _manifest(spark, path) else None


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove run folders that none of the last `keep` manifests leaves alive, and older manifests.

    Readers that began under an older manifest must have ended. Loads go on meanwhile: a run that no
    manifest covers is always alive.
    """
    numbers = versions(spark, path)
    if not numbers:
        return []
    kept = [_manifest(spark, path, v) for v in numbers[-keep:]] + ([{}] if len(numbers) < keep else [])
    fs, name = _open(spark, path)
    gone = []
    for day, runs in _runs(spark, path).items():
        alive = {run for manifest in kept for run in _alive(runs, manifest.get(day))}
        # What is newer than the last manifest may be prepared just now.
        newest = f"{_COMPACTED}{numbers[-1]:011d}"
        gone += [f"{path}/day={day}/batch_id={r}" for r in runs
                 if r not in alive and not (r.startswith(_COMPACTED) and r > newest)]
    for folder in gone:
        fs.delete(name(folder), True)
    for version in numbers[:-keep]:
        fs.delete(name(_file(path, version)), False)
    return gone


def live_table(spark: SparkSession, path: str, days: tuple[date, date] | None = None) -> DataFrame | None:
    """The rows that are alive under the newest manifest; None for a table that was never compacted."""
    if not any(run.startswith(_COMPACTED) for runs in _runs(spark, path).values() for run in runs):
        return None
    folders = live_folders(spark, path, days)
    if not folders:
        return spark.read.parquet(path).where(F.lit(False))
    return spark.read.option("basePath", path).parquet(*folders)
