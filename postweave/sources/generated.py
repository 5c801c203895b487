"""Generated files: one per (posting, kind), a table of those written, and which of them exist."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.operators.documents import KINDS
from postweave.operators.joins import thinned_keys

MANIFEST = "_written"  # a hidden folder, so a listing of the files passes over it


def plain_root(root: str) -> str:
    return re.sub(r"^file:/+", "/", root).rstrip("/")


def open_store(place: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it, for tasks."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", plain_root(place)))


def _is_name(name: str | None) -> bool:
    return bool(name) and "/" not in name and name not in (".", "..")


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Write ``(name, body)`` as files under ``root`` from the tasks.

    Returns ``(name, path)`` of all files written there so far. A name that is none, or that leads out
    of ``root``, is an error.

    A file appears under its name only when it is whole, and a task that runs again writes the
    same files, so a lost executor leaves nothing half done. ``root`` must be shared storage.
    """
    root = plain_root(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(root)
        store.create_dir(folder, recursive=True)
        for batch in batches:
            paths = []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):  # one body at a time
                if not _is_name(name):
                    raise ValueError(f"not a file name: {name!r}")
                target = f"{folder}/{name}"
                part = f"{target}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write((body.as_py() or "").encode())
                store.move(part, target)
                paths.append(f"{root}/{name}")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(paths, pa.string())], names=["name", "path"]
            )

    written = rows.select("name", "body").mapInArrow(run, "name string, path string")
    written.write.mode("append").parquet(f"{root}/{MANIFEST}")
    return rows.sparkSession.read.parquet(f"{root}/{MANIFEST}").dropDuplicates(["name"])


def write_generated(docs: DataFrame, root: str, extension: str = ".tex") -> DataFrame:
    """Write ``(job_id, kind, body)`` to ``root/<job_id>_<kind>.tex``; returns ``(job_id, kind, path)``."""
    named = docs.select(F.concat("job_id", F.lit("_"), "kind", F.lit(extension)).alias("name"), "body")
    return _job_and_kind(write_files(named, root))


def list_generated(spark: SparkSession, root: str, extension: str = ".tex") -> DataFrame:
    """``(job_id, kind, path)`` of the files under ``root``; contents are not read.

    Files of other names are passed over. Spark lists files through the driver and passes over empty
    ones; for very many files use ``present_generated`` or the table that ``write_generated`` returns.
    """
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").load(root)
    except AnalysisException:
        return spark.createDataFrame([], "job_id string, kind string, path string")
    name = F.url_decode(F.regexp_extract("path", "([^/]+)$", 1))
    return _job_and_kind(files.select(name.alias("name"), "path")).filter("kind <> ''")


def present_generated(postings: DataFrame, root: str, extension: str = ".tex") -> DataFrame:
    """``(job_id, kind, path)`` of the files that exist for the postings ``(job_id)``.

    Each task asks for the two expected paths of its ids, so nothing is listed; empty files count. An
    id that is no part of a file name has none.
    """
    root = plain_root(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(root)
        for batch in batches:
            asked = [
                (job, kind, f"{job}_{kind}{extension}")
                for job in batch.column(0).to_pylist()
                for kind in KINDS
                if job is not None and _is_name(f"{job}_{kind}")
            ]
            found = store.get_file_info([f"{folder}/{name}" for _, _, name in asked]) if asked else []
            there = [a for a, info in zip(asked, found) if info.type == fs.FileType.File]
            columns = [[a[0] for a in there], [a[1] for a in there], [f"{root}/{a[2]}" for a in there]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string()) for c in columns], names=["job_id", "kind", "path"]
            )

    ids = thinned_keys(postings, "job_id").distinct()
    return ids.mapInArrow(run, "job_id string, kind string, path string")


def _job_and_kind(files: DataFrame) -> DataFrame:
    pattern = r"^(.*?)_(resume|cover_letter)\.[^.]*$"
    part = lambda group: F.regexp_extract("name", pattern, group)
    return files.select(part(1).alias("job_id"), part(2).alias("kind"), "path")
