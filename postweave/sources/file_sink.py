"""A Spark data source that writes files as versions: all files of a job appear together or not at all.

``rows.write.format("file_versions").mode("append").save(root)`` takes ``(name, body)``. Each task writes its files
into the job's own folder and hands a list of their names to the driver, as the file that it has written it to; the
driver's commit publishes one version that names these lists after those of the version before. A job that ends
midway publishes nothing, and what its tasks have written is removed. Readers see one version from end to end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from postweave.sources import versions
from postweave.sources.generated import _is_name, open_store, plain_root

FORMAT = "file_versions"
LISTED_TOGETHER = 10_000


@dataclass
class Written(WriterCommitMessage):
    """The lists of names that one task has written."""

    lists: list[str]


class VersionWriter(DataSourceArrowWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.job = plain_root(root), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        # an attempt has a folder of its own, so that one that is repeated cannot touch files of the one that counts
        attempt = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        folder = f"job-{self.job}/{attempt}"
        store, place = open_store(f"{self.root}/{folder}")
        store.create_dir(place, recursive=True)
        names, lists, number = [], [], 0

        def put_list() -> None:
            target = f"{folder}/names-{len(lists)}.parquet"
            paths = [f"{self.root}/{folder}/{n}" for _, n in names]
            table = pa.table({"name": pa.array([n for n, _ in names], pa.string()), "path": pa.array(paths, pa.string())})
            with store.open_output_stream(f"{place}/names-{len(lists)}.parquet") as out:
                pq.write_table(table, out)
            lists.append(target)
            names.clear()

        for batch in iterator:
            for name, body in zip(batch.column(batch.schema.get_field_index("name")).to_pylist(), batch.column(batch.schema.get_field_index("body")).to_pylist()):
                if not _is_name(name):
                    raise ValueError(f"not a file name: {name!r}")
                kept = f"{number:08d}-{name}"  # one name may come twice
                number += 1
                with store.open_output_stream(f"{place}/{kept}") as out:
                    out.write((body or "").encode())
                names.append((name, kept))
                if len(names) >= LISTED_TOGETHER:
                    put_list()
        if names:
            put_list()
        return Written(lists)

    def commit(self, messages: list[Written | None]) -> None:
        before = None if self.overwrite else versions.latest(self.root)
        lists = [x for m in messages if m is not None for x in m.lists]
        versions.publish(self.root, {"lists": [*(before or {"lists": []})["lists"], lists] if lists else (before or {"lists": []})["lists"]})

    def abort(self, messages: list[Written | None]) -> None:
        store, place = open_store(f"{self.root}/job-{self.job}")
        if store.get_file_info(place).type == fs.FileType.Directory:
            store.delete_dir(place)


class FileVersions(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema, overwrite: bool) -> VersionWriter:
        if not {"name", "body"} <= set(schema.fieldNames()):
            raise ValueError("the rows need the columns name and body")
        return VersionWriter(self.options["path"], overwrite)


def write_version(rows: DataFrame, root: str, mode: str = "append") -> DataFrame:
    """Write ``(name, body)`` as files of a new version; returns its ``(name, path)``. ``overwrite`` drops earlier files."""
    spark = rows.sparkSession
    spark.dataSource.register(FileVersions)
    rows.select("name", "body").write.format(FORMAT).mode(mode).save(plain_root(root))
    return read_version(spark, root)


def read_version(spark: SparkSession, root: str) -> DataFrame:
    """``(name, path)`` of the version in force: of a name that was written again the last file."""
    root = plain_root(root)
    record = versions.latest(root)
    jobs = (record or {"lists": []})["lists"]
    if not jobs:
        return spark.createDataFrame([], "name string, path string")
    parts = None
    for number, lists in enumerate(jobs):
        part = spark.read.schema("name string, path string").parquet(*[f"{root}/{x}" for x in lists]).withColumn("_job", F.lit(number))
        parts = part if parts is None else parts.unionByName(part)
    order = Window.partitionBy("name").orderBy(F.desc("_job"), F.desc("path"))
    return parts.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").select("name", "path")

