"""Postings, documents and pages: read, write, resume."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.functions.text import json_string_sql, lambda_sql
from postweave.operators.documents import FLAT_FIELDS
from postweave.operators.flatten import other_details
from postweave.operators.joins import even_join
from postweave.operators.markup import merge_pairs_sql
from postweave.session import cut_lineage
from postweave.sources import json_lists
from postweave.sources.generated import open_store

_REPLACEMENT = "\ufdd0\ufdd1\ufdd0"  # stands for U+FFFD meanwhile; no characters that texts hold

_TASKS_A_CORE, _JOINED = 8, 64
_TEXTS_TOGETHER = 1 << 20  # characters

_RAW = ", ".join(f"{f} string" for f in FLAT_FIELDS) + ", details string"
_POSTING = (
    ", ".join(f"{f} string" for f in FLAT_FIELDS)
    + ", details array<struct<key:string,value:string>>, status_tags array<string>, error string"
    + ", other_details map<string,string>"
)


def _shape(raw: DataFrame) -> DataFrame:
    """JSON details to ordered pairs of strings; an error marks a failed record.

    Values that are no strings (numbers, lists, ..) are no text: ``other_details`` holds them as
    JSON by key, null where there are none. Status tags have a column of their own.
    """

    def part(wanted: str, value: str) -> str:
        kept = lambda_sql("filter", "_all", lambda p: f"{p}.type {wanted} and {p}.key <> 'status_tags'")
        return lambda_sql("transform", kept, lambda p: f"named_struct('key', {p}.key, 'value', {p}.{value})")

    typed = lambda_sql(
        "transform",
        "map_entries(from_json(details, 'map<string,variant>'))",
        lambda p: f"""named_struct('key', {p}.key, 'type', schema_of_variant({p}.value), 'json', to_json({p}.value),
          'text', try_variant_get({p}.value, '$', 'string'))""",
    )
    shaped = raw.withColumn("_all", F.expr(typed)).withColumns(
        {"_pairs": F.expr(part("= 'STRING'", "text")), "_others": F.expr(part("not in ('STRING', 'VOID')", "json"))}
    )
    others = f"if(size(_others) > 0, map_from_entries({merge_pairs_sql('_others')}), null)"
    return shaped.select(
        *FLAT_FIELDS,
        F.expr(merge_pairs_sql("_pairs")).alias("details"),
        F.expr("from_json(details, 'status_tags array<string>').status_tags").alias("status_tags"),
        F.expr("get_json_object(details, '$.error')").alias("error"),
        F.expr(others).alias("other_details"),
    )


def read_jobs_json(
    spark: SparkSession, path: str, layout: str = "array", range_bytes: int = json_lists.RANGE_BYTES
) -> DataFrame:
    """Postings from JSON.

    ``array``: each file is one JSON list; a file that holds anything else is an error.
    ``ranges``: the same for lists of any size, each read in byte ranges by many tasks.
    ``lines``: one posting per line, which Spark can split and read at any size.
    A missing path is an error in all.
    """
    if layout == "lines":
        return _shape(spark.read.schema(_RAW).json(path))
    if layout == "ranges":
        return _shape(_parsed(json_lists.read_objects(spark, path, range_bytes)))
    if layout != "array":
        raise ValueError(f"no such layout: {layout}")
    message = F.lit("expected the jobs file to hold a JSON list of postings")
    checked = _listed(spark, path).select(F.coalesce("jobs", F.raise_error(message)).alias("jobs"))
    return _shape(checked.select(F.inline("jobs")))


def _parsed(objects: DataFrame) -> DataFrame:
    """JSON objects (``value``) to raw postings; one that is broken is an error."""
    record = F.from_json("value", _RAW + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    found = objects.select(record.alias("job"))
    broken = F.raise_error(F.lit(json_lists.NOT_A_LIST)).cast("string")
    first = FLAT_FIELDS[0]
    checked = F.when(F.col("job._corrupt_record").isNotNull(), broken).otherwise(F.col(f"job.{first}"))
    return found.select(checked.alias(first), *[f"job.{f}" for f in FLAT_FIELDS[1:]], "job.details")


def _lists_in(texts: DataFrame) -> DataFrame:
    """The list of postings in each text (``value``), null where a text holds anything else."""
    fields = _RAW.replace(" string", ":string")
    listed = F.from_json("value", f"array<struct<{fields}>>")
    return texts.withColumn("jobs", F.when(F.ltrim("value").startswith("["), listed))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    return _lists_in(spark.read.text(path, wholetext=True)).select("jobs")


def _details_json() -> Column:
    """Details (their pairs in ``_pairs``), other details and status tags as one JSON object."""
    pairs = F.expr("nullif(substr(_pairs, 2, length(_pairs) - 2), '')")
    members = lambda_sql(
        "transform", "map_entries(_others)", lambda o: f"concat({json_string_sql(f'{o}.key')}, ':', {o}.value)"
    )
    others = F.expr(f"nullif(array_join({members}, ','), '')")
    tags = F.concat(F.lit('"status_tags":'), F.to_json("status_tags"))
    whole = F.concat(F.lit("{"), F.concat_ws(",", pairs, others, tags), F.lit("}"))
    error = F.to_json(F.struct("error"))  # a failed posting keeps its message as its only detail
    return F.when(F.col("details").isNotNull(), whole).when(F.col("error").isNotNull(), error)


def postings_as_json(postings: DataFrame) -> DataFrame:
    """One JSON object per posting in column ``value``."""
    pairs = F.to_json(F.map_from_entries("details"))
    flat = F.to_json(F.struct(*FLAT_FIELDS), {"ignoreNullFields": "false"})
    columns = {"_pairs": pairs, "_flat": flat, "_others": other_details(postings)}
    texts = postings.withColumns(columns).withColumn("_details", _details_json())
    return texts.select(
        F.concat(
            F.expr("substr(_flat, 1, length(_flat) - 1)"),
            F.lit(',"details":'),
            F.coalesce("_details", F.lit("null")),
            F.lit("}"),
        ).alias("value")
    )


def write_snapshot(postings: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the collection at ``path``: any table format, or ``json`` with one posting per line."""
    if fmt == "json":
        postings_as_json(postings).write.mode("overwrite").text(path)
    else:
        postings.write.mode("overwrite").format(fmt).save(path)


def resume_with_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Earlier results to go on from, and what could not be read of them: ``path, line``.

    Files hold one posting per line or one JSON list. A broken line is rejected and the others count; of a list
    file that is broken nothing counts, and its reject has no line. A missing path gives two empty tables. The
    input is read once; only files with a line that is no posting are looked at again, in the tasks.
    """
    rejects = "path string, line string"
    try:
        raw = spark.read.schema(_RAW + ", _corrupt_record string").json(path)
    except AnalysisException:
        return spark.createDataFrame([], _POSTING), spark.createDataFrame([], rejects)
    rows = cut_lineage(raw.select("*", F.col("_metadata.file_path").alias("_path")))
    bad = F.col("_corrupt_record").isNotNull()
    suspects = rows.filter(bad).select(F.col("_path").alias("path")).distinct()
    # a pretty-printed list has a broken line for each of its own, so its whole text decides
    heads = suspects.mapInArrow(_read_lists, "path string, value string")
    lists = cut_lineage(_lists_in(heads.filter("value is not null")).select("path", "jobs"))
    of_list = lists.select(F.col("path").alias("_path"))
    lines = even_join(rows, of_list.withColumn("_listed", F.lit(True)), "_path", "left").filter("_listed is null")
    good = lines.filter(~bad).select(*[c.strip().split(" ")[0] for c in _RAW.split(",")])
    whole = lists.filter("jobs is not null").select(F.inline("jobs"))
    broken_lists = lists.filter("jobs is null").select("path", F.lit(None).cast("string").alias("line"))
    broken_lines = lines.filter(bad).select(F.col("_path").alias("path"), F.col("_corrupt_record").alias("line"))
    return _shape(good.unionByName(whole)), broken_lines.unionByName(broken_lists)


def resume_state(spark: SparkSession, path: str) -> DataFrame:
    """Earlier results to go on from, or none where anything at the path is broken.

    :func:`resume_with_rejects` goes on from what can be read.
    """
    state, rejects = resume_with_rejects(spark, path)
    return state if rejects.isEmpty() else spark.createDataFrame([], state.schema)


def _read_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of those files that begin like a list, null for the others."""
    for batch in batches:
        for place in batch.column(0).to_pylist():
            store, path = open_store(unquote(place))
            with store.open_input_stream(path) as stream:
                head = b""
                while not head and (block := stream.read(1 << 16)):
                    head = block.lstrip(b" \t\r\n")
                text = (head + stream.read()).decode("utf-8", "replace") if head[:1] == b"[" else None
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.string()), pa.array([text], pa.string())], names=["path", "value"])


def read_documents(
    spark: SparkSession, path: str, wanted: DataFrame | None = None, missing_ok: bool = False, pattern: str = "*"
) -> DataFrame:
    """Whole files as ``(path, text)``; bytes that are not UTF-8 are left out.

    ``wanted``: a table ``(path)`` of requested files, read in its own tasks without any listing. A
    requested file that does not exist is an error, or an empty text with ``missing_ok``. Without
    it the folder is listed by the driver, and empty files are passed over.
    """
    if wanted is not None:
        return wanted.select(F.col("path").cast("string").alias("path")).mapInArrow(
            _read_wanted(missing_ok), "path string, text string"
        )
    raw = F.col("content").cast("string")
    kept = F.replace(raw, F.lit("�"), F.lit(_REPLACEMENT))  # a U+FFFD of the file itself stays
    repaired = F.replace(F.make_valid_utf8(kept), F.lit("�"), F.lit(""))
    repaired = F.replace(repaired, F.lit(_REPLACEMENT), F.lit("�"))
    files = _few_tasks(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path))
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(repaired)
    return files.select("path", F.regexp_replace(text, "\r\n?", "\n").alias("text"))  # as text files are read


def _few_tasks(files: DataFrame) -> DataFrame:
    """Many small files a task.

    Spark deals 32 of them to a task, whatever their size, so the tasks grow with the files until they take longer than
    reading does. Some tasks a core are left, and no more than ``_JOINED`` of Spark's in one: files large enough to fill
    a task of their own still make many.
    """
    tasks, cores = files.rdd.getNumPartitions(), files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(_TASKS_A_CORE * cores, -(-tasks // _JOINED))) if tasks > _TASKS_A_CORE * cores else files


def _read_wanted(missing_ok: bool):
    def text_of(place: str | None) -> str:
        if place is not None:
            store, path = open_store(place)
            if store.get_file_info(path).type == fs.FileType.File:
                with store.open_input_stream(path) as stream:
                    found = stream.read().decode("utf-8", "ignore")
                return found.replace("\r\n", "\n").replace("\r", "\n")
        if missing_ok:
            return ""
        raise FileNotFoundError(f"file not found: {place}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for place in batch.column(0).to_pylist():
                rows.append((place, text_of(place)))
                size += len(rows[-1][1])
                if size >= _TEXTS_TOGETHER:  # small texts travel together, a large one alone
                    yield _path_and_text(rows)
                    rows, size = [], 0
            if rows:
                yield _path_and_text(rows)

    return run


def _path_and_text(rows: list[tuple[str | None, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["path", "text"])


def read_pages(spark: SparkSession, path: str, columns: Sequence[str] = ("page_id", "url", "html")) -> DataFrame:
    return spark.read.parquet(path).select(*columns)
