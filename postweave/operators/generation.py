"""Generation that goes on where it stopped: replies are saved by what was asked, failures one by one.

A reply is known by the hash of its prompt, model, temperature and length limit. Tasks save replies as they come, a
file at a time, so a job that ends midway keeps what it has, and the next one asks for the rest only. A batch
that fails is asked again prompt by prompt; a prompt that fails alone is saved with its error and does not fail
the job. A prompt that has failed in as many runs as allowed is set aside (:func:`quarantined`).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.operators.documents import MAX_TOKENS, TEMPERATURE, Generator
from postweave.operators.joins import even_join
from postweave.session import scratch_path
from postweave.sources.generated import open_store

RUNS_ALLOWED = 3
TRIES = 2  # of one prompt in a run
SAVED_TOGETHER = 256
NO_PROMPT = "no prompt"

_REPLY = pa.schema([("prompt_key", pa.string()), ("reply", pa.string()), ("error", pa.string())])
_REPLY_DDL = "prompt_key string, reply string, error string"


def prompt_key(prompt: Column | str, model: str, temperature: float = TEMPERATURE, max_tokens: int = MAX_TOKENS) -> Column:
    """What names a reply; null for no prompt."""
    settings = f"{model}\n{float(temperature)!r}\n{max_tokens}\n"
    return F.sha2(F.concat(F.lit(settings), F.col(prompt) if isinstance(prompt, str) else prompt), 256)


def saved_replies(spark: SparkSession, store: str) -> DataFrame:
    """``prompt_key, reply, error, failures``, one row per prompt that was asked: the reply, if one came, else the last
    error by its text."""
    try:
        rows = spark.read.schema(_REPLY_DDL).parquet(f"{store}/replies")
    except AnalysisException:
        rows = spark.createDataFrame([], _REPLY_DDL)
    return rows.groupBy("prompt_key").agg(
        F.min("reply").alias("reply"),  # of several replies to one prompt always the same one
        F.when(F.count("reply") == 0, F.max("error")).alias("error"), F.count("error").alias("failures"),
    )


def quarantined(spark: SparkSession, store: str, runs_allowed: int = RUNS_ALLOWED) -> DataFrame:
    """Prompts that are not asked again: ``prompt_key, error, failures``."""
    given_up = saved_replies(spark, store).filter(F.col("reply").isNull() & (F.col("failures") >= runs_allowed))
    return given_up.select("prompt_key", "error", "failures")


def _asked(generator: Generator, prompts: list[str], temperature: float, max_tokens: int, tries: int) -> list[tuple[str | None, str | None]]:
    """(reply, error) of each prompt; together first, then, if that fails, alone."""

    def ask(some: list[str]) -> list[str]:
        replies = list(generator(some, temperature, max_tokens))
        if len(replies) != len(some) or any(r is None for r in replies):
            raise ValueError("a reply is missing")
        return replies

    try:
        return [(reply, None) for reply in ask(prompts)]
    except Exception:  # noqa: BLE001  (whatever a model's client raises)
        found = []
        for prompt in prompts:
            error = None
            for _ in range(tries):
                try:
                    found.append((ask([prompt])[0], None))
                    break
                except Exception as problem:  # noqa: BLE001
                    error = f"{type(problem).__name__}: {problem}"
            else:
                found.append((None, error))
        return found


def generate_saved(
    prompts: DataFrame, store: str, generator: Generator, model: str, batch_size: int = 16, temperature: float = TEMPERATURE,
    max_tokens: int = MAX_TOKENS, tries: int = TRIES, runs_allowed: int = RUNS_ALLOWED, saved_together: int = SAVED_TOGETHER,
) -> DataFrame:
    """Add ``reply`` and ``error``; asks only for prompts without a saved reply, each distinct prompt once.

    ``store`` is a shared folder; it may serve several models and settings. Prompts that are null get the error
    ``no prompt``.
    """
    spark = prompts.sparkSession
    keyed = prompts.withColumn("prompt_key", prompt_key("prompt", model, temperature, max_tokens))
    known = saved_replies(spark, store)
    settled = known.filter(F.col("reply").isNotNull() | (F.col("failures") >= runs_allowed)).select("prompt_key")
    open_ = keyed.filter(F.col("prompt").isNotNull()).select("prompt_key", "prompt").join(settled, "prompt_key", "left_anti")
    missing = open_.dropDuplicates(["prompt_key"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                keys, texts = (batch.column(i).slice(at, batch_size).to_pylist() for i in (0, 1))
                rows += [(k, *found) for k, found in zip(keys, _asked(generator, texts, temperature, max_tokens, tries))]
                if len(rows) >= saved_together:
                    yield _save(rows, store)
                    rows = []
        if rows:
            yield _save(rows, store)

    counted = missing.mapInArrow(ask, "asked long, failed long")
    counted.write.parquet(scratch_path(spark, "asked"))  # the files of replies are what counts
    return _answered(keyed, saved_replies(spark, store).select("prompt_key", "reply", "error"))


def _answered(keyed: DataFrame, replies: DataFrame) -> DataFrame:
    found = even_join(keyed, replies, "prompt_key", "left")
    error = F.when(F.col("prompt").isNull(), NO_PROMPT).otherwise(F.col("error"))
    return found.withColumn("error", error).drop("prompt_key")


def _save(rows: list[tuple], store: str) -> pa.RecordBatch:
    """Write replies as a file that appears when it is whole."""
    files, folder = open_store(f"{store}/replies")
    files.create_dir(folder, recursive=True)
    name = f"{uuid.uuid4().hex}.parquet"
    table = pa.table([pa.array(c, pa.string()) for c in zip(*rows)], schema=_REPLY)
    with files.open_output_stream(f"{folder}/_{name}") as out:  # hidden from readers by its name
        pq.write_table(table, out)
    files.move(f"{folder}/_{name}", f"{folder}/{name}")
    return pa.RecordBatch.from_pydict({"asked": [len(rows)], "failed": [sum(r[2] is not None for r in rows)]})
