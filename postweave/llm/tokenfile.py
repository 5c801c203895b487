"""Token files with fixed-width ids.

Every id takes the least bits that the vocabulary needs. A file is a header, blocks of a fixed
number of ids (so that each block starts on a byte), and a footer with the offset of every block,
the first id of every document and the document ids. A reader finds any stretch of ids from the
footer and unpacks whole blocks with numpy.

    header   magic, bits, ids per block           8 bytes, 2 x uint32
    blocks   packed ids, lowest bit first         the last block may be short
    footer   block offsets                        (blocks + 1) x uint64
             first id of each document            (documents + 1) x uint64
             document ids, null flags             documents x int64, documents x uint8
    trailer  ids, documents, footer offset, magic 3 x uint64, 8 bytes

Files are named in a manifest that Spark writes; a file that a lost or repeated task attempt left
behind is not in it and is never read. Files follow each other in ascending order of the document
id (null first), rows with one id in the order of their text's hash. Null text counts as empty, an
empty table gives an empty manifest, other columns are not read, whatever their names. A very long text is
written block by block.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postweave.llm.tokens import default_tokenizer, encoder
from postweave.session import scratch_path

MAGIC = b"PWTOKEN1"
BLOCK_IDS = 1 << 16
END_ID = 0
_READ_BLOCKS = 16  # unpacked at a time


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):  # the same layout, as native integers
        return ids.astype(f"<u{bits // 8}").tobytes()
    digits = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(digits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count=n).astype("<u4")
    digits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little")
    return (digits.reshape(n, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype="<u4")


def _open(folder: str):
    for own in ("s3a://", "s3n://"):  # Spark's names of the store
        if folder.startswith(own):
            folder = "s3://" + folder.removeprefix(own)
    return fs.FileSystem.from_uri(folder)


class TokenFileWriter:
    """Streams documents into one file; keeps one block and the footer in memory."""

    def __init__(self, sink, bits: int, block_ids: int = BLOCK_IDS):
        if block_ids % 8:
            raise ValueError("ids per block must be a multiple of 8")
        self.sink, self.bits, self.block_ids = sink, bits, block_ids
        self.pending, self.n_pending, self.n_ids = [], 0, 0
        self.starts, self.docs, self.nulls = [0], [], []
        sink.write(MAGIC + np.array([bits, block_ids], "<u4").tobytes())
        self.place, self.blocks = 16, [16]

    def _put(self, ids: np.ndarray) -> None:
        packed = pack_bits(ids, self.bits)
        self.sink.write(packed)
        self.place += len(packed)
        self.blocks.append(self.place)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.n_pending += len(ids)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        if self.n_pending >= self.block_ids:
            ready = np.concatenate(self.pending)
            whole = len(ready) - len(ready) % self.block_ids
            for at in range(0, whole, self.block_ids):
                self._put(ready[at : at + self.block_ids])
            self.pending, self.n_pending = [ready[whole:]], len(ready) - whole

    def close(self) -> None:
        if self.n_pending:
            self._put(np.concatenate(self.pending))
        for values, kind in ((self.blocks, "<u8"), (self.starts, "<u8"), (self.docs, "<i8"), (self.nulls, "u1")):
            self.sink.write(np.array(values, kind).tobytes())
        self.sink.write(np.array([self.n_ids, len(self.docs), self.place], "<u8").tobytes() + MAGIC)
        self.sink.close()


class TokenFileReader:
    """Random access to a token file: ``ids(a, b)`` or ``document(i)``."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 32)
        trailer = source.read(32)
        if trailer[24:] != MAGIC:
            raise ValueError("not a token file")
        self.n_ids, n_docs, footer = (int(x) for x in np.frombuffer(trailer[:24], "<u8"))
        source.seek(0)
        self.bits, self.block_ids = (int(x) for x in np.frombuffer(source.read(16)[8:], "<u4"))
        n_blocks = -(-self.n_ids // self.block_ids)
        source.seek(footer)
        rest = source.read(size - 32 - footer)
        self.blocks = np.frombuffer(rest, "<u8", n_blocks + 1)
        self.starts = np.frombuffer(rest, "<u8", n_docs + 1, 8 * (n_blocks + 1)).astype(np.int64)
        at = 8 * (n_blocks + n_docs + 2)
        self.docs = np.frombuffer(rest, "<i8", n_docs, at)
        self.nulls = np.frombuffer(rest, "u1", n_docs, at + 8 * n_docs).astype(bool)
        self._from, self._ids = 0, np.empty(0, "<u4")

    def _unpacked(self, first: int, last: int) -> np.ndarray:
        self.source.seek(int(self.blocks[first]))
        data = self.source.read(int(self.blocks[last] - self.blocks[first]))
        return unpack_bits(data, self.bits, min(self.n_ids, last * self.block_ids) - first * self.block_ids)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if not 0 <= start <= stop <= self.n_ids:
            raise IndexError("outside the file")
        if start < self._from or stop > self._from + len(self._ids):
            first = start // self.block_ids
            last = max(-(-stop // self.block_ids), min(first + _READ_BLOCKS, len(self.blocks) - 1))
            self._from, self._ids = first * self.block_ids, self._unpacked(first, last)
        return self._ids[start - self._from : stop - self._from]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write_token_files(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    end_id: int = END_ID, block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Write the documents as token files under ``folder``; gives the manifest, one row per file.

    Manifest: part (their order), file, n_docs, n_ids, start (ids in all files before).
    """
    path = tokenizer or default_tokenizer()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode, tail = encoder(path), end_id.to_bytes(4, "little")
        store, place = _open(f"{folder}/files")
        writer = None
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.encode_all(batch.column(1))):
                if writer is None:
                    store.create_dir(place, recursive=True)
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
                    writer = TokenFileWriter(store.open_output_stream(f"{place}/{name}"), width_of(encode.vocabulary), block_ids)
                writer.add(doc_id, np.frombuffer(ids + tail, "<u4"))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "file": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids]}
            )

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # hash of the text second, so that even one id with very many rows is cut into several files
    ordered = rows.withColumn("place", F.xxhash64("text")).repartitionByRange("doc_id", "place")
    ordered = ordered.sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    manifest = ordered.mapInArrow(write, "part long, file string, n_docs long, n_ids long")
    manifest.write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = spark.read.parquet(f"{folder}/manifest")
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Read every document back: doc_id, start (ids of all before it), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        store, place = _open(f"{folder}/files")
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{place}/{row['file']}") as source:
                    reader = TokenFileReader(source)
                    sums = [zlib.crc32(reader.document(i).tobytes()) for i in range(len(reader.docs))]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(reader.docs, pa.int64(), mask=reader.nulls),
                            pa.array(reader.starts[:-1] + row["start"], pa.int64()),
                            pa.array(np.diff(reader.starts), pa.int64()),
                            pa.array(sums, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = read_manifest(spark, folder).select("file", "start").repartition(parts, "file")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write all documents to token files in the shared folder and read them back from there."""
    folder = scratch_path(docs.sparkSession, "tokens")
    folder = "file://" + folder.removeprefix("file:") if folder.startswith("file:/") and not folder.startswith("file://") else folder
    write_token_files(docs, folder, **options)
    return read_documents(docs.sparkSession, folder)
