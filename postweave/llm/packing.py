"""Packing by power-of-two decomposition.

Every document's ids are cut into pieces whose lengths are powers of two: as many of the longest
length as fit, then the binary digits of the rest. Each piece is a sequence of its own, so no
sequence crosses documents and none is padded; equal lengths form a bucket, and a batch is
drawn from one bucket.

Null text counts as empty: such a document still has its end id. Repeated rows are packed as often
as they occur. An empty table gives no rows. Columns other than the two named ones are not read, whatever their
names. A very long text is cut where its ids are made; its pieces are never copied together again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from postweave.llm.tokens import default_tokenizer, encoder
from postweave.operators.ordering import dense_ids
from postweave.session import scratch_path

MAX_LENGTH = 2048
END_ID = 1
PIECE_COLUMNS = ["doc_id", "start", "length", "doc_tokens", "ids"]
_HANDED_ON = 1 << 22


def piece_spans(n_tokens: Column, max_length: int = MAX_LENGTH) -> Column:
    """Array of (start, length): the longest pieces first, then the binary digits of the rest."""
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("the longest length must be a power of two")
    bits = max_length.bit_length() - 1
    whole = F.floor(n_tokens / max_length)
    rest = n_tokens % max_length
    # a digit's start: everything above it, that is n with this digit and all lower ones cleared
    digits = [
        F.when(
            F.floor(rest / (1 << b)) % 2 == 1,
            F.struct((F.floor(n_tokens / (2 << b)) * (2 << b)).cast("long").alias("start"), F.lit(1 << b).cast("long").alias("length")),
        )
        for b in reversed(range(bits))
    ]
    longest = F.transform(
        F.when(whole > 0, F.sequence(F.lit(0).cast("long"), whole - 1)).otherwise(F.array().cast("array<bigint>")),
        lambda i: F.struct((i * max_length).alias("start"), F.lit(max_length).cast("long").alias("length")),
    )
    return F.concat(longest, F.array_compact(F.array(*digits))) if digits else longest


def piece_lengths(n_tokens: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces as in :func:`piece_spans`: the longest ones first, then the binary digits of the rest."""
    whole, rest = divmod(n_tokens, max_length)
    return [max_length] * whole + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def _piece_rows(batches: Iterator[pa.RecordBatch], path: str, end_id: int, max_length: int) -> Iterator[pa.RecordBatch]:
    """(id, text) -> a row per piece; handed on whenever the ids of some texts fill ``_HANDED_ON`` bytes."""
    encode, tail = encoder(path).encode_all, end_id.to_bytes(4, "little")

    def rows(ids: pa.Array, encoded: list[bytes]) -> pa.RecordBatch:
        sizes = [len(x) // 4 for x in encoded]
        lengths = [piece_lengths(n, max_length) for n in sizes]
        count = np.array([len(x) for x in lengths])
        length = np.fromiter(chain.from_iterable(lengths), np.int64, int(count.sum()))
        ends, before = np.cumsum(length), np.repeat(np.cumsum(sizes) - sizes, count)
        offsets = np.concatenate(([0], 4 * ends)).astype(np.int32 if ends[-1] < 1 << 29 else np.int64)
        kind = pa.binary() if offsets.dtype == np.int32 else pa.large_binary()
        bodies = pa.Array.from_buffers(kind, len(length), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(encoded))])
        columns = [ids.take(pa.array(np.repeat(np.arange(len(encoded)), count))), ends - length - before, length, np.repeat(sizes, count), bodies]
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=PIECE_COLUMNS)

    for batch in batches:
        first, encoded, size = 0, [], 0
        for at, found in enumerate(encode(batch.column(1))):
            encoded.append(found + tail)
            size += len(encoded[-1])
            if size >= _HANDED_ON:
                yield rows(batch.column(0).slice(first, len(encoded)), encoded)
                first, encoded, size = at + 1, [], 0
        if encoded:
            yield rows(batch.column(0).slice(first, len(encoded)), encoded)


def write_pieces(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    tokenizer: str | None = None, end_id: int = END_ID, max_length: int = MAX_LENGTH,
) -> DataFrame:
    """Tokenize once, cut, and write one row per piece with its ids; the table is read back.

    Columns: doc_id, start, length, doc_tokens, ids (little-endian 32-bit binary).

    The pieces come from a map over Arrow batches: of a function of the text the optimizer makes a filter as well
    (no row for an empty array), and every text is tokenized a second time for that.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("the longest length must be a power of two")
    tokenizer = tokenizer or default_tokenizer()
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = StructType([read.schema["doc_id"], *(StructField(c, LongType()) for c in PIECE_COLUMNS[1:4]), StructField("ids", BinaryType())])
    rows = read.mapInArrow(lambda batches: _piece_rows(batches, tokenizer, end_id, max_length), schema)
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def number_sequences(pieces: DataFrame) -> DataFrame:
    """Number the sequences gapless from 0, bucket by bucket (ascending length), then by document."""
    numbered = dense_ids(pieces, "length", "doc_id", "start", name="sequence_id")
    return numbered.withColumn("offset", F.lit(0).cast("long"))


def pack(docs: DataFrame, **options) -> DataFrame:
    """Pieces with their ids, in a table in the shared folder; see :func:`write_pieces`."""
    return write_pieces(docs, scratch_path(docs.sparkSession, "pieces"), **options)


def packed_digest(docs: DataFrame, **options) -> DataFrame:
    """One row per piece with a checksum in place of the ids."""
    pieces = pack(docs, **options)
    digest = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return number_sequences(digest)
