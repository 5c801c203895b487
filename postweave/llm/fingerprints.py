"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every hash of a text's shingles (stretches of 16 code points, A-Z lower-cased) that
lies below a fixed fraction of the hash range. So sketches of texts of any size can be compared and
merged: below the bound of both, each holds all of its text's hashes. A text with few such hashes
keeps its ``FLOOR`` smallest ones instead, which moves its bound up; short texts are sketched whole.

A text shorter than a shingle is one shingle. Null counts as empty; the empty text has the empty
fingerprint, like only to another empty one. Equal texts have equal fingerprints. Repeated rows are
kept. An empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.llm.words import mix

SHINGLE = 16  # code points, a power of two
FRACTION = 32  # one hash in so many is kept
FLOOR = 32
_LIMIT = (1 << 64) // FRACTION
_STEP = 1 << 20  # code points hashed at once
_FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]


def _hashes(points: np.ndarray) -> np.ndarray:
    """Hash of each stretch of SHINGLE code points, put together from halves."""
    hashes, width = mix(points.astype(np.uint64) + np.uint64(1)), 1
    for factor in _FACTORS[: SHINGLE.bit_length() - 1]:
        hashes = hashes[:-width] * np.uint64(factor) + hashes[width:]
        width *= 2
    return mix(hashes)


def sketch(text: str | None) -> np.ndarray:
    """The retained hashes, ascending."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.empty(0, np.uint64)
    upper = (points >= 65) & (points <= 90)
    points = points + np.uint32(32) * upper
    if len(points) < SHINGLE:
        padded = np.concatenate((points, np.full(SHINGLE - len(points), 0x110000 + len(points), np.uint32)))
        return _hashes(padded)
    steps = range(0, len(points) - SHINGLE + 1, _STEP)
    kept = [h[h < _LIMIT] for h in (_hashes(points[a : a + _STEP + SHINGLE - 1]) for a in steps)]
    below = np.unique(np.concatenate(kept))
    if len(below) >= FLOOR:
        return below
    least = np.empty(0, np.uint64)
    for a in steps:
        least = np.unique(np.concatenate((least, _hashes(points[a : a + _STEP + SHINGLE - 1]))))[:FLOOR]
    return least


def bound(hashes: np.ndarray) -> int:
    """Below this value the sketch holds every hash of its text."""
    if len(hashes) < FLOOR:
        return 1 << 64
    return max(_LIMIT, int(hashes[-1]) + 1) if len(hashes) == FLOOR else _LIMIT


def _below(hashes: np.ndarray, top: int) -> np.ndarray:
    return hashes if top >= 1 << 64 else hashes[hashes < np.uint64(top)]


def _shared(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    top = min(bound(a), bound(b))
    a, b = _below(a, top), _below(b, top)
    return len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common shingles among all of both (1 for two empty texts)."""
    common, m, n = _shared(a, b)
    return common / (m + n - common) if m + n else float(len(a) == len(b))


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; fit for texts of very unequal size."""
    common, m, _ = _shared(a, b)
    return common / m if m else float(not len(a))


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both texts' shingles together, from the sketches alone."""
    both = _below(np.unique(np.concatenate((a, b))), min(bound(a), bound(b)))
    below = _below(both, _LIMIT)
    return below if len(below) >= FLOOR else both[:FLOOR]


def to_text(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype("<u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def sketch_udf():
    """text -> fingerprint string."""

    @F.arrow_udf("string")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array([to_text(sketch(text)) for text in texts.to_pylist()], pa.string())

    return fingerprint


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stretches of the order by id, each followed by a copy of the row that comes next.

    Cuts come from the ids alone. The first row of a stretch also goes to the stretch before (the
    very first to the last), so every row meets its successor after one shuffle of the texts.
    Columns: stretch, copy, doc_id, text; sorted. Null ids come first, equal ids by text.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(least))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(i / n) for i in range(n)])
    found = rows.agg(F.min(key).alias("least"), F.percentile_approx(key, shares, 10 * n).alias("cuts")).first()
    cuts = np.unique(np.array([found["least"], *(found["cuts"] or [])] if found["least"] is not None else [0], np.int64))

    @F.arrow_udf("struct<stretch: long, first: boolean>")
    def stretch_of(keys: pa.Array) -> pa.Array:
        values = keys.to_numpy(zero_copy_only=False)
        at = np.maximum(np.searchsorted(cuts, values, side="right") - 1, 0)
        return pa.StructArray.from_arrays([pa.array(at, pa.int64()), pa.array(cuts[at] == values)], ["stretch", "first"])

    placed = rows.withColumn("at", stretch_of(key))
    own = F.struct(F.col("at.stretch").alias("stretch"), F.lit(False).alias("copy"))
    before = F.struct(F.pmod(F.col("at.stretch") - 1, F.lit(len(cuts))).cast("long").alias("stretch"), F.lit(True).alias("copy"))
    both = F.explode(F.when(F.col("at.first"), F.array(own, before)).otherwise(F.array(own)))
    dealt = placed.select(both.alias("to"), "doc_id", "text").select("to.stretch", "to.copy", "doc_id", "text")
    return dealt.repartition("stretch").sortWithinPartitions("stretch", "copy", "doc_id", "text")


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; one row per document."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def made(row: tuple, following: tuple) -> tuple:
        doc_id, text, own = row
        edited = edited_text(text, following[1])
        other = sketch(edited)
        digest = sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), digest, to_text(own), to_text(other), likeness(own, other), likeness(own, following[2])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        stretch, last = None, None
        for batch in batches:
            rows = []
            for at, copy, doc_id, text in zip(*[c.to_pylist() for c in batch.columns]):
                if at != stretch:
                    stretch, last = at, None
                elif last is None:
                    continue  # further copies at the end of a stretch
                row = (doc_id, text, sketch(text))
                if last is not None:
                    rows.append(made(last, row))
                last = None if copy else row
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return neighbours(docs, id_col, text_col).mapInArrow(judge, schema)
