"""Benchmark contamination by a positional inverted index.

The index is cut by document: a row holds the postings of up to ``shard_words`` words of whole documents,
term by term, each list sorted by position, as one table in the shared folder. A search sends the
test windows (ten words by default) to every shard. There each window starts from the list of its
rarest term, shifted by the term's place in the window, and is intersected with the shifted lists of
its other terms, the next rarest first. With a slop the lists may miss by that many words
(proximity matches). No posting leaves its shard, so a frequent word costs no shuffle.

Words are runs of digits, letters and all characters beyond ASCII, with A-Z lower-cased. Terms are
64-bit hashes. Items of fewer words than a window are one window, items without words match nothing;
repeated items count once, items with a null id are left out. Null texts have no words. Every
document row, repeated or not, gives one row; an empty table gives none.

Items travel to the tasks in blocks of at most ``BLOCK_WORDS`` words, as many blocks as it takes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postweave.llm.rows import field, number_rows
from postweave.llm.words import byte_classes, slices, tokenize
from postweave.session import scratch_path

WINDOW = 10
SHARD_WORDS = 500_000
BLOCK_WORDS = 2_000_000
GAP = 33  # free positions between two documents of a shard; the slop must be smaller
WORD_BYTES = byte_classes(word=bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))

_INDEX = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("n_words", T.ArrayType(T.LongType())),
        T.StructField("terms", T.BinaryType()),  # uint64, ascending
        T.StructField("counts", T.BinaryType()),  # uint32, postings of each term
        T.StructField("positions", T.BinaryType()),  # uint32, ascending within a term
    ]
)


def words_of(texts: list[str | None]) -> list[np.ndarray]:
    """The terms of each text in order."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for doc, tokens in tokenize([(t or "").encode() for t in texts], WORD_BYTES):
        cuts = np.flatnonzero(np.diff(doc)) + 1
        for part, terms in zip(np.split(doc, cuts), np.split(tokens.hashes, cuts)):
            if len(part):
                found[part[0]].append(terms)
    return [np.concatenate(x) if x else np.empty(0, np.uint64) for x in found]


def _shard(ids: list, docs: list[np.ndarray], number: int) -> dict:
    """One row of the index. Documents follow each other with free positions between them."""
    n = np.array([len(x) for x in docs], np.int64)
    words = np.concatenate([*docs, np.empty(0, np.uint64)])
    place = np.arange(len(words)) + GAP * np.repeat(np.arange(len(docs)), n)
    order = np.argsort(words, kind="stable")  # positions stay ascending within a term
    words = words[order]
    begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(words)), bool), words[1:] != words[:-1])))
    terms, counts = words[begins], np.diff(np.append(begins, len(words)))
    return {
        "shard": number, "ids": ids, "n_words": n, "terms": terms.tobytes(),
        "counts": counts.astype("<u4").tobytes(), "positions": place[order].astype("<u4").tobytes(),
    }


def build_index(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS
) -> DataFrame:
    """Write the postings of all documents to ``path`` and read the table back."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([*_INDEX.fields, T.StructField("ids", T.ArrayType(kind))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list = []
        words: list[np.ndarray] = []
        size = 0

        def row() -> pa.RecordBatch:
            made = _shard(ids, words, (part << 33) + number)
            values = [pa.array([made[f]], t) for f, t in (("shard", pa.int64()), ("n_words", pa.list_(pa.int64())), ("terms", pa.binary()), ("counts", pa.binary()), ("positions", pa.binary()))]
            return pa.RecordBatch.from_arrays([*values, pa.array([made["ids"]], pa.list_(id_type))], names=schema.names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            found = (terms for part in slices(batch.column(1)) for terms in words_of(part))
            for doc_id, terms in zip(batch.column(0).to_pylist(), found):
                ids.append(doc_id)
                words.append(terms)
                size += len(terms) + 1
                if size >= shard_words:
                    yield row()
                    ids, words, size, number = [], [], 0, number + 1
        if ids:
            yield row()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(build, schema)
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


class Windows:
    """The distinct windows of some items and the items that hold each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.width = window
        rows, owner = [], []
        for number, terms in enumerate(words_of([text for _, text in items])):
            for at in range(max(len(terms) - window + 1, min(1, len(terms)))):
                rows.append(terms[at : at + window])
                owner.append(number)
        names = sorted({item for item, _ in items})
        numbers = {name: i for i, name in enumerate(names)}
        self.items = names
        owner = [numbers[items[i][0]] for i in owner]
        lengths = np.array([len(r) for r in rows], np.int64)
        self.terms, flat = np.unique(np.concatenate([*rows, np.empty(0, np.uint64)]), return_inverse=True)
        table = np.full((len(rows), window), -1, np.int64)
        table[np.arange(window) < lengths[:, None]] = flat
        self.windows, inverse = np.unique(table, axis=0, return_inverse=True) if len(rows) else (table, np.empty(0, np.int64))
        self.lengths = (self.windows >= 0).sum(axis=1)
        pairs = np.unique(np.stack([inverse.ravel(), np.array(owner, np.int64)]), axis=1) if len(rows) else np.empty((2, 0), np.int64)
        self.owner = pairs[1]
        self.first = np.searchsorted(pairs[0], np.arange(len(self.windows) + 1))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, .. for each run."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def match_shard(row: dict, query: Windows, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, first position) of every match in one shard."""
    terms = np.frombuffer(row["terms"], "<u8")
    counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
    positions = np.frombuffer(row["positions"], "<u4").astype(np.int64)
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(terms) or not len(query.windows):
        return none
    place = np.minimum(np.searchsorted(terms, query.terms), len(terms) - 1)
    known = terms[place] == query.terms
    lists = np.append(np.where(known, place, -1), -2)  # -1: not in this shard; -2 stands for no word
    table = lists[query.windows]
    alive = np.flatnonzero((table != -1).all(axis=1))
    if not len(alive):
        return none
    table = table[alive]
    rarity = np.where(table >= 0, counts[np.maximum(table, 0)], np.iinfo(np.int64).max)
    rarest = np.argsort(rarity, axis=1, kind="stable")
    first = np.concatenate(([0], np.cumsum(counts)))
    keys = (np.repeat(np.arange(len(terms)), counts) << 33) + positions  # ascending
    lead = np.take_along_axis(table, rarest[:, :1], axis=1)[:, 0]
    window = np.repeat(np.arange(len(table)), counts[lead])
    start = positions[_spread(first[lead], counts[lead])] - np.repeat(rarest[:, 0], counts[lead])
    for rank in range(1, query.width):
        offset = rarest[window, rank]
        term = table[window, offset]
        wanted = (term << 33) + start + offset
        at = np.searchsorted(keys, wanted - slop)
        found = keys[np.minimum(at, len(keys) - 1)]
        hit = (term < 0) | ((at < len(keys)) & (found <= wanted + slop) & (found >= wanted - slop))
        window, start = window[hit], start[hit]
        if not len(window):
            return none
    return alive[window], start


def _judge(row: dict, query: Windows, slop: int) -> dict:
    """Per document of a shard: words hit, spans, items."""
    n = np.array(row["n_words"], np.int64)
    bases = np.concatenate(([0], np.cumsum(n + GAP)))
    window, start = match_shard(row, query, slop)
    doc = np.searchsorted(bases, np.maximum(start, 0), side="right") - 1
    low, high = np.maximum(start, bases[doc]), np.minimum(start + query.lengths[window], bases[doc] + n[doc])
    change = np.zeros(bases[-1] + 1, np.int32)
    np.add.at(change, low, 1)
    np.add.at(change, high, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(change) > 0)))
    n_hit = covered[bases[:-1] + n] - covered[bases[:-1]]
    count = np.diff(query.first)[window]
    pairs = np.repeat(doc, count) * max(1, len(query.items)) + query.owner[_spread(query.first[window], count)]
    items: list[list[str]] = [[] for _ in n]
    for pair in np.unique(pairs).tolist():
        items[pair // len(query.items)].append(query.items[pair % len(query.items)])
    spans: list[list[dict]] = [[] for _ in n]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(change) > 0).view(np.int8), [0]))))
    for a, b in edges.reshape(-1, 2).tolist():
        d = int(np.searchsorted(bases, a, side="right") - 1)
        spans[d].append({"start": a - int(bases[d]), "stop": b - int(bases[d])})
    return {"n_hit": n_hit, "items": items, "spans": spans}


_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def _stretches(text: str, window: int, words: int) -> Iterator[str]:
    """A long text as stretches that hold each of its windows once: ``words`` begin in each, the last ones overlap."""
    found = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(_LOWER))]
    for first in range(0, max(1, len(found) - window + 1), words):
        part = found[first : first + words + window - 1]
        if part:
            yield text[part[0][0] : part[-1][1]]


def _blocks(items: DataFrame, id_col: str, text_col: str, block_words: int, window: int) -> Iterator[list[tuple[str, str]]]:
    """Items, a block of bounded size at a time (characters, a word being two at least with its gap).

    An item that would be too large for a block is dealt with in stretches.
    """
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.where(F.col("item").isNotNull()).distinct()
    block, size = [], 0
    for row in rows.orderBy("item", "text").toLocalIterator():
        long = len(row["text"]) > 2 * block_words
        for text in _stretches(row["text"], window, max(1, block_words // 8)) if long else [row["text"]]:
            if block and size + len(text) > 2 * block_words:
                yield block
                block, size = [], 0
            block.append((row["item"], text))
            size += len(text)
    yield block


def search(
    index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slop: int = 0,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, spans (start, stop in words, merged) and items (sorted strings)."""
    kind = index.schema["ids"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("shard", T.LongType()), T.StructField("place", T.LongType()), T.StructField("id", kind),
            T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )
    if not 0 <= slop < GAP:
        raise ValueError(f"the slop must be below {GAP}")
    context = index.sparkSession.sparkContext
    parts: list[DataFrame] = []
    for block in _blocks(items, id_col, text_col, block_words, window):
        query = context.broadcast(Windows(block, window))

        def judge(batches: Iterator[pa.RecordBatch], query=query) -> Iterable[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    values = {name: batch.column(name)[i] for name in batch.schema.names}
                    row = {k: v.as_py() for k, v in values.items() if k != "ids"}
                    made = _judge(row, query.value, slop)
                    n = len(row["n_words"])
                    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["shard"]] * n, pa.int64()), pa.array(range(n), pa.int64()), values["ids"].values,
                            pa.array(row["n_words"], pa.int64()), pa.array(made["n_hit"], pa.int64()),
                            pa.array(made["spans"], span), pa.array([sorted(x) for x in made["items"]], pa.list_(pa.string())),
                        ],
                        names=schema.names,
                    )

        parts.append(index.mapInArrow(judge, schema))
    return parts[0] if len(parts) == 1 else _merged(reduce(DataFrame.unionByName, parts))


def _merged(rows: DataFrame) -> DataFrame:
    """Put the findings of all blocks of items together, document by document."""
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    together = rows.groupBy("shard", "place").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"), spans.alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    merged = F.expr(
        """aggregate(spans, cast(array() as array<struct<start: bigint, stop: bigint>>), (done, s) ->
        if(size(done) > 0 and element_at(done, -1).stop >= s.start,
           concat(slice(done, 1, size(done) - 1),
                  array(named_struct('start', element_at(done, -1).start, 'stop', greatest(element_at(done, -1).stop, s.stop)))),
           concat(done, array(s))))"""
    )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return together.withColumn("spans", merged).withColumn("n_hit", n_hit).select(*rows.columns)


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, slop: int = 0,
) -> DataFrame:
    """Index all documents in the shared folder and search the items there."""
    index = build_index(docs, scratch_path(docs.sparkSession, "postings"), id_col, text_col)
    return search(index, items, item_col, item_text_col, window, slop)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Rows without a hit, columns as they are. Rows are judged by their number, whatever their ids are."""
    numbered = number_rows(docs)
    hit = contamination(numbered.select("_row", field(text_col).alias("text")), items, "_row", "text", **options).where("n_hit > 0")
    return numbered.join(hit.select(F.col("id").alias("_row")), "_row", "left_anti").select("_doc.*")
