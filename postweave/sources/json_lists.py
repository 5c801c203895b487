"""A JSON list of objects, however large its file, read in byte ranges.

Where a range begins, it depends on all bytes before whether one stands in a string and how deep. So a first pass
sums each range up: for each state in which it may begin (outside a string, inside one, inside one after a backslash)
the state in which it ends, and how much deeper. A prefix over these few summaries gives every range its true state. In
the second pass each task hands on the objects that begin in its ranges; it reads on behind a range to the end
of the last one. Both passes are Spark jobs over the table of ranges, neighbours in one task; the number of tasks follows
the bytes, not the ranges. The driver holds some numbers per range.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.sources.generated import open_store

RANGE_BYTES = 32 << 20  # also what one task reads
LEAST_TASKS = 64  # as many ranges may be read at once, however small they are
_BLOCK = 1 << 20
_AHEAD = 1 << 16  # read at a time behind a range
_TOGETHER = 8 << 20  # bytes of objects handed on at once
_QUOTE, _BACKSLASH, _COMMA = b'"\\,'
_SPACE = np.isin(np.arange(256), list(b" \t\r\n"))
_DEEPER = np.zeros(256, np.int8)
_DEEPER[list(b"[{")], _DEEPER[list(b"]}")] = 1, -1
NOT_A_LIST = "expected the jobs file to hold a JSON list of postings"


class State(NamedTuple):
    """Where a reader stands: inside a string, after a backslash there, and in how many brackets."""

    inside: bool = False
    escaped: bool = False
    depth: int = 0


STARTS = (State(), State(True), State(True, True))


def _quotes(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """Which bytes are quotes that are not escaped, and whether the byte behind the block is escaped."""
    slashes = np.flatnonzero(data == _BACKSLASH)
    begins = slashes[np.diff(slashes, prepend=-2) > 1]
    behind = slashes[np.diff(slashes, append=len(data) + 1) > 1] + 1  # the byte after each run of them
    lengths = behind - begins
    if escaped and len(begins) and begins[0] == 0:  # one that ran into the block counts along
        lengths[0] += 1
    elif escaped:
        behind, lengths = np.concatenate(([0], behind)), np.concatenate(([1], lengths))
    behind = behind[lengths % 2 == 1]
    quotes = data == _QUOTE
    quotes[behind[behind < len(data)]] = False
    return quotes, bool(len(behind)) and int(behind[-1]) == len(data)


def scan(block: bytes, state: State) -> tuple[np.ndarray, np.ndarray, State]:
    """For every byte: whether it is outside strings, and the depth after it; and the state at the end."""
    data = np.frombuffer(block, np.uint8)
    quotes, escaped = _quotes(data, state.escaped)
    after = (np.cumsum(quotes, dtype=np.uint8) + np.uint8(state.inside)) % 2 == 1  # only odd or even matters
    outside = ~(after | quotes)
    depth = state.depth + np.cumsum(np.where(outside, _DEEPER[data], 0), dtype=np.int64)
    inside = bool(after[-1])
    return outside, depth, State(inside, escaped and inside, int(depth[-1]))


def _ends(block: bytes, states: list[State]) -> list[State]:
    """The states that :func:`scan` ends in. Where strings begin and end is worked out once: what is inside a string for one
    state is outside for another."""
    data = np.frombuffer(block, np.uint8)
    marks = data[0] in (_QUOTE, _BACKSLASH)  # any other first byte is the same escaped or not
    found = {}
    for first in {s.escaped and marks for s in states}:
        quotes, escaped = _quotes(data, first)
        odd = np.cumsum(quotes, dtype=np.uint8) % 2 == 1
        brackets = np.flatnonzero(_DEEPER[data])
        deeper = _DEEPER[data[brackets]].astype(np.int64)
        found[first] = bool(odd[-1]), escaped, [int(deeper[odd[brackets] == flip].sum()) for flip in (False, True)]
    out = []
    for s in states:
        odd_end, escaped, depths = found[s.escaped and marks]
        inside = odd_end != s.inside
        out.append(State(inside, escaped and inside, s.depth + depths[s.inside]))
    return out


def _blocks(source, start: int, stop: int) -> Iterator[bytes]:
    source.seek(start)
    while start < stop:
        block = source.read(min(_BLOCK, stop - start))
        if not block:
            return
        start += len(block)
        yield block


def summary(source, start: int, stop: int) -> list[State]:
    """The state at the end of a range for each of ``STARTS``, depths counted from its beginning."""
    states = list(STARTS)
    for block in _blocks(source, start, stop):
        states = _ends(block, states)
    return states


def objects(source, start: int, stop: int, size: int, state: State, first: int) -> Iterator[bytes]:
    """The list's objects that begin in a range; anything else between them is an error. The list begins at ``first``."""
    parts: list[bytes] = []  # of an object that has begun
    at = start
    own = state.depth <= 1  # false while in an object that began before the range
    if state.inside and own:
        raise ValueError(NOT_A_LIST)
    source.seek(at)
    while at < size and (at < stop or parts):
        block = source.read(min(_BLOCK, stop - at) if at < stop else min(_AHEAD, size - at))
        outside, depth, after = scan(block, state)
        data = np.frombuffer(block, np.uint8)
        before = np.concatenate(([state.depth], depth[:-1]))
        begins = np.flatnonzero(outside & (data == ord("{")) & (before == 1))
        ends = np.flatnonzero(outside & (data == ord("}")) & (depth == 1)) + 1
        listed = (data == ord("[")) & (before == 0) | (data == ord("]")) & (depth == 0)
        between = (np.minimum(before, depth) <= 1) & ~_SPACE[data] & (data != _COMMA) & ~(outside & listed)
        between[begins] = between[ends - 1] = False
        wrong = np.flatnonzero(between)
        opens = np.flatnonzero(outside & (data == ord("[")) & (before == 0))
        if (len(wrong) and at + wrong[0] < stop) or any(at + i != first for i in opens.tolist()):
            raise ValueError(NOT_A_LIST)
        if parts or not own:
            if not len(ends):
                if parts:
                    parts.append(block)
                at, state = at + len(block), after
                continue
            if parts:
                yield b"".join(parts) + block[: ends[0]]
            parts, own = [], True
            begins = begins[begins >= ends[0]]
            ends = ends[1:]
        begins = begins[at + begins < stop]
        for begin, end in zip(begins.tolist(), ends.tolist()):
            yield block[begin:end]
        if len(begins) > len(ends):
            parts = [block[begins[-1] :]]
        at, state = at + len(block), after
    if parts:
        raise ValueError(NOT_A_LIST)


def _files(path: str) -> list[tuple[str, int]]:
    """Files at a path, or in a folder, with their sizes."""
    store, place = open_store(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = store.get_file_info(fs.FileSelector(place))
    names = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted((f"{path.rstrip('/')}/{f.base_name}", f.size) for f in names)


def read_objects(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The objects of the JSON lists at ``path`` (a file or a folder of files) as JSON texts in column ``value``.

    A missing path is an error, and so is a file that holds anything but one list of objects.
    """
    files = _files(path)
    sizes = np.array([size for _, size in files], np.int64)
    if not sizes.all():
        raise ValueError(NOT_A_LIST)  # an empty file
    counts = -(-sizes // range_bytes)
    file = np.repeat(np.arange(len(files)), counts)
    start = (np.arange(len(file)) - np.repeat(np.cumsum(counts) - counts, counts)) * range_bytes
    stop, size = np.minimum(start + range_bytes, sizes[file]), sizes[file]
    tasks = max(1, min(len(file), max(LEAST_TASKS, int(sizes.sum()) // RANGE_BYTES)))
    task = np.arange(len(file)) * tasks // max(1, len(file))  # neighbours together
    names = pa.array([name for name, _ in files], pa.string()).take(pa.array(file))
    plain = {"task": pa.array(task, pa.int32()), "file": pa.array(file, pa.int32()), "name": names}
    plain |= {n: pa.array(v, pa.int64()) for n, v in (("start", start), ("stop", stop), ("size", size))}

    def deal(columns: dict[str, pa.Array]) -> DataFrame:
        rows = spark.createDataFrame(pa.table(columns))
        return rows.repartitionById(tasks, F.col("task")).sortWithinPartitions("file", "start")

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, source in _opened(batches):
            states = summary(source, row["start"], row["stop"])
            first = first_byte(source, row["size"]) if row["start"] == 0 else None
            ends = [{"inside": s.inside, "escaped": s.escaped, "depth": s.depth} for s in states]
            yield pa.RecordBatch.from_pylist([{"file": row["file"], "start": row["start"], "first": first, "ends": ends}], schema=_SUMMARY)

    summed = deal(plain).mapInArrow(sum_up, "file int, start long, first long, ends array<struct<inside: boolean, escaped: boolean, depth: long>>")
    known, state, now, first = [], State(), -1, 0
    for row in sorted(summed.toArrow().to_pylist(), key=lambda r: (r["file"], r["start"])):  # some numbers a range
        if row["file"] != now:
            if state != State():
                raise ValueError(NOT_A_LIST)
            now, state, first = row["file"], State(), row["first"]
        known.append((state.inside, state.escaped, state.depth, first))
        end = row["ends"][STARTS.index(State(state.inside, state.escaped))]
        state = State(end["inside"], end["escaped"], state.depth + end["depth"])
    if state != State():
        raise ValueError(NOT_A_LIST)
    kinds = {"inside": pa.bool_(), "escaped": pa.bool_(), "depth": pa.int64(), "first": pa.int64()}
    begun = plain | {n: pa.array([k[i] for k in known], kind) for i, (n, kind) in enumerate(kinds.items())}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[str] = []
        held = 0
        for row, source in _opened(batches):
            state = State(row["inside"], row["escaped"], row["depth"])
            for found in objects(source, row["start"], row["stop"], row["size"], state, row["first"]):
                some.append(found.decode())
                held += len(found)
                if len(some) == 256 or held > _TOGETHER:
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["value"])
                    some, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["value"])

    return deal(begun).mapInArrow(read, "value string")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.NativeFile]]:
    """The ranges, each with its file; neighbours in one file share it."""
    name, source = None, None
    try:
        for batch in batches:
            for row in batch.to_pylist():
                if row["name"] != name:
                    if source is not None:
                        source.close()
                    store, place = open_store(row["name"])
                    name, source = row["name"], store.open_input_file(place)
                yield row, source
    finally:
        if source is not None:
            source.close()


def first_byte(source, size: int) -> int:
    """Where the first byte stands that is not white space; it has to begin the list."""
    at = 0
    for block in _blocks(source, 0, size):
        rest = block.lstrip(b" \t\r\n")
        if rest[:1] == b"[":
            return at + len(block) - len(rest)
        if rest:
            break
        at += len(block)
    raise ValueError(NOT_A_LIST)


_SUMMARY = pa.schema(
    [
        ("file", pa.int32()), ("start", pa.int64()), ("first", pa.int64()),
        ("ends", pa.list_(pa.struct([("inside", pa.bool_()), ("escaped", pa.bool_()), ("depth", pa.int64())]))),
    ]
)
