"""Periodic runs of words, found by a suffix automaton with link-cut access.

A run is a longest stretch of words with smallest period q that is long enough against q. The words
of a text are appended to a suffix automaton one by one. Its suffix links form a tree, and a link-cut
structure keeps the tree cut into paths, each with the place where its words last ended. Appending a word
accesses the new prefix: the walk to the root meets one path segment after another, each with its last
place, and then recolours them all. A segment whose longest member has length L and that ended d words
ago says that the last L + d words repeat with distance d. Where L is at least d a square ends here; where
it is ``exponent - 1`` times d, a power as long as asked for. Its stretch is widened to both sides while the
distance holds, which gives the run, once per run. A segment that does not hold the length d itself has
been met with a shorter distance, so d is the smallest period.

Before that, a text is cut at words that occur less than ``exponent`` times in the stretch between two
such cuts, again and again: every word of a run occurs that often inside the run, so no run holds such a word.
What is left is searched as a whole, however long it is.

A text is the work of one task, and one stretch of it is held in memory, with some 150 bytes a word. Null and
empty texts have no words and no runs. Repeated rows are judged one by one. An empty table gives no rows. Only
the two named columns are read, whatever the others are called.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.llm.words import slices

EXPONENT = 4  # a run is at least so many periods long
LEAST_WORDS = 6


class SuffixAutomaton:
    """A suffix automaton of symbols whose suffix links are kept as preferred paths in splay trees.

    State 0 stands for none, 1 is the root. A state has one transition in two arrays and further
    ones in a dictionary, as most have only one. ``up``, ``left`` and ``right`` are the splay trees, ordered by
    depth; the top of a splay tree has the path's parent as ``up`` and the path's colour in ``last``.
    """

    def __init__(self) -> None:
        self.length, self.link = array("q", [0, 0]), array("q", [0, 0])
        self.symbol, self.target = array("q", [-1, -1]), array("q", [0, 0])
        self.more: dict[int, dict[int, int]] = {}
        self.up, self.left, self.right = array("q", [0, 0]), array("q", [0, 0]), array("q", [0, 0])
        self.last = array("q", [-1, -1])
        self.whole = 1  # the state of all symbols so far

    def _state(self, length: int, link: int, symbol: int = -1, target: int = 0) -> int:
        for values, value in (
            (self.length, length), (self.link, link), (self.symbol, symbol), (self.target, target),
            (self.up, 0), (self.left, 0), (self.right, 0), (self.last, -1),
        ):
            values.append(value)
        return len(self.length) - 1

    def _step(self, state: int, symbol: int) -> int:
        if self.symbol[state] == symbol:
            return self.target[state]
        others = self.more.get(state)
        return others.get(symbol, 0) if others else 0

    def _set(self, state: int, symbol: int, target: int) -> None:
        if self.symbol[state] in (-1, symbol):
            self.symbol[state], self.target[state] = symbol, target
        else:
            self.more.setdefault(state, {})[symbol] = target

    def _splay(self, x: int) -> None:
        """Bring ``x`` to the top of its splay tree; the path's colour moves along."""
        up, left, right, last = self.up, self.left, self.right, self.last
        while True:
            y = up[x]
            if not y:
                return
            at_left = left[y] == x
            if not at_left and right[y] != x:
                return  # y is the path's parent
            z = up[y]
            y_at_left = left[z] == y
            inner = z and (y_at_left or right[z] == y)
            for top in ((y, x) if inner and y_at_left == at_left else (x, x)) if inner else (x,):
                under = up[top]
                over = up[under]
                if left[under] == top:
                    child = right[top]
                    left[under], right[top] = child, under
                else:
                    child = left[top]
                    right[under], left[top] = child, under
                if child:
                    up[child] = under
                up[under], up[top] = top, over
                if over and left[over] == under:
                    left[over] = top
                elif over and right[over] == under:
                    right[over] = top
                else:
                    last[top] = last[under]

    def append(self, symbol: int) -> int:
        """Add a symbol; gives the state of all symbols so far."""
        before, length, link = self.whole, self.length, self.link
        state = self.whole = self._state(length[before] + 1, 1)
        p = before
        while p and not self._step(p, symbol):
            self._set(p, symbol, state)
            p = link[p]
        if p:
            q = self._step(p, symbol)
            if length[q] != length[p] + 1:
                clone = self._state(length[p] + 1, link[q], self.symbol[q], self.target[q])
                if q in self.more:
                    self.more[clone] = dict(self.more[q])
                while p and self._step(p, symbol) == q:
                    self._set(p, symbol, clone)
                    p = link[p]
                # the clone stands right above q on q's path
                self._splay(q)
                above = self.left[q]
                self.left[clone], self.left[q], self.up[clone], link[q] = above, clone, q, clone
                if above:
                    self.up[above] = clone
                q = clone
            link[state] = q
        self.up[state] = link[state]
        return state

    def access(self, state: int, place: int) -> Iterator[tuple[int, int]]:
        """Make the way from a new state to the root one path that last ended at ``place``.

        Yields (longest length, place before) of each segment that the way met, the longest first. The
        iterator has to be read to its end.
        """
        up, right, last, length = self.up, self.right, self.last, self.length
        below, x = state, up[state]
        while x:
            self._splay(x)
            if right[x]:
                last[right[x]] = last[x]  # the deeper rest is a path of its own
            if last[x] >= 0:
                yield length[x], last[x]
            right[x], below = below, x
            x = up[x]
        last[below] = place


def repeated_stretches(symbols: np.ndarray, times: int, least: int) -> Iterator[tuple[int, int]]:
    """Stretches (start, stop) outside which no word can be in a run; see the module."""
    pending = [(0, len(symbols))] if len(symbols) >= least else []
    while pending:
        start, stop = pending.pop()
        _, inverse, counts = np.unique(symbols[start:stop], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[inverse] < times)
        if not len(rare):
            yield start, stop
            continue
        bounds = np.concatenate(([-1], rare, [stop - start]))
        for i in np.flatnonzero(np.diff(bounds) > least).tolist():
            pending.append((start + int(bounds[i]) + 1, start + int(bounds[i + 1])))


def stretch_runs(symbols: list[int], exponent: int = EXPONENT) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of all runs of one stretch that are at least ``exponent`` (2 or more) periods long."""
    automaton, size = SuffixAutomaton(), len(symbols)
    reach: dict[int, int] = {}  # where the last run of a period ends
    for place, symbol in enumerate(symbols):
        held = period = 0  # of the segment before, which is known when the next one gives its shortest length
        for length, before in automaton.access(automaton.append(symbol), place):
            if period > length:
                yield from _run(symbols, size, place, period, reach)
            distance = place - before
            held, period = length, distance if length >= (exponent - 1) * distance else 0
        if period and held:
            yield from _run(symbols, size, place, period, reach)


def _run(symbols: list[int], size: int, place: int, period: int, reach: dict[int, int]) -> Iterator[tuple[int, int, int]]:
    """The run of a period around a place, unless it has been given before."""
    if reach.get(period, -1) >= place:
        return
    start, stop = place - period, place + 1
    while start and symbols[start - 1] == symbols[start - 1 + period]:
        start -= 1
    while stop < size and symbols[stop] == symbols[stop - period]:
        stop += 1
    reach[period] = stop - 1
    yield start, stop - start, period


def find_runs(symbols: np.ndarray, exponent: int = EXPONENT, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``exponent`` periods and ``least`` symbols, by start, then period."""
    if exponent < 2:
        raise ValueError("a run is at least two periods long")
    found = []
    for start, stop in repeated_stretches(symbols, exponent, least):
        for at, length, period in stretch_runs(symbols[start:stop].tolist(), exponent):
            if length >= max(least, exponent * period):
                found.append((start + at, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: a run keeps its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def words_of(text: str | None) -> list[bytes]:
    """Words: what stands between ASCII white space."""
    return text.encode().split() if text else []


def symbols_of(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """Word numbers of a text with a planted repetition, for one document of ten; none for the others and without an id."""
    code = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if code % 10 or not n:
        return None
    rest = code // 10
    first = rest % n
    period = 1 + (n - first) // (3 + rest % 8)
    places = np.arange(n)
    return np.where(places < first, places, first + (places - first) % period)


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
        ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("collapsed", pa.string()),
        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
    ]
)
_DDL = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "collapsed string, runs array<struct<start: long, length: long, period: long>>"
)


def _judge(doc_id: int | None, text: str | None, exponent: int, least: int, plant: bool, texts: bool) -> tuple:
    words = words_of(text)
    places = planted(len(words), doc_id) if plant else None
    symbols = symbols_of(words)
    if places is not None:
        words, symbols = [words[i] for i in places.tolist()], symbols[places]
    runs = find_runs(symbols, exponent, least)
    best = None
    for run in runs:  # by start, then period; a later one has to be better to count
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    stays = collapsed(len(words), runs) if runs else None
    rest = b" ".join(words if stays is None else [words[i] for i in np.flatnonzero(stays).tolist()])
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    return (
        doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(rest).hexdigest(), rest.decode() if texts else None,
        [{"start": s, "length": length, "period": p} for s, length, p in runs] if texts else None,
    )


def document_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, least: int = LEAST_WORDS,
    plant: bool = False, texts: bool = True,
) -> DataFrame:
    """One row per document: doc_id, n_runs, the run of the greatest exponent, checksums, and with ``texts`` the text with
    every run cut to its first period and all runs.

    ``plant`` repeats a part of one document of ten before the search, by its id (:func:`planted`).
    """
    if exponent < 2:
        raise ValueError("a run is at least two periods long")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                ids = batch.column(0).slice(at, len(part)).to_pylist()
                at += len(part)
                rows = [_judge(i, text, exponent, least, plant, texts) for i, text in zip(ids, part)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(judge, _DDL)
