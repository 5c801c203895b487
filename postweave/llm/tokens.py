"""Token ids of whole texts as little-endian 32-bit binaries.

Byte-level tokenizers cut a text before they merge, and always in front of white space that follows
a printed character and, there, in front of a single mark behind a letter or digit. Such stretches can be encoded alone, so each task keeps the ids of the
stretches it has met and gives only the pieces of new ones to the tokenizer's model. Texts are worked
off a few megabytes at a time: their stretches become an Arrow dictionary, each value of it is looked up
once, and the ids are taken by number. Texts with
other white space than single spaces and newlines between words, texts that hold the string of an
added token (it gets its own id), and tokenizers that cut differently, go through the tokenizer whole.
"""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from string import ascii_letters, digits, punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from postweave.llm.words import byte_classes

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are written as native integers, which have to be little-endian ones of 32 bits")

CACHE_ENTRIES = 250_000  # of each of the two generations a worker keeps
_SEEN = 1 << 22  # marks of stretches met once, a byte each
_TAIL = 3  # marks behind a word whose ids are all kept
TEXT_BYTES = 1 << 23  # of texts whose stretches are looked up together; a longer text stands alone


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# How byte-level tokenizers cut a text, and the characters that stand for bytes in them.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
BYTE_CHARS = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(_HIDDEN)}
_SPACE = chr(BYTE_CHARS[0x20])
_GAP, _PLAIN, _MARK = 1, 2, 3
_KINDS = byte_classes(gap=b" \n", plain=(ascii_letters + digits).encode(), mark=punctuation.encode())
SETTLED = "\u0500"  # below it all tables of character kinds agree; above it the tokenizer's own is asked


def settled(text: str) -> bool:
    return text.isascii() or max(text) < SETTLED


class _Whole(Exception):
    """A text has to go through the tokenizer whole."""


class CachedEncoder:
    """Ids of texts by a byte-level tokenizer file; memory is bounded by two cache generations."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        parts = json.loads(self.tokenizer.to_str())
        cut = parts["pre_tokenizer"] or {}
        self.by_stretch = cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and not parts["normalizer"]
        self.pieces = regex.compile(PIECES).findall
        self.added = [x["content"] for x in parts["added_tokens"]]
        # an added token without white space and not of letters alone lies in one stretch and is looked for when that is new
        self.by_stretch &= all(x.split() == [x] and not x.isalpha() and not any(t[k] for k in ("lstrip", "rstrip", "normalized", "single_word"))
                               for t in parts["added_tokens"] for x in [t["content"]])
        # no added token may lie across the cut in front of a mark
        self.by_mark = not any(x[-1] in punctuation and x[-2:-1].isalnum() for x in self.added)
        self.newline = self._merge("\n") if self.by_stretch else b""
        self.tails: dict[str, bytes] = {}
        self.limit = cache_entries
        self._turn({})

    def _turn(self, old: dict[str, bytes]) -> None:
        """Begin a generation: the stretches kept in it and before, and marks of those met once."""
        self.old, self.young, self.seen = old, {}, bytearray(_SEEN)

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _letters(self, piece: str) -> bytes:
        """Ids of settled letters, which are one piece, in the characters that stand for their bytes."""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(BYTE_CHARS)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a space and letters, which are one piece."""
        if word.isascii():
            shown = _SPACE + word
        elif max(word) < SETTLED:
            shown = _SPACE + word.encode().decode("latin-1").translate(BYTE_CHARS)
        else:
            return self._encode([" " + word])[0]
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _merge(self, stretch: str) -> bytes:
        """Ids of one stretch: its pieces, in the characters that stand for their bytes, through the model."""
        if not settled(stretch):
            return self._encode([stretch])[0]
        ids: list[int] = []
        for piece in self.pieces(stretch):
            shown = piece.encode().decode("latin-1").translate(BYTE_CHARS)
            ids += [t.id for t in self.model.tokenize(shown)]
        return array("I", ids).tobytes()

    def _tail(self, tail: str) -> bytes:
        """Ids of a few marks behind letters, which are one piece."""
        known = self.tails.get(tail)
        if known is None:
            known = self.tails[tail] = self._merge(tail)
        return known

    def new(self, stretch: str) -> bytes:
        """Ids of a stretch that is not known; ``_Whole`` if it holds other white space or an added token."""
        if stretch.isalpha():
            return self._word(stretch)
        newline = stretch[:1] == "\n"
        word = stretch[newline:]
        base = word.rstrip(punctuation)
        tail = word[len(base) :]
        odd = any(x in word for x in self.added)
        if base.isalpha() and len(tail) <= _TAIL and settled(base) and not odd:
            if newline:  # then letters without a space
                known = self.newline + self._letters(base)
            else:  # the word is often known alone
                known = self._kept(base)
            return known + self._tail(tail) if tail else known
        if odd or word.split() != [word]:
            raise _Whole
        # a stretch follows a space unless it begins with a newline
        return self._merge(stretch if newline else " " + stretch)

    def _first(self, stretch: str) -> bytes:
        """Ids of a mark or of a text's first stretch, which no space or newline leads."""
        if stretch.split() != [stretch] or any(x in stretch for x in self.added):
            raise _Whole
        return self._tail(stretch) if stretch in punctuation else self._merge(stretch)

    def _kept(self, stretch: str, again: bool = False) -> bytes:
        """Ids of a stretch; a new one is kept when it is met again.

        Many stretches are met once; kept, they would take the places of others.
        """
        known = self.young.get(stretch)
        if known is None:
            known = self.old.get(stretch)
            if known is None:
                known = self.new(stretch)
                if not again:
                    place = hash(stretch) % _SEEN
                    if not self.seen[place]:
                        self.seen[place] = 1
                        return known
            self.young[stretch] = known
        return known

    def _known(self, stretches: list[str], times: np.ndarray) -> list[bytes | None]:
        """Ids of stretches as they were cut; none where a text has to go through the tokenizer whole."""
        young = self.young.get
        known = [young(x[1:] if x[0] == " " else x if x[0] == "\n" else None) for x in stretches]
        for i in [i for i, x in enumerate(known) if x is None]:
            stretch = stretches[i]
            try:
                if stretch[0] == " ":
                    known[i] = self._kept(stretch[1:], times[i] > 1)
                else:
                    known[i] = self._kept(stretch, times[i] > 1) if stretch[0] == "\n" else self._first(stretch)
            except _Whole:
                continue
        return known

    def _by_stretch(self, texts: pa.LargeStringArray) -> list[bytes]:
        """The ids of each of a few texts without nulls."""
        places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[places[0] : places[-1]]
        places = places - places[0]
        kinds = _KINDS[data]
        begins = np.append(kinds == _GAP, True)  # the last one is the end
        begins[places] = True
        if self.by_mark:
            begins[1:-1] |= (kinds[1:] == _MARK) & (kinds[:-1] == _PLAIN) & begins[2:]
        cuts = np.flatnonzero(begins)
        stretches = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        times = np.bincount(stretches.indices, minlength=len(stretches.dictionary))
        known = self._known(stretches.dictionary.to_numpy(zero_copy_only=False).tolist(), times)
        ids = pa.array([x or b"" for x in known], pa.large_binary()).take(stretches.indices)
        firsts = np.searchsorted(cuts, places)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[firsts].tolist()
        body = memoryview(ids.buffers()[2] or b"")
        found = [bytes(body[a:b]) for a, b in zip(ends, ends[1:])]
        if None in known:
            odd = np.isin(stretches.indices, [i for i, x in enumerate(known) if x is None])
            for i in np.unique(np.searchsorted(firsts, np.flatnonzero(odd), side="right") - 1).tolist():
                found[i] = self._encode([texts[i].as_py()])[0]
        if len(self.young) > self.limit:
            self._turn(self.young)
        return found

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit integers; none for null and for the empty text."""
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else None
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(places, places[at] + TEXT_BYTES, side="right")) - 1)
            few = texts.slice(at, stop - at)
            if self.by_stretch:
                yield from self._by_stretch(few)
            else:
                for text in few:
                    yield self._encode([text.as_py()])[0]
            at = stop

    def encode(self, text: str | None) -> bytes:
        """The ids of one text, as :meth:`encode_all` gives them."""
        return next(self.encode_all(pa.array([text], pa.string())))


@cache
def encoder(path: str) -> CachedEncoder:
    """One encoder for all tasks of a worker."""
    return CachedEncoder(path)


def ids_udf(path: str, end_id: int | None = None) -> Callable[[Column], Column]:
    """text -> its ids (and the end id) as a binary of little-endian 32-bit integers."""
    tail = b"" if end_id is None else end_id.to_bytes(4, "little")

    @F.arrow_udf("binary")
    def token_ids(texts: pa.Array) -> pa.Array:
        return pa.array((ids + tail for ids in encoder(path).encode_all(texts)), pa.binary())

    return token_ids
