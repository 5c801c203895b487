"""Token counts by heap-and-linked-list byte-pair merging.

A piece's bytes form a linked list of symbols, and a heap holds the adjacent pairs that the vocabulary can merge,
by rank, then place. The lowest is popped again and again; if its two symbols are still neighbours the
right one is unlinked and the pairs with the new neighbours go onto the heap. The count is the number of
bytes minus the number of merges: no ids are made.

Texts are cut into pieces as the tokenizer does it before it merges. Words repeat, so each worker keeps the counts
of the stretches between spaces that it has met (two generations of bounded size). Added tokens in a text
(``<|endoftext|>``) are one token each, as the tokenizer has it by default; they part the text around them.

Null and empty texts have no tokens. A very long text is counted stretch by stretch, and one piece of n bytes takes
n log n steps. Repeated rows are counted one by one. An empty table gives no rows. Only the two named columns are
read, whatever the others are called.
"""

from __future__ import annotations

import json
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweave.llm.tokens import BYTE_CHARS, PIECES, default_tokenizer, settled
from postweave.llm.words import slices

LIMIT = 512
_MARKS = frozenset(".,;:!?")
CACHE_ENTRIES = 250_000  # of each of the two generations of stretches, and of pieces, that a worker keeps


class MergeTable:
    """The merges of a byte-level tokenizer file: rank and result of each pair of symbols."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.size = max(vocabulary.values()) + 1
        if not all(char_of(b) in vocabulary for b in range(256)):
            raise ValueError("the vocabulary lacks some bytes")
        self.byte_symbols = [vocabulary[char_of(b)] for b in range(256)]
        # by the pair in one number; the rank names the result
        self.ranks = {vocabulary[a] * self.size + vocabulary[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.results = [vocabulary[a + b] for a, b in pairs]

    def count(self, piece: bytes) -> int:
        """Tokens of one piece."""
        n = len(piece)
        if n < 2:
            return n
        size, rank_of, results = self.size, self.ranks.get, self.results
        symbols = list(map(self.byte_symbols.__getitem__, piece))
        ranks = [rank_of(a * size + b, -1) for a, b in zip(symbols, symbols[1:])]  # of the pair that begins here; -1: none
        heap = [rank << 40 | at for at, rank in enumerate(ranks) if rank >= 0]
        heapify(heap)
        ranks.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            at = entry & 0xFFFFFFFFFF
            rank = entry >> 40
            if ranks[at] != rank:
                continue  # one of its symbols has been merged since
            gone = after[at]
            symbol = symbols[at] = results[rank]
            ranks[gone] = -1
            following = after[at] = after[gone]
            n -= 1
            if following < len(symbols):
                before[following] = at
                new = ranks[at] = rank_of(symbol * size + symbols[following], -1)
                if new >= 0:
                    heappush(heap, new << 40 | at)
            else:
                ranks[at] = -1
            leading = before[at]
            if leading >= 0:
                new = ranks[leading] = rank_of(symbols[leading] * size + symbol, -1)
                if new >= 0:
                    heappush(heap, new << 40 | leading)
        return n


def char_of(byte: int) -> str:
    return chr(BYTE_CHARS[byte])


class TokenCounter:
    """Token counts of texts by a byte-level tokenizer file."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as source:
            parts = json.load(source)
        model, cut = parts["model"], parts["pre_tokenizer"] or {}
        added = parts["added_tokens"]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut.get("add_prefix_space") or parts["normalizer"] or not plain:
            raise ValueError("only byte-level tokenizers that cut by the common pattern can be counted")
        if any(t[k] for t in added for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("added tokens must stand for their plain string")
        self.table = MergeTable(model["vocab"], model["merges"])
        self.cut_settled = regex.compile(PIECES).findall
        self.own_cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str  # cuts only, as the library knows more characters
        contents = sorted((t["content"] for t in added), key=len, reverse=True)
        self.split_added = regex.compile("|".join(map(regex.escape, contents))).split if contents else lambda text: [text]
        self.added = contents
        # an added token within a stretch is met when the stretch is new; others are looked for in each text
        self.loose = [x for x in contents if x.split() != [x]]
        self.limit = cache_entries
        self.young: dict[str, int] = {}  # of stretches between spaces
        self.old: dict[str, int] = {}
        self.young_pieces: dict[str, int] = {}
        self.old_pieces: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        """What the tokenizer merges apart from each other."""
        if settled(text or "."):
            return self.cut_settled(text)
        return [text[a:b] for _, (a, b) in self.own_cut(text)]

    def _piece(self, piece: str) -> int:
        known = self.young_pieces.get(piece)
        if known is None:
            known = self.old_pieces.get(piece)
            if known is None:
                known = self.table.count(piece.encode())
            self.young_pieces[piece] = known
        return known

    def _whole(self, text: str) -> int:
        """Tokens of a text with any white space and added tokens."""
        parts = self.split_added(text)
        total = len(parts) - 1
        for part in parts:
            total += sum(map(self._piece, self.pieces(part)))
            self._turn()
        return total

    def _turn(self) -> None:
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        if len(self.young_pieces) > self.limit:
            self.old_pieces, self.young_pieces = self.young_pieces, {}

    def _learn(self, stretches: set[str]) -> bool:
        """Count new stretches; false if one holds other white space or an added token."""
        young, old = self.young, self.old
        for stretch in stretches:
            known = old.get(stretch)
            if known is None:
                newline = stretch[:1] == "\n"  # any other stretch follows a space
                word = stretch[newline:]
                if word.isalpha() and settled(word):  # one piece, or the newline and one
                    known = self._piece(word) + 1 if newline else self._piece(" " + word)
                elif word[-1:] in _MARKS and word[:-1].isalpha() and settled(word):  # and a mark of one byte
                    known = self._piece(word[:-1]) + 2 if newline else self._piece(" " + word[:-1]) + 1
                elif word.split() != [word] or any(x in word for x in self.added):
                    return False
                else:
                    known = sum(map(self._piece, self.pieces(stretch if newline else " " + stretch)))
            young[stretch] = known
        return True

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        head, *stretches = text.replace("\n", " \n").split(" ")
        if head.split() != [head] or any(x in head for x in self.added) or any(x in text for x in self.loose):
            return self._whole(text)
        found = list(map(self.young.get, stretches))
        if None in found:
            if not self._learn({x for x, n in zip(stretches, found) if n is None}):
                return self._whole(text)
            found = list(map(self.young.__getitem__, stretches))
        total = sum(found) + sum(map(self._piece, self.pieces(head)))
        self._turn()
        return total


@cache
def counter(path: str) -> TokenCounter:
    """One counter for all tasks of a worker."""
    return TokenCounter(path)


def count_udf(path: str):
    """text -> its number of tokens."""

    @F.arrow_udf("long")
    def n_tokens(texts: pa.Array) -> pa.Array:
        count = counter(path).count
        return pa.array((count(text) for part in slices(texts) for text in part), pa.int64())

    return n_tokens


def count_tokens(text: Column | str, tokenizer: str | None = None) -> Column:
    """The number of tokens of a text column."""
    return count_udf(tokenizer or default_tokenizer())(F.col(text) if isinstance(text, str) else text)


def document_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(
        F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), count_tokens(text, tokenizer).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
