"""Language identification by cross-parsing entropy.

For each language the suffix automaton of a bounded sample of its text recognises every stretch of
that sample. A text is parsed against it greedily: a phrase is the longest stretch that the sample
also has. Few phrases mean few bits: phrases x log2(sample size) / text size, in bits per byte
(normalised by the size of text and sample). The language with the fewest wins, ties by name.

Texts are lower-cased and everything but letters becomes one space. They are parsed whole, in blocks of
``BLOCK`` bytes that are walked side by side through a table of the automaton's transitions.

The sample: at most ``SAMPLE_ROWS`` rows of each language, those with the smallest hash of their id, and
of each an equal part of ``SAMPLE_BYTES``. Rows with a null language or id are not learned from.
Null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing was
learned. Repeated rows are all judged; an empty table gives no rows.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postweave.llm.quality import held_out
from postweave.llm.words import batches_of, slices

SAMPLE_ROWS = 32
SAMPLE_BYTES = 24_000
MODEL_BYTES = 1 << 29  # of all languages' tables, which every worker holds
BLOCK = 256
UNKNOWN = "und"
KNOWN_BITS = 6.0  # a text that takes more bits a byte in every language is in none of them
KNOWN_BYTES = 200  # shorter texts are not judged by that
_STRETCH = BLOCK << 12  # bytes parsed at once
_NO_LETTERS = re.compile(r"[\W\d_]+")


class Model(NamedTuple):
    names: list[str]
    symbols: np.ndarray  # byte -> symbol; the last two are unknown and end of text
    tables: list[np.ndarray]  # state row + symbol -> next state row, or its complement where a phrase begins
    bits: np.ndarray  # log2 of the sample sizes


def normalise(text: str | None) -> bytes:
    """Lower case; stretches of other characters than letters become one space. Empty without a letter."""
    clean = _NO_LETTERS.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, clean)):  # ends at the first letter
        return b""
    return clean.encode("utf-8", "replace")


def suffix_automaton(sample: bytes) -> list[dict[int, int]]:
    """Transitions of each state; the paths from state 0 are the stretches of the sample."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for byte in sample:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        state = last
        while state >= 0 and byte not in moves[state]:
            moves[state][byte] = new
            state = link[state]
        if state >= 0:
            target = moves[state][byte]
            if length[target] == length[state] + 1:
                link[new] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                length.append(length[state] + 1)
                link.append(link[target])
                while state >= 0 and moves[state].get(byte) == target:
                    moves[state][byte] = copy
                    state = link[state]
                link[target] = link[new] = copy
        last = new
    return moves


def build(samples: dict[str, bytes]) -> Model:
    names = sorted(name for name, sample in samples.items() if sample)
    seen = sorted(set(b"".join(samples[n] for n in names)))
    symbols = np.full(256, len(seen), np.int32)
    symbols[seen] = np.arange(len(seen))
    width = len(seen) + 2
    tables = []
    for name in names:
        moves = suffix_automaton(samples[name])
        between = len(moves) * width  # the last row: no phrase is open, so any symbol begins one
        restart = np.full(width, ~between, np.int32)  # a phrase begins here; an unknown symbol is one alone
        for byte, target in moves[0].items():
            restart[symbols[byte]] = ~(target * width)
        table = np.tile(restart, (len(moves) + 1, 1))
        table[:, width - 1] = between  # after the end nothing is counted
        states = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
        table[states, symbols[[b for m in moves for b in m]]] = [t * width for m in moves for t in m.values()]
        tables.append(table.ravel())
    return Model(names, symbols, tables, np.log2([max(2, len(samples[n])) for n in names]))


def _phrases(texts: list[bytes], model: Model) -> np.ndarray:
    """Phrases of each text (row) in each language (column), parsed in blocks side by side."""
    width = int(model.symbols.max(initial=0)) + 2
    sizes = np.array([len(t) for t in texts], np.int64)
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(texts)), blocks)
    padded = np.full(int(blocks.sum()) * BLOCK, width - 1, np.int32)
    at = 0
    for text, n in zip(texts, blocks.tolist()):
        padded[at : at + len(text)] = model.symbols[np.frombuffer(text, np.uint8)]
        at += n * BLOCK
    steps = np.ascontiguousarray(padded.reshape(-1, BLOCK).T)
    phrases = np.zeros((len(texts), len(model.names)), np.int64)
    for number, table in enumerate(model.tables):
        state = np.full(steps.shape[1], len(table) - width, np.int32)
        begun = np.zeros(steps.shape[1], np.int32)
        for symbol in steps:
            state = table[state + symbol]
            begin = state >> 31
            begun -= begin
            state ^= begin
        phrases[:, number] = np.bincount(owner, begun, len(texts))
    return phrases


def entropies(texts: list[bytes], model: Model) -> np.ndarray:
    """Bits per byte of each text (row) in each language (column); a bounded stretch at a time."""
    parts = [(i, t[at : at + _STRETCH]) for i, t in enumerate(texts) for at in range(0, len(t), _STRETCH)]
    phrases = np.zeros((len(texts), len(model.names)))
    for first, stop in batches_of([part for _, part in parts], _STRETCH):
        found = _phrases([part for _, part in parts[first:stop]], model)
        np.add.at(phrases, [i for i, _ in parts[first:stop]], found)
    return phrases * model.bits / np.maximum([len(t) for t in texts], 1)[:, None]


def judge(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score (0 to 1) and bits per byte of each text."""
    clean = [normalise(t) for t in texts]
    names, score, bits = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.inf)
    if model.names and texts:
        found = entropies(clean, model)
        best = found.argmin(axis=1)
        bits = found[np.arange(len(texts)), best]
        size = np.array([len(c) for c in clean])
        # share of the winner if each language's probability were 2 ** -bits of a text a tenth as long (neighbouring
        # phrases are not independent), and of 500 bytes at most, as beyond that every share would be 0 or 1
        share = np.exp2((bits[:, None] - found) * np.minimum(size, 500)[:, None] / 10)
        score = np.where(size > 0, 1 / share.sum(axis=1), 0.0)
        bits = np.where(size > 0, bits, np.inf)
        names = [model.names[i] if n else UNKNOWN for i, n in zip(best, size)]
    return names, score, bits


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Build the automata from a bounded sample of the rows that are not held out.

    Of each language the ``sample_rows`` rows with a letter whose ids have the smallest hash, together about
    ``sample_bytes`` characters: short texts whole, of longer ones a stretch from a hashed place; what short texts leave
    goes to the others. The driver gets lengths, then the stretches.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(text_col).rlike(r"\p{L}"))
    known = known.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text_hash")  # limited per task first
    keys = known.select("id", "text_hash", "lang", F.char_length("text").alias("n"))
    chosen = keys.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_rows).toPandas()
    if not len(chosen):
        return build({})
    chosen["take"] = 0
    for _, rows in chosen.groupby("lang"):
        chosen.loc[rows.index, "take"] = _shares(rows["n"].to_numpy(), sample_bytes)
    kind = known.select("id").schema[0].dataType.simpleString()
    rows = list(chosen[["id", "text_hash", "lang", "rank", "take"]].itertuples(index=False, name=None))
    small = F.broadcast(spark.createDataFrame(rows, f"id {kind}, text_hash long, lang string, rank int, take int"))
    # both counted from 1; the same rows as above by id, language and text
    begin = F.pmod(F.xxhash64("id", "text_hash"), F.char_length("text") - F.col("take") + 1).cast("int") + 1
    texts = known.join(small, ["id", "text_hash", "lang"]).select("lang", "rank", F.col("text").substr(begin, F.col("take")).alias("text"))
    sample = texts.dropDuplicates(["lang", "rank"]).toPandas().sort_values(["lang", "rank"])
    return build({lang: b" ".join(filter(None, map(normalise, rows["text"]))) for lang, rows in sample.groupby("lang")})


def _shares(sizes: np.ndarray, total: int) -> np.ndarray:
    """How much of each text is taken: all of the short ones, and of the others as much as fills the total evenly."""
    taken, left = np.zeros(len(sizes), np.int64), total
    for place, i in enumerate(np.argsort(sizes, kind="stable").tolist()):
        taken[i] = min(int(sizes[i]), left // (len(sizes) - place))
        left -= taken[i]
    return taken


def language_udf(docs: DataFrame, model: Model):
    """text -> struct(lang, score, bits)."""
    size = sum(t.nbytes for t in model.tables)
    if size > MODEL_BYTES:
        raise ValueError(f"the {len(model.names)} languages' tables take {size} bytes, more than every worker may hold")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double, bits: double>")
    def language(texts: pa.Array) -> pa.Array:
        found = [judge(part, shared.value) for part in slices(texts)]
        names = pa.array([name for part in found for name in part[0]], pa.string())
        score, bits = (np.concatenate([np.empty(0), *[part[i] for part in found]]) for i in (1, 2))
        return pa.StructArray.from_arrays([names, pa.array(score), pa.array(bits)], ["lang", "score", "bits"])

    return language


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, bits_per_byte."""
    language = language_udf(docs, fit(docs, id_col, text_col, lang_col, **options))
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), language(F.col(text_col)).alias("found"))
    return rows.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", F.col("found.bits").alias("bits_per_byte"))


def keep_known(docs: DataFrame, known_bits: float = KNOWN_BITS, text_col: str = "text", **options) -> DataFrame:
    """Documents in one of the learned languages, columns as they are.

    Rejected: ``und``, and texts of ``KNOWN_BYTES`` or more that no language explains with ``known_bits`` bits a byte.
    """
    language = language_udf(docs, fit(docs, text_col=text_col, **options))
    found = language(F.col(text_col))
    explained = (found["bits"] <= known_bits) | (F.octet_length(text_col) < KNOWN_BYTES)
    return docs.where((found["lang"] != UNKNOWN) & explained)
