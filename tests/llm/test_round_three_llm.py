"""Findings of round three about the training-data operators."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from postweave.llm import packing, phrases, tokens


def test_packing_tokenizes_every_text_once(spark, tmp_path, monkeypatch):
    """Before, an inferred filter on the pieces ran the tokenizer a second time on every text."""
    plans, plain = [], DataFrameWriter.parquet

    def parquet(writer, path, **options):
        plans.append(writer._df._jdf.queryExecution().executedPlan().toString())
        plain(writer, path, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    packing.write_pieces(spark.createDataFrame([(1, "one two")], "doc_id long, text string"), str(tmp_path / "pieces"))
    assert len(plans) == 1 and len(re.findall("ArrowEvalPython|MapInArrow", plans[0])) == 1


def test_pieces_of_many_and_long_texts(spark, tmp_path):
    texts = ["one two " * n for n in (0, 1, 3, 700)] + [None, "é", "w" * 50, "far too long for one hand-over " * 200_000, "the last"]
    docs = spark.createDataFrame([(None if i == 2 else i, t) for i, t in enumerate(texts)], "doc_id int, text string").coalesce(1)
    rows = packing.write_pieces(docs, str(tmp_path / "pieces"), end_id=7, max_length=64).toPandas()
    encode = tokens.CachedEncoder(tokens.default_tokenizer()).encode
    for i, text in enumerate(texts):
        mine = rows[rows["doc_id"].isna() if i == 2 else rows["doc_id"] == i].sort_values("start")
        ids = encode(text) + (7).to_bytes(4, "little")
        n = len(ids) // 4
        assert b"".join(mine["ids"]) == ids and set(mine["doc_tokens"]) == {n}
        assert list(mine["length"]) == [64] * (n // 64) + [1 << b for b in range(5, -1, -1) if n >> b & 1]
        assert list(mine["start"]) == list(np.cumsum(mine["length"]) - mine["length"])
        assert [len(x) for x in mine["ids"]] == list(4 * mine["length"])


def test_phrases_split_every_text_once(spark, monkeypatch):
    """Before, each of the scans split the texts into words again and sent phrases as strings."""
    plans, plain = [], DataFrameWriter.parquet

    def parquet(writer, path, **options):
        plans.append(writer._df._jdf.queryExecution().executedPlan().toString())
        plain(writer, path, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    docs = spark.createDataFrame([("en", "one two three four five")] * 7, "lang string, text string")
    found = phrases.count_phrases(docs, least=5, map_bits=1 << 15)
    assert sum("text#" in p for p in plans) == 1
    assert sorted(r["n"] for r in found.collect()) == [7] * 14 + [35]


def test_hashes_of_keys_are_those_of_spark(spark):
    keys = [[1, -5, 1 << 62, 0], [7, 0, -(1 << 63), (1 << 63) - 1]]
    rows = spark.createDataFrame(list(zip(*keys)), "a long, b long").coalesce(1)
    one, both = zip(*rows.select(F.xxhash64("a", F.lit(None).cast("long")), F.xxhash64("a", "b")).collect())
    arrays = [np.array(k) for k in keys]
    assert list(phrases.key_hashes(arrays[:1]).view(np.int64)) == list(one)
    assert list(phrases.key_hashes(arrays).view(np.int64)) == list(both)


def test_chunks_of_words_and_borders():
    """Empty words go, empty pieces and shards without texts are borders only."""
    batch = phrases._chunk("en", [[b"a  b ", b"b\n\n c"], [], [b" "], [b"a"]]).to_pylist()[0]
    assert batch["words"] == ["a", "b", "c"] and batch["counts"] == [2, 2, 1]
    line, cuts = np.frombuffer(batch["line"], np.int32).tolist(), batch["cuts"]
    assert [line[a:b] for a, b in zip(cuts, cuts[1:])] == [[1, 2, 0, 2, 0, 0, 3, 0, 0], [0], [0, 0], [1, 0, 0]]
    assert phrases._chunk("en", [[b" "]]).to_pylist()[0]["words"] == []


def test_stretches_met_once_take_no_place(monkeypatch):
    """Before, every new stretch was kept, and words with marks or behind a newline were cut by the pattern."""
    encoder = tokens.CachedEncoder(tokens.default_tokenizer())
    merged, merge = [], encoder._merge
    monkeypatch.setattr(encoder, "_merge", lambda stretch: merged.append(stretch) or merge(stretch))
    once = [f"{a}{b}ing" for a in "abcdefghij" for b in "klmnopqrst"]
    text = "It " + " ".join(once) + " twice twice!! twice!!\nTwice, twice.\nonce"
    whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    for _ in range(2):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == whole
        assert ("twice" in encoder.young) and len(encoder.young) < 10 or _
    assert set(once) < set(encoder.young) and not [x for x in merged if len(x) > 2]


def test_ids_of_words_with_marks_and_newlines():
    draw = np.random.default_rng(4)
    parts = ["word", "Über", "don't", "x", "中文", "5", "\n", " ", " ", " ", "  ", ",", ".", "!!", "'", "_", "\"", "***", "<|endoftext|>", "|>", "é", "\r", "'s"]
    encoder = tokens.CachedEncoder(tokens.default_tokenizer(), cache_entries=20)
    for _ in range(6000):
        text = "".join(parts[i] for i in draw.integers(0, len(parts), draw.integers(0, 14)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert len(encoder.tails) <= 33**3


def test_a_stretch_is_looked_up_once_for_many_texts(monkeypatch):
    """Before, every occurrence was looked up, a word with a mark was a stretch of its own and a new one was merged twice."""
    encoder = tokens.CachedEncoder(tokens.default_tokenizer())
    looked, merged, known, word = [], [], encoder._known, encoder._word
    monkeypatch.setattr(encoder, "_known", lambda stretches, times: looked.extend(stretches) or known(stretches, times))
    monkeypatch.setattr(encoder, "_word", lambda x: merged.append(x) or word(x))
    texts = ["so many words, many words. many", None, "", "so 5, words? many"] * 50
    found = list(encoder.encode_all(pa.array(texts)))
    assert found == [x.tobytes() for x in (np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4") for t in texts)]
    assert sorted(looked) == sorted(["so", " many", " words", ",", ".", " 5", "?"]) and sorted(merged) == ["many", "words"]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_ids_of_columns_of_texts(monkeypatch, kind):
    """Texts are cut into groups anywhere; odd ones among them go through the tokenizer whole."""
    monkeypatch.setattr(tokens, "TEXT_BYTES", 40)
    draw = np.random.default_rng(7)
    parts = ["word", "Über", "don't", "x", "中文", "5", "\n", " ", " ", " ", "  ", ",", ".", "!!", "'", "_", "***", "<|endoftext|>", "é", "\r", "'s", " ", "\t", "\0"]
    texts = ["".join(parts[i] for i in draw.integers(0, len(parts), draw.integers(0, 14))) for _ in range(3000)]
    texts[5:8], texts[20], texts[-2:] = [None, "", None], "many words " * 30, ["", None]
    encoder = tokens.CachedEncoder(tokens.default_tokenizer(), cache_entries=30)
    ids = [np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    column = pa.array(texts, kind)
    for first, n in ((0, 3000), (6, 2994), (7, 1), (3000, 0), (2998, 2), (17, 900)):
        assert list(encoder.encode_all(column.slice(first, n))) == ids[first : first + n]


def test_an_added_token_that_ends_in_a_mark_stays_one(tmp_path):
    from tokenizers import AddedToken, Tokenizer

    plain = Tokenizer.from_file(tokens.default_tokenizer())
    plain.add_tokens([AddedToken("end.", normalized=False), AddedToken("!", normalized=False)])
    plain.save(str(tmp_path / "added.json"))
    encoder = tokens.CachedEncoder(str(tmp_path / "added.json"))
    for text in ("the end.", "the end. It", "end. x", "wow! so", "a !", "the end, it"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
