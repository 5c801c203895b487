"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, and the operators' own interfaces."""

import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_llm_queries import brute_components, brute_simhash

from postweave.llm import chat, decontaminate, fingerprints, langid, packing, quality, sharding, simhash, tokenfile, tokens, urlfilter, words
from postweave.operators.ordering import dense_ids

LONG = " ".join(f"word{i} and" for i in range(30_000))
TEXTS = [
    (1, "The same old text, word for word, in several rows of this table."),
    (1, "The same old text, word for word, in several rows of this table."),
    (2, "The same old text, word for word, in several rows of this table."),
    (3, None), (4, ""), (5, "   \n\t "), (6, "12345 !!! ???"), (7, LONG), (8, "x"), (9, "Éa ß 😀\x00 a\u2028b"),
    (None, "A row without an id."), (None, None), (10, "a  b\n\n c\td"),
]
CLASHING = ["lang", "source", "score", "fp", "ids", "id", "hub", "node", "shard", "stretch", "copy", "piece", "start", "length", "label", "found", "n", "rank", "place", "n_words"]


def table(spark, rows=TEXTS):
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    return plain.select("*", *[F.lit(None).cast("string").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def test_encoder_equals_the_tokenizer():
    encoder = tokens.CachedEncoder(tokens.default_tokenizer(), cache_entries=50)
    draw = random.Random(1)
    parts = list("abcABC  \n\n.,!'?19é ßñ😀\t_-\x00\x1f\xa0²½आ中") + ["'s", "'ll", " the", "\n ", " don't", "<|endoftext|>"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 30))) for _ in range(3000)]
    texts += [" ".join(draw.choices(["Some", "words,", "are", "frequent.", "É", "naïve"], k=20)) for _ in range(300)]
    for text, ids in zip(texts, encoder._encode(texts)):
        assert encoder.encode(text) == ids
    assert len(encoder.young) <= 100


def test_packing_edges(spark, docs, none):
    found = packing.packed_digest(docs).toPandas()
    lengths = found.groupby("doc_id", dropna=False)["length"].sum()
    assert lengths[3.0] == lengths[4.0] == 1 and lengths[7.0] > 2048
    assert len(found[found["doc_id"] == 1]) == 2 * len(found[found["doc_id"] == 2])
    assert packing.packed_digest(none).count() == 0
    spans = spark.range(1, 5000, 37).select("id", packing.piece_spans(F.col("id"), 64).alias("p")).collect()
    for n, pieces in spans:
        assert [p["start"] for p in pieces] == list(np.cumsum([0] + [p["length"] for p in pieces])[:-1])
        assert sum(p["length"] for p in pieces) == n and len(pieces) == n // 64 + bin(n % 64).count("1")
    with pytest.raises(ValueError):
        packing.piece_spans(F.lit(3), 100)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=200))
def test_bits_round_trip(bits, values):
    ids = np.array(values, "<u8") % (1 << bits)
    packed = tokenfile.pack_bits(ids.astype("<u4"), bits)
    assert len(packed) == -(-len(values) * bits // 8)
    assert (tokenfile.unpack_bits(packed, bits, len(values)) == ids).all()


def test_token_file_random_access(tmp_path):
    draw, place = np.random.default_rng(0), tmp_path / "a.tok"
    lists = [draw.integers(0, 50257, draw.integers(0, 400)).astype("<u4") for _ in range(50)]
    for bits, block in ((16, 64), (17, 8), (16, 1 << 16)):
        with open(place, "wb") as sink:
            writer = tokenfile.TokenFileWriter(sink, bits, block)
            for i, ids in enumerate(lists):
                writer.add(None if i == 3 else i, ids)
            writer.close()

        class Source(io.BytesIO):
            def size(self):
                return len(self.getvalue())

        reader = tokenfile.TokenFileReader(Source(place.read_bytes()))
        whole = np.concatenate(lists)
        for i in draw.permutation(50):
            assert (reader.document(int(i)) == lists[i]).all()
        for a, b in np.sort(draw.integers(0, len(whole), (20, 2)), axis=1):
            assert (reader.ids(int(a), int(b)) == whole[a:b]).all()
        assert reader.nulls[3] and reader.nulls.sum() == 1
    assert tokenfile.width_of(50257) == 16 and tokenfile.width_of(65537) == 17 and tokenfile.width_of(1) == 1


def test_token_files_edges(docs, none):
    found = tokenfile.token_round_trip(docs).toPandas().sort_values("start").reset_index(drop=True)
    assert len(found) == len(TEXTS) and list(found["start"]) == list(np.cumsum([0, *found["n_tokens"]])[:-1])
    ids = [None if np.isnan(i) else int(i) for i in found["doc_id"]]
    assert ids == [None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert tokenfile.token_round_trip(none).count() == 0


def test_fingerprint_edges(docs, none, spark):
    found = fingerprints.fingerprint_pairs(docs).toPandas()
    assert len(found) == len(TEXTS) and (found[found["n_chars"] == 0]["fingerprint"] == "").all()
    same = found[found["doc_id"].isin([1, 2])]
    assert same["fingerprint"].nunique() == 1 and (same["near_next"] == 1).sum() == 2
    assert fingerprints.fingerprint_pairs(none).count() == 0
    alone = fingerprints.fingerprint_pairs(table(spark, [(5, "only this one")])).toPandas()
    assert alone["near_next"][0] == 1.0 and len(alone) == 1


def test_sketches_merge_and_contain():
    small, large = " ".join(f"s{i}" for i in range(300)), " ".join(f"t{i}" for i in range(20_000))
    a, b, both = fingerprints.sketch(small), fingerprints.sketch(large), fingerprints.sketch(small + " " + large)
    merged = fingerprints.merge(a, b)
    assert len(np.setdiff1d(merged, both)) == 0 and fingerprints.likeness(merged, both) > 0.95
    assert fingerprints.containment(a, both) > 0.95 and fingerprints.likeness(a, both) < 0.1
    assert (fingerprints.from_text(fingerprints.to_text(a)) == a).all()
    assert (fingerprints.sketch(large.upper()) == b).all()
    steps = fingerprints._STEP
    fingerprints._STEP = 1000
    try:
        assert (fingerprints.sketch(large) == b).all()  # pieces meet without a gap
    finally:
        fingerprints._STEP = steps


def test_language_edges(docs, none, spark):
    found = langid.identify(docs.withColumn("lang", F.lit("en"))).toPandas()
    assert len(found) == len(TEXTS)
    assert (found[found["doc_id"].isin([3, 4, 5, 6])]["lang_pred"] == "und").all()
    assert (found[found["lang_pred"] == "und"]["score"] == 0).all() and (found[found["doc_id"] == 7]["lang_pred"] == "en").all()
    assert langid.identify(none).count() == 0
    assert set(langid.identify(docs).toPandas()["lang_pred"]) == {"und"}  # nothing to learn from
    assert langid.keep_known(docs.withColumn("lang", F.lit("en"))).columns == docs.columns


def test_cross_parsing_is_greedy():
    draw = random.Random(2)
    samples = {n: "".join(draw.choices(a, k=400)).encode() for n, a in (("p", "abc "), ("q", "bcd "))}
    model = langid.build(samples)
    for _ in range(50):
        text = "".join(draw.choices("abcd z", k=draw.randint(1, 600))).encode()
        found = langid.entropies([text, b"", text], model)
        for column, name in enumerate(model.names):
            phrases = 0
            for at in range(0, len(text), langid.BLOCK):
                block = text[at : at + langid.BLOCK]
                i = 0
                while i < len(block):
                    n = 1
                    while i + n < len(block) and block[i : i + n + 1] in samples[name]:
                        n += 1
                    i += n
                    phrases += 1
            assert found[0, column] == found[2, column] == pytest.approx(phrases * np.log2(400) / len(text))


def test_contamination_edges(spark, docs, none):
    items = spark.createDataFrame(
        [(1, "same old TEXT"), (1, "same old TEXT"), (2, None), (3, ""), (None, "a row"), (4, "word5 and word6 and word7 and word8 and word9 and word10 and"), (5, "rows of this nowhere")],
        "item_id long, text string",
    )
    found = decontaminate.contamination(docs, items).toPandas()
    assert len(found) == len(TEXTS)
    hits = {(None if np.isnan(r["id"]) else int(r["id"])): (r["n_hit"], list(r["items"])) for _, r in found.iterrows()}
    assert hits[1] == hits[2] == (3, ["1"]) and hits[7] == (12, ["4"]) and hits[None][0] == 0 and hits[3] == (0, [])
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(docs, items.where("false")).where("n_hit > 0").count() == 0
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 4


def test_blocks_of_items_and_shards_change_nothing(spark, sf_dir, tmp_path):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = decontaminate.contamination(docs, items).drop("shard", "place").toPandas().sort_values("id")
    index = decontaminate.build_index(docs, str(tmp_path / "index"), shard_words=500)
    parts = decontaminate.search(index, items, block_words=200).drop("shard", "place").toPandas().sort_values("id")
    for name in ("id", "n_words", "n_hit"):
        assert list(whole[name]) == list(parts[name])
    assert [list(x) for x in whole["items"]] == [list(x) for x in parts["items"]]
    assert [list(x) for x in whole["spans"]] == [list(x) for x in parts["spans"]]
    assert all(sum(s["stop"] - s["start"] for s in spans) == n for spans, n in zip(whole["spans"], whole["n_hit"]))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one two filler three four"), (2, "one two three four"), (3, "four three"), (4, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    exact = decontaminate.contamination(docs, items).where("n_hit > 0").toPandas()
    near = decontaminate.contamination(docs, items, slop=1).where("n_hit > 0").toPandas()
    assert list(exact["id"]) == [2] and sorted(near["id"]) == [1, 2]
    with pytest.raises(ValueError):
        decontaminate.contamination(docs, items, slop=decontaminate.GAP)


def test_tokens_in_pieces_are_the_same(monkeypatch):
    text = (LONG + " É" + "x" * 5000 + " end").encode()
    whole = np.concatenate([t.hashes for _, t in words.tokenize([text], decontaminate.WORD_BYTES)])
    monkeypatch.setattr(words.pieces, "__defaults__", (1000,))
    parts = np.concatenate([t.hashes for _, t in words.tokenize([text], decontaminate.WORD_BYTES)])
    assert (whole == parts).all() and len(whole) == 60_002 and len(set(whole.tolist())) == 30_003


def test_url_edges(spark):
    urls = ["http://A.Example.ORG/es/1?x=1&y=2#z", "no scheme", None, "", "x://example.org", "x://example.com/de/", "http://a?b://c.org/", "ftp://badexample.org/es/", "HTTP://EXAMPLE.COM/fr/"]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h"), (None, urls[0], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("label", F.lit(1)).withColumn("host", F.lit("x"))
    found = urlfilter.judge(pages).toPandas()
    assert len(found) == len(rows) and set(found["verdict"]) <= {"allow", "block"}
    by = {int(r.page_id): (r.host, r.path, r.rule, r.verdict) for r in found.dropna(subset=["page_id"]).itertuples()}
    assert by[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and by[1][:3] == ("", "", None)
    assert by[2][:3] == by[3][:3] == ("", "", None) and by[4][:3] == ("example.org", "", None)
    assert by[5] == ("example.com", "/de/", "com/de/", "block") and by[6][:2] == ("a", "") and by[7][2] == "org/"
    assert by[8][2] == "com/fr/"
    assert urlfilter.judge(pages.where("false")).count() == 0
    assert set(urlfilter.judge(pages, rules=[]).toPandas()["verdict"]) == {"allow"}
    only = urlfilter.judge(pages, rules=[("block", "example.org", "/")]).toPandas()
    assert set(only["verdict"]) == {"block"}  # all labels agree
    text = urlfilter.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_chat_edges(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, None, "?"), (2, 0, "system", "alone"), (None, 1, "ann", "x"), (None, 2, "bob", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("start", F.lit(9)).withColumn("part", F.lit("p"))
    found = chat.rotate(turns).toPandas()
    assert len(found) == 5 * 3 + 2 * 2
    for _, view in found.groupby(["conv_id", "perspective"], dropna=False):
        view = view.sort_values("start")
        assert list(view["start"]) == list(np.cumsum([0, *view["rendered"].str.len()])[:-1])
        text = "".join(view["rendered"])
        for row in view[view["part"] == "assistant"].itertuples():
            assert text[int(row.mask_start) : int(row.mask_stop)].endswith(chat.END) and row.speaker == row.perspective
        assert view[view["part"] != "assistant"]["mask_start"].isna().all()
    assert chat.rotate(turns.where("false")).count() == 0


def test_simhash_edges(docs, none):
    found = simhash.near_duplicates(docs).toPandas()
    values = [brute_simhash(t) for _, t in TEXTS]
    assert Counter(int(v) & (2**64 - 1) for v in found["fp"]) == Counter(values)
    by = {int(r.doc_id): r.component_id for r in found.dropna(subset=["doc_id"]).itertuples()}
    assert by[1] == by[2] == 1 and by[3] == by[4] == by[5] == 3
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8, 9, 10] and ids.count(None) == 2


@pytest.mark.parametrize("dense_cell", [simhash.DENSE_CELL, 0])
def test_links_in_dense_clouds(spark, dense_cell):
    draw = np.random.default_rng(5)
    values = set()
    for centre in draw.integers(0, 2**63, 6):
        for _ in range(60):
            value = int(centre)
            for bit in draw.integers(0, 64, draw.integers(0, 6)):
                value ^= 1 << int(bit)
            values.add(value)
    signed = [(int(np.uint64(v).view(np.int64)),) for v in values]
    pairs = simhash.links(spark.createDataFrame(signed, "fp long"), dense_cell=dense_cell, block=16)
    found = {r["node"]: r["root"] for r in simhash.components(pairs).collect()}
    groups, wanted = {}, {}
    for value in values:
        node = int(np.uint64(value).view(np.int64))
        groups.setdefault(found.get(node, node), set()).add(value)
    for value, root in brute_components(values).items():
        wanted.setdefault(root, set()).add(value)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_long_chains_become_one_component(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in simhash.components(chain).collect()} == {0}


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, None), (3, 0, 0), (7, 1, 0), (8, None, 1), (None, 1, 1), (99, 1, 0), (5, 5, 5)], "doc_id long, quality int, toxic int")
    found = quality.score_documents(docs, labels).toPandas()
    assert len(found) == len(TEXTS) and found["score"].between(0, 1).all()
    assert set(quality.score_documents(docs, labels.where("false")).toPandas()["score"]) == {0.5}
    assert set(quality.score_documents(docs, labels.where("quality = 1 and doc_id <> 1")).toPandas()["score"]) == {1.0}
    assert quality.score_documents(none, labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_sharding_edges(spark, docs, none):
    found = sharding.shard_documents(docs, shards=4).toPandas()
    counts = Counter(found["shard"])
    assert len(found) == len(TEXTS) and max(counts.values()) - min(counts.values()) <= 1
    assert (found[found["doc_id"] == 3][["size", "text_crc32"]] == [1, 0]).all(axis=None)
    assert sharding.shard_documents(none).count() == 0


@pytest.mark.parametrize("copies, single", [(700, 100), (100, 700), (400, 0)])
def test_a_group_larger_than_a_shard(spark, copies, single):
    rows = [(i, "copy") for i in range(copies)] + [(copies + i, f"text {i // 2}") for i in range(single)]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    counts = Counter(found["shard"])
    assert len(counts) == 8 and max(counts.values()) - min(counts.values()) <= 1
    assert sorted(found["doc_id"]) == list(range(copies + single))
    assert (found["text_crc32"] == [zlib.crc32(rows[i][1].encode()) for i in found["doc_id"]]).all()


def test_numbering_helper_keeps_null_keys(spark):
    frame = spark.createDataFrame([(None,), (2,), (1,), (None,)], "k long")
    assert sorted(r["internal_id"] for r in dense_ids(frame, "k").collect()) == [0, 1, 2, 3]
