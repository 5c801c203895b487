"""What the review of round two found: near copies, full shards, special tokens, rows without an id."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_llm_queries import brute_components, brute_simhash

import corpus_pipeline
from postweave.llm import decontaminate, sharding, simhash, tokens


def near_copies():
    draw = np.random.default_rng(3)
    texts = [None, "", " \n", "One two", "one  TWO", "Ünï cödé \x00 a"]
    for size, copies in ((12, 6), (300, 12), (3000, 12)):
        base = [f"w{x}" for x in draw.integers(0, 5000, size)]
        for _ in range(copies):
            words = list(base)
            for at in draw.integers(0, size, draw.integers(0, 1 + size // 100)):
                words[at] = f"v{draw.integers(0, 5000)}"
            texts.append(" ".join(words))
    return texts + [" ".join(f"u{x}" for x in draw.integers(0, 5000, 50)) for _ in range(20)]


def test_the_stage_keeps_one_of_each_component(spark):
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "").toPandas()
    values = [brute_simhash(t) for t in texts]
    roots, least = brute_components(set(values)), {}
    for i, value in enumerate(values):
        least.setdefault(roots[value], i)
    assert 20 < len(least) < len(texts) - 15
    assert sorted(kept["doc_id"]) == sorted(least.values())


def test_near_copies_without_an_id_or_with_a_shared_one(spark):
    text, other = "a b c d e f g h", "quite another text of seven words"
    rows = [(None, text), (None, text), (7, other), (7, text), (7, "a third text that is like neither")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted(rows[2:])


def test_the_stage_on_no_rows_very_long_texts_and_clashing_names(spark):
    kind = "doc_id long, _row long, _doc string, node long, text string"
    assert simhash.keep_one(spark.createDataFrame([], kind)).collect() == []
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(300_000))
    rows = [(1, 555, "p", 9, long), (2, 666, "q", 9, long + " "), (3, 777, "r", 9, "short"), (4, 888, None, 9, None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, kind)).collect()
    assert sorted(tuple(r) for r in kept) == [rows[0], rows[2], rows[3]]
    items = spark.createDataFrame([("i", "short")], "item_id string, text string")
    kept = decontaminate.drop_contaminated(spark.createDataFrame(rows, kind), items).collect()
    assert sorted(tuple(r) for r in kept) == [rows[0], rows[1], rows[3]]


def test_added_tokens_get_the_ids_of_a_default_tokenizer():
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    plain, encoder = Tokenizer.from_file(path), tokens.CachedEncoder(path)
    for text in ("one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>b\n<|endoftext|> <|endoftext", "one two three", "x y<|endoftext|>", "x\n<|endoftext|>"):
        assert list(np.frombuffer(encoder.encode(text), "<u4")) == plain.encode(text, add_special_tokens=False).ids
    assert len(encoder.encode("one <|endoftext|> two")) == 4 * 4


def test_contaminated_rows_go_whatever_their_id(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(None, f"x {item} y"), (None, "a clean row"), (1, item), (1, "another clean row"), (2, "clean")]
    items = spark.createDataFrame([("i", item)], "item_id string, text string")
    kept = decontaminate.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([rows[1], rows[3], rows[4]])


def test_groups_stay_whole_where_every_row_has_a_copy(spark):
    size = 10
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.floor(F.col("id") / size)).alias("text"))
    found = sharding.shard_documents(docs, rounds=5).toPandas()
    assert set(Counter(found["shard"])) == set(range(8)) and set(Counter(found["shard"]).values()) == {1000}
    assert (found.groupby(found["doc_id"] // size)["shard"].nunique() == 1).mean() > 0.9


def test_a_long_item_in_stretches_hits_what_it_hits_whole(spark):
    draw = np.random.default_rng(8)
    words = [f"w{x}" for x in draw.integers(0, 40, 400)]
    item = " ".join(words)
    texts = [" ".join(words[a : a + n]) for a, n in ((0, 400), (3, 10), (24, 12), (388, 12), (390, 9), (49, 30))] + [" ".join(words[::-1]), None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([("long", item), ("short", "w1 w2")], "item_id string, text string")
    index = decontaminate.build_index(docs, f"{decontaminate.scratch_path(spark, 'postings')}")
    rows = lambda **o: sorted((r["id"], r["n_hit"], str(r["items"]), str(r["spans"])) for r in decontaminate.search(index, items, **o).collect())
    whole = rows()
    assert rows(block_words=200) == rows(block_words=120) == whole and whole[0][1] == 400 and whole[4][1] <= 2
