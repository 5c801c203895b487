"""Token counts, phrases and periodic runs against the tokenizer, SQL and brute force, with their edges."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from check_oracle import compare
from conftest import SF_DIR
from pyspark.sql import functions as F

from postweave.llm import phrases, runs, tokencount, tokens
from postweave.llm.queries import QUERIES


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def test_token_counts(spark, documents, tokenizer):
    found = QUERIES["op11_token_counts"](spark, SF_DIR).toPandas().sort_values("doc_id")
    counts = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in documents["text"]]
    assert list(found["n_tokens"]) == counts and list(found["over_limit"]) == [n > 512 for n in counts]
    assert list(found["n_bytes"]) == [len(t.encode()) for t in documents["text"]]


PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "\r", "é", "中", "😀", "ing", "'s", "1", "23", ".", ",", "<|endoftext|>", "\0", " ", "՘", " ", "\x1f", "_"]


def test_counts_of_random_texts(tokenizer):
    draw = random.Random(5)
    counter = tokencount.TokenCounter(tokens.default_tokenizer(), cache_entries=50)
    for _ in range(4000):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randrange(25)))
        assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), repr(text)
    assert len(counter.young) <= 50 and len(counter.young_pieces) <= 50


def test_ids_of_random_texts(tokenizer):
    draw = random.Random(6)
    encoder = tokens.CachedEncoder(tokens.default_tokenizer(), cache_entries=50)
    for _ in range(4000):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randrange(25)))
        assert list(np.frombuffer(encoder.encode(text), "<u4")) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_count_edges(spark, tokenizer):
    long = "ab" * 50_000 + " word" * 50_000
    rows = [(1, None, 0), (2, "", 0), (None, "one two", 7), (None, "one two", 7), (3, long, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")  # a column with a result's name
    found = tokencount.document_tokens(docs).collect()
    expected = [(i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
    assert Counter(tuple(r)[:3] for r in found) == Counter(expected)
    assert tokencount.document_tokens(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        tokencount.TokenCounter(tokens.default_tokenizer().replace("byte_bpe_50k", "word_bpe_49k"))


def brute_phrases(rows, least, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        by_lang = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, 5):
                by_lang.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    found = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        scored = []
        for p, a in frequent.items():
            if any(
                100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in frequent.items() if len(q) > len(p)
            ):
                continue
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            found.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(found)


def phrase_rows(seed, n=400):
    draw = random.Random(seed)
    words = ["a", "B", "the", "über", "x1", "new\0", "york", "c", "d", "e"]
    rows = [(None, None), ("en", ""), ("en", " .,;\t\n "), ("und", "the the the"), (None, "the the")]
    for _ in range(n):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!"]) for _ in range(draw.randrange(30)))
        rows.append((draw.choice(["en", "de", None]), text))
    return rows + [("de", "new york new york city of new york")] * 40


@pytest.mark.parametrize("shards, least, map_bits, flush", [(3, 10, 1 << 20, 1 << 20), (1, 5, 1 << 15, 200), (5, 8, 1 << 15, 50)])
def test_phrases_equal_brute_force(spark, monkeypatch, shards, least, map_bits, flush):
    monkeypatch.setattr(phrases, "_FLUSH_WORDS", flush)
    monkeypatch.setattr(phrases, "_STRETCH", 40)
    rows = phrase_rows(shards)
    docs = spark.createDataFrame([(*r, "n") for r in rows], "lang string, text string, n string").repartition(4)
    found = phrases.collocations(docs, least=least, top=25, shards=shards, map_bits=map_bits).collect()
    expected = brute_phrases(rows, least, 25)
    assert len(expected) > 20 and sorted(tuple(r) for r in found) == expected


def test_bits_of_several_phrases_change_no_count(spark, monkeypatch):
    """All bits set: every phrase is opened early and never closed, as in a map that is full."""
    monkeypatch.setattr(phrases, "_bit_map", lambda rows, bits: np.full(bits // 8, 255 if rows.limit(1).count() else 0, np.uint8))
    rows = phrase_rows(11, 150)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    found = phrases.collocations(docs, least=10, top=40, shards=2, map_bits=1 << 15).collect()
    assert sorted(tuple(r) for r in found) == brute_phrases(rows, 10, 40)


def test_phrases_of_no_rows_and_products_beyond_64_bits(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string"), map_bits=1 << 15).collect() == []
    big = 1 << 62
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big), ("en", "", 0, big)], "lang string, phrase string, words int, n long")
    original, phrases.count_phrases = phrases.count_phrases, lambda *a, **k: counts
    try:
        (row,) = phrases.collocations(counts).collect()
    finally:
        phrases.count_phrases = original
    assert (row["score"], row["a"], row["l"], row["r"]) == (1_000_000, big, big, big)


def brute_runs(x, exponent=4, least=6):
    n, found = len(x), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            w = x[i : i + length]
            if j > i and length >= max(least, exponent * q) and not any(w[r:] == w[: len(w) - r] for r in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("exponent, least", [(4, 6), (2, 2), (3, 1)])
def test_runs_equal_brute_force(exponent, least):
    draw = random.Random(exponent)
    total = 0
    for _ in range(1500):
        n, kinds = draw.randrange(70), draw.choice([1, 2, 3, 5])
        x = [draw.randrange(kinds) for _ in range(n)]
        if n and draw.random() < 0.6:
            start, period = draw.randrange(n), draw.randint(1, 12)
            x = [x[i] if i < start else x[start + (i - start) % period] for i in range(n)]
        expected = brute_runs(x, exponent, least)
        total += len(expected)
        assert runs.find_runs(np.array(x, np.int64), exponent, least) == expected
        assert list(runs.stretch_runs(x, exponent)) == [] or exponent > 2 or least > 2 or len(expected) > 0
    assert total > 300


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    numbers = {}
    found = brute_runs([numbers.setdefault(w, len(numbers)) for w in words])
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_periodic_runs(spark, documents):
    some = documents[documents["text"].str.len() < 6000]  # brute force takes the square of the words
    found = QUERIES["op13_periodic_runs"](spark, SF_DIR).collect()
    expected = {d.doc_id: brute_row(d.doc_id, d.text) for d in some.itertuples()}
    assert len(found) == len(documents) and sum(r["n_runs"] > 0 for r in found) > 5
    assert all(tuple(r) == expected[r["doc_id"]] for r in found if r["doc_id"] in expected)


def test_run_edges(spark):
    long = " ".join(f"w{i % 1000}" for i in range(30_000)) + " end " + "z " * 20_000 + " ".join(f"u{i * i % 7919}" for i in range(30_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (None, "a b " * 4, "x"), (None, "a b " * 4, "x"), (7, long, "x"), (8, "A a A a A a A a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs string")
    found = runs.document_runs(docs).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == 7 and all(by_id[i]["n_runs"] == 0 and by_id[i]["start"] is None and by_id[i]["collapsed"] == "" for i in (1, 2, 3))
    assert by_id[None]["collapsed"] == "a b" and by_id[8]["collapsed"] == "A a" and by_id[8]["exponent_milli"] == 4000
    assert [tuple(r) for r in by_id[7]["runs"]] == [(0, 30_000, 1000), (30_001, 20_000, 1)]
    assert (by_id[7]["start"], by_id[7]["period"], by_id[7]["exponent_milli"]) == (30_001, 1, 20_000_000)
    assert runs.document_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        runs.document_runs(docs, exponent=1)


def test_planted_repetitions_follow_the_id():
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    assert ids and all(runs.planted(50, i) is not None for i in ids)
    assert runs.planted(50, None) is None and runs.planted(0, ids[0]) is None


def test_collocations_equal_sql_on_skewed_rows(spark):
    """One text that holds most rows."""
    import duckdb

    hot = spark.range(3000).select(F.lit("en").alias("lang"), F.lit("Hot words meet, hot words meet often").alias("text"))
    docs = hot.unionByName(spark.createDataFrame(phrase_rows(2, 100), "lang string, text string"))
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert compare(phrases.collocations(docs, map_bits=1 << 16), con, phrases.SQL) is None


def test_word_vectors_equal_sums_by_hand(spark):
    from postweave.llm import quality

    texts = [None, "", "One two, two! three\nfour", "two three Two", "alone"] + ["word " * 30] * 3
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, sums string").repartition(3)
    index = quality.index_vectors().astype(float)
    sums = np.zeros_like(index)
    pools = []
    for text in texts:
        read = [(w, quality.WORDS + s) for _, words, shapes in quality._read([text]) for w, s in zip(words.tolist(), shapes.tolist())]
        own = [index[w] + index[s] for w, s in read]
        for i, keys in enumerate(read):
            around = sum((own[j] for j in range(max(0, i - quality.REACH), min(len(read), i + quality.REACH + 1)) if j != i), np.zeros(quality.DIM))
            for key in keys:
                sums[key] += around
        pools.append(read)
    expected = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)
    found = quality.word_vectors(docs)
    assert np.allclose(found, expected, atol=1e-5) and np.abs(found).sum() > 0
    words, shapes = found[: quality.WORDS], found[quality.WORDS :]
    by_hand = [
        np.concatenate([np.mean([words[w] for w, _ in read], axis=0), np.mean([shapes[s - quality.WORDS] for _, s in read], axis=0)])
        if read else np.zeros(2 * quality.DIM) for read in pools
    ]
    assert np.allclose(quality.pooled(texts, words, shapes), by_hand, atol=1e-4)
    assert not quality.word_vectors(docs.limit(0)).any()


def test_languages_are_learned_from_rows_with_letters(spark):
    from postweave.llm import langid

    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, None if i % 3 else " 12 ", "xx") for i in ids[:200]]  # most rows of a language say nothing
    rows += [(i, "zaz zuz zozo zizi " * 20, "xx") for i in ids[200:204]] + [(i, "bab bub bobo " * 30, "yy") for i in ids[204:240]]
    rows += [(i, None, "none") for i in ids[240:260]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, sample_rows=5, sample_bytes=400)
    assert model.names == ["xx", "yy"]
    names, _, _ = langid.judge(["zozo zuz zizi", "bobo bub bab", "123", None], model)
    assert names == ["xx", "yy", "und", "und"]
    assert list(langid._shares(np.array([10, 500, 30, 500]), 400)) == [10, 180, 30, 180]
    assert langid.fit(docs.limit(0)).names == []


def test_url_trees_judge_hosts_that_no_rule_names(spark):
    """The rules know four hosts; the trees have to tell the same two kinds of URL apart elsewhere."""
    from postweave.llm import urlfilter

    draw = random.Random(12)
    word = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    plain = lambda host: f"https://{host}/{word(5)}/{word(7)}"
    loud = lambda host: f"https://{host}/{draw.randrange(10**9)}/{word(3)}?id={draw.randrange(10**8)}&s={draw.randrange(10**6)}&r={word(12)}"
    urls = [plain(h) for h in ("good.test", "www.fine.test") for _ in range(150)] + [loud(h) for h in ("bad.test", "x.worse.test") for _ in range(150)]
    held = [(plain(f"{word(6)}.test"), "allow") for _ in range(100)] + [(loud(f"{word(6)}.test"), "block") for _ in range(100)]
    rules = [("allow", "good.test", "/"), ("allow", "fine.test", "/"), ("block", "bad.test", "/"), ("block", "worse.test", "/")]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls + [u for u, _ in held])], "page_id long, url string, verdict string")
    found = {r["page_id"]: r for r in urlfilter.judge(pages, rules).collect()}
    assert all(found[i]["verdict"] == ("allow" if i < 300 else "block") and found[i]["rule"] for i in range(600))
    right = [found[600 + i]["verdict"] == verdict and found[600 + i]["rule"] is None for i, (_, verdict) in enumerate(held)]
    assert sum(right) >= 190
