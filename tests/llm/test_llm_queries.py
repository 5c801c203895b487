"""The registered training-data queries on the smallest data: SQL where there is some, else brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from check_oracle import compare, connect
from conftest import SF_DIR

import __spark_entry__ as contract
import corpus_pipeline
from postweave.llm import packing, simhash, tokenfile, tokens, urlfilter
from postweave.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) is None


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing_is_a_partition_into_powers_of_two(spark, documents, tokenizer):
    found = QUERIES["op1_packing"](spark, SF_DIR).toPandas()
    by_doc = dict(list(found.groupby("doc_id")))
    for doc in documents.itertuples():
        ids = ids_of(tokenizer, doc.text, packing.END_ID)
        rows = by_doc[doc.doc_id].sort_values("start")
        assert (rows["doc_tokens"] == len(ids)).all() and rows["length"].sum() == len(ids)
        assert list(rows["start"]) == list(np.cumsum([0, *rows["length"]])[:-1])
        for row in rows.itertuples():
            assert row.length <= 2048 and row.length & (row.length - 1) == 0
            assert row.ids_crc32 == zlib.crc32(ids[row.start : row.start + row.length].tobytes())
    assert sorted(found["sequence_id"]) == list(range(len(found))) and (found["offset"] == 0).all()
    assert found.sort_values("sequence_id")["length"].is_monotonic_increasing


def test_fingerprints(spark, documents):
    found = QUERIES["op2_fingerprints"](spark, SF_DIR).toPandas().sort_values("doc_id")
    texts = list(documents["text"])
    follow = texts[1:] + texts[:1]
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, follow)]
    assert list(found["n_chars"]) == [len(t) for t in texts]
    assert list(found["edited_sha256"]) == [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    prints = defaultdict(set)
    for text, value in [*zip(texts, found["fingerprint"]), *zip(edited, found["edited_fingerprint"])]:
        prints[text].add(value)
    assert all(len(v) == 1 for v in prints.values())

    def shingles(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        return {low[i : i + 16] for i in range(max(1, len(low) - 15))}

    def jaccard(a, b):
        return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))

    errors = [abs(e - jaccard(a, b)) for a, b, e in zip(texts, edited, found["near_edited"])]
    assert np.mean(errors) < 0.06 and found["near_next"].between(0, 1).all()


def test_language(spark, documents):
    found = QUERIES["op3_language_id"](spark, SF_DIR).toPandas().merge(documents, on="doc_id")
    held = found[found["held_out"]]
    assert list(found["held_out"]) == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found["doc_id"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97 and found["score"].between(0, 1).all()


def test_token_files(spark, documents, tokenizer):
    found = QUERIES["op4_token_files"](spark, SF_DIR).toPandas().sort_values("doc_id")
    ids = [ids_of(tokenizer, t, tokenfile.END_ID) for t in documents["text"]]
    assert list(found["n_tokens"]) == [len(x) for x in ids]
    assert list(found["start"]) == list(np.cumsum([0, *map(len, ids)])[:-1])
    assert list(found["ids_crc32"]) == [zlib.crc32(x.tobytes()) for x in ids]


def brute_url(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in urlfilter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


def test_url_filter(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url").toPandas()
    found = QUERIES["op6_url_filter"](spark, SF_DIR).toPandas().merge(pages, on="page_id")
    assert len(found) == len(pages)
    for row in found.itertuples():
        host, path, rule, verdict = brute_url(row.url)
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == verdict if rule else row.verdict in ("allow", "block")


def brute_components(values, max_bits=simhash.MAX_BITS):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    nodes = sorted(parent)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if bin(a ^ b).count("1") <= max_bits:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in nodes}


def brute_simhash(text):
    from xxhash import xxh64_intdigest

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, documents):
    found = QUERIES["op8_simhash"](spark, SF_DIR).toPandas().sort_values("doc_id")
    values = [brute_simhash(t) for t in documents["text"]]
    assert list(found["fingerprint"]) == [f"{v:016x}" for v in values]
    roots = brute_components(values)
    least = {}
    for doc_id, value in zip(documents["doc_id"], values):
        least[roots[value]] = min(least.get(roots[value], doc_id), doc_id)
    assert list(found["component_id"]) == [least[roots[v]] for v in values]


def test_quality(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").toPandas()
    found = QUERIES["op9_quality"](spark, SF_DIR).toPandas()
    assert len(found) == 200 and found["score"].between(0, 1).all()
    assert (found["predicted"] == (found["score"] >= 0.5)).all()
    held = found[found["held_out"]].merge(labels, on="doc_id")
    assert (held["predicted"] == held["quality"]).mean() > 0.85


def test_sharding(spark, documents):
    found = QUERIES["op10_sharding"](spark, SF_DIR).toPandas().merge(documents, on="doc_id")
    assert list(found["size"]) == [len(t.encode()) + 1 for t in found["text"]]
    assert list(found["text_crc32"]) == [zlib.crc32(t.encode()) for t in found["text"]]
    counts = Counter(found["shard"])
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, rows in found.groupby("shard"):
        assert sorted(rows["slot"]) == list(range(len(rows)))
    groups = found.groupby("text")["shard"].agg(["size", "nunique"])
    linked = groups[groups["size"] > 1]
    assert (linked["nunique"] == 1).mean() > 0.8


def test_pipeline_equals_its_stages_by_hand(spark, documents):
    found = corpus_pipeline.run(spark, SF_DIR).toPandas()
    good = QUERIES["op9_quality"](spark, SF_DIR).where("predicted = 1").select("doc_id").toPandas()
    kept = documents[documents["doc_id"].isin(good["doc_id"])]
    # this table has only texts in the learned languages; the near-duplicates are those of the texts left
    values = {d.doc_id: brute_simhash(d.text) for d in kept.itertuples()}
    roots, least = brute_components(set(values.values())), {}
    for doc_id, value in sorted(values.items()):
        least.setdefault(roots[value], doc_id)
    hit = QUERIES["op5_decontaminate"](spark, SF_DIR).where("contaminated").toPandas()["doc_id"]
    assert set(found["doc_id"]) == set(least.values()) - set(hit)
    whole = QUERIES["op1_packing"](spark, SF_DIR).toPandas()
    whole = whole[whole["doc_id"].isin(found["doc_id"])]
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert Counter(found[columns].itertuples(index=False, name=None)) == Counter(whole[columns].itertuples(index=False, name=None))


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns
