"""SimHash near-duplicates, found by anchor-point covering.

Two 64-bit fingerprints that differ in at most three bits differ in at most one bit in one of their
halves. The anchors of a half are the words of the [31, 26] Hamming code over 31 of its bits, which
cover every word within radius 1 (the last bit is left out of the anchor). A fingerprint has
one home anchor, the nearest; it also visits every anchor within covering radius plus threshold, that
is within 2. If two halves differ in at most one bit, each meets the other at its home anchor. Pairs are
compared on all 64 bits there, per anchor. Anchors where very many meet are compared block by block in
tasks that hand on a spanning forest of the links instead of the links.

Equal fingerprints are one node, so copies cost nothing. Components come from joins: large-star and
small-star rounds until nothing changes. Null and empty texts have fingerprint zero and link like
any other. Rows with a null id belong to a component but never name it. Repeated rows are kept. An
empty table gives no rows; columns other than the two named ones are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweave.llm.rows import field, number_rows
from postweave.llm.words import slices
from postweave.operators.joins import even_join
from postweave.session import cut_lineage, release, scratch_path

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
DENSE_CELL = 250_000  # pairs at one anchor; beyond that it is compared in blocks
BLOCK = 1024
_HASHES = 1 << 15  # shingle hashes whose bits are counted at once
_PARITY = [sum(1 << (p - 1) for p in range(1, 32) if p >> b & 1) for b in range(5)]  # checks of the Hamming code


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if it is set in over half the shingles' XXH64; zero for a text without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # on bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle_words + 1)
    last = ends[-1:] if len(words) < shingle_words else ends[shingle_words - 1 :]
    starts, stops = first[:n].tolist(), last.tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _HASHES):
        spans = zip(starts[at : at + _HASHES], stops[at : at + _HASHES])
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint_udf(shingle_words: int = SHINGLE_WORDS):
    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array((fingerprint(text, shingle_words) for part in slices(texts) for text in part), pa.int64())

    return simhash


def _home(half: Column) -> Column:
    """Nearest word of the Hamming code: the syndrome names the bit to flip (0: none)."""
    syndrome = F.lit(0).cast("long")
    for b, mask in enumerate(_PARITY):
        syndrome = syndrome + F.pmod(F.bit_count(half.bitwiseAND(mask)), F.lit(2)).cast("long") * (1 << b)
    flip = F.when(syndrome > 0, F.expr("1L")).otherwise(F.lit(0).cast("long"))
    return half.bitwiseXOR(F.call_function("shiftleft", flip, F.greatest(syndrome - 1, F.lit(0)).cast("int")))


def _anchors(fps: DataFrame) -> DataFrame:
    """(cell, fp, home): the home anchor and all visited ones, for both halves.

    Words within 2 of a word whose home is h: the homes of the word itself and of the 31 words that
    differ from it in one bit. Those are all anchors within 2, the home among them.
    """
    halves = F.array(
        *[F.struct(F.lit(h).cast("long").alias("half"), F.shiftrightunsigned("fp", 32 * h).bitwiseAND((1 << 31) - 1).alias("word")) for h in (0, 1)]
    )
    words = fps.select("fp", F.explode(halves).alias("h")).select("fp", "h.half", "h.word")
    flips = F.array(*[F.lit(m).cast("long") for m in [0] + [1 << b for b in range(31)]])
    near = words.withColumn("home_word", _home(F.col("word")))
    visited = F.array_distinct(F.transform(flips, lambda m: _home(F.col("word").bitwiseXOR(m))))
    rows = near.select("fp", "half", "home_word", F.explode(visited).alias("anchor"))
    cell = F.col("anchor") * 2 + F.col("half")
    return rows.select(cell.alias("cell"), "fp", (F.col("anchor") == F.col("home_word")).alias("home"))


def _forest(table: pa.Table, max_bits: int) -> pa.Table:
    """Links within one block of an anchor, as a spanning forest."""
    fps = table.column("fp").to_numpy().view(np.uint64)
    home = table.column("home").to_numpy(zero_copy_only=False)
    a, b = np.unique(fps[home]), np.unique(fps[~home])
    nodes = np.unique(np.concatenate((a, b)))
    parent = np.arange(len(nodes))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    places = np.searchsorted(nodes, b)
    for x, i in zip(a, np.searchsorted(nodes, a)):
        for j in places[np.bitwise_count(b ^ x) <= max_bits]:
            p, q = root(int(i)), root(int(j))
            if p != q:
                parent[max(p, q)] = min(p, q)
                edges.append((int(i), int(j)))
    at = np.array(edges, np.int64).reshape(-1, 2)
    return pa.table({"a": nodes[at[:, 0]].view(np.int64), "b": nodes[at[:, 1]].view(np.int64)})


def links(fps: DataFrame, max_bits: int = MAX_BITS, dense_cell: int = DENSE_CELL, block: int = BLOCK) -> DataFrame:
    """Distinct pairs (a < b) that connect all of ``fps`` (distinct ``fp``) linked at ``max_bits`` or fewer."""
    if max_bits > 3:
        raise ValueError("two halves with radius 1 cover three differing bits at most")
    spark = fps.sparkSession
    path = scratch_path(spark, "anchors")
    # each fingerprint becomes about 34 rows, so a few small partitions are dealt out first
    _anchors(fps.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("n"))
    dense = sizes.where(F.col("homes") * F.col("n") > dense_cell)
    any_dense = dense.limit(1).count() > 0
    homes, visits = rows.where("home"), rows.select("cell", F.col("fp").alias("other"))
    if any_dense:
        homes = homes.join(dense.select("cell"), "cell", "left_anti")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits
    met = homes.join(visits, (homes["cell"] == visits["cell"]) & (F.col("fp") != F.col("other")) & near)
    pairs = met.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    if any_dense:
        blocks = F.ceil(F.col("n") / block).cast("int")
        hot = rows.join(dense.select("cell", blocks.alias("blocks")), "cell")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        as_home = hot.where("home").select("cell", "fp", F.lit(True).alias("home"), own.alias("i"), other.alias("j"))
        as_visit = hot.select("cell", "fp", F.lit(False).alias("home"), other.alias("i"), own.alias("j"))
        grouped = as_home.unionByName(as_visit).groupBy("cell", "i", "j")
        forest = grouped.applyInArrow(lambda t: _forest(t, max_bits), "a long, b long")
        pairs = pairs.unionByName(forest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return pairs.distinct()


def components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node reachable. Alternating large-star and small-star rounds.

    A star hands each node's neighbours to the smallest of them. The rows of a hot node meet only in
    a grouped minimum (combined before the shuffle) and in a join that adaptive execution can split.
    """
    edges = cut_lineage(pairs.select("a", "b").distinct())
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        stars = cut_lineage(_star(both, larger=True))
        release(edges)
        edges = cut_lineage(_star(stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), larger=False))
        release(stars)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()
        seen = state
    raise RuntimeError("components did not settle")


def _star(rows: DataFrame, larger: bool) -> DataFrame:
    """Edges (node, its smallest neighbour or itself) for each row's ``b`` (larger ones only, or all)."""
    least = rows.groupBy("a").agg(F.min("b").alias("least"))
    least = least.withColumn("least", F.least("a", "least"))
    joined = even_join(rows, least, "a", "inner")
    if larger:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b"))
        moved = moved.unionByName(joined.select("a", F.col("least").alias("b")))
    return moved.where("a <> b").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id (smallest doc_id reachable)."""
    spark = docs.sparkSession
    path = scratch_path(spark, "simhash")
    simhash = fingerprint_udf(shingle_words)
    docs.select(F.col(id_col).alias("doc_id"), simhash(F.col(text_col)).alias("fp")).write.parquet(path)
    rows = spark.read.parquet(path)
    linked = components(links(rows.select("fp").distinct(), max_bits))
    named = even_join(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), linked.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = even_join(named, smallest, "root", "left").select("fp", "component_id")
    return even_join(rows, by_fp, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component: the one with the smallest id, the first of several; rows without an id come last.

    Rows are judged by their number, so rows without an id and ids that come with several texts are judged
    like others. Columns stay as they are, whatever their names. An empty table stays empty.
    """
    numbered = number_rows(docs)
    found = near_duplicates(numbered.select("_row", field(text_col).alias("text")), "_row", "text", **options)
    marks = cut_lineage(found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("root")))
    marks = even_join(marks, numbered.select("_row", field(id_col).alias("id")), "_row", "inner")
    best = marks.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "_row")).alias("best"))
    gone = even_join(marks, best.select("root", F.col("best._row").alias("best")), "root", "inner").where("_row <> best")
    return numbered.join(gone.select("_row"), "_row", "left_anti").select("_doc.*")
