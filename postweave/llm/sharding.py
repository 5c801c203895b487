"""Sharding by balanced label propagation, with row counts at most one apart.

Documents that share a hub (here: equal texts) are linked. Linked documents start in a shard by hash of
their id. In each round a join gives every document its neighbours' shards, summed up per hub, and it
asks to move where most of them are (from the second round on half of the hubs, by hash, ask for their second
shard, so that a shard that all want gives rows away too). Requests are counted per pair of shards and
hash class. As many rows go from one shard to another as come back, and more where the target has room,
so a shard never grows past its share, and full shards swap. They are let in class by class, members of
one hub being in one class; a hub too large for that is spread over classes, so it moves as far as
the quotas let it and the rest stays. Rounds go on until nothing moves, or until the rows outside their
hub's main shard have not become fewer for some rounds; the best round counts. Documents without links
fill the shards up at the end, in order of their id, which makes the counts exact.

Null texts count as empty texts, and equal empty texts are linked like others. Repeated rows are rows
of their own; rows with a null id are placed like others. An empty table gives no rows. Only the two named
columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postweave.operators.joins import even_join
from postweave.operators.ordering import dense_ids
from postweave.session import cut_lineage, scratch_path

SHARDS = 8
STALLED = 3  # rounds without a gain after which propagation ends
CLASSES = 512  # hash classes per pair of shards in which moves are let in
SMALL_HUB = 1000  # rows of a hub that may always be one class
LAW = "rows"


def _pick(key: Column, *salt: Column | int | str) -> Column:
    return F.xxhash64(key, *[s if isinstance(s, Column) else F.lit(s) for s in salt])


def propagate(linked: DataFrame, quota: DataFrame, shards: int, rounds: int | None = None) -> DataFrame:
    """Move (node, hub) rows towards their hub's main shard; ``quota`` has (shard, quota) rows.

    Returns node, hub, shard with at most ``quota`` rows in every shard.
    """
    total = linked.count()
    start = linked.withColumn("shard", F.pmod(_pick(F.col("node"), "start"), F.lit(shards)).cast("int"))
    state = cut_lineage(start)
    held = state.groupBy("shard").agg(F.count("*").alias("held"))
    if held.join(quota, "shard").where("held > quota").limit(1).count():  # hash starts are even, not exactly so
        state = cut_lineage(_within_quota(state, quota))
    best, least, stalled, turn = state, None, 0, 0
    while total:
        sizes = state.groupBy("hub", "shard").agg(F.count("*").alias("members"))
        order = Window.partitionBy("hub").orderBy(F.desc("members"), _pick(F.col("hub"), F.col("shard")))
        ranked = sizes.withColumn("rank", F.row_number().over(order))
        hubs = ranked.groupBy("hub").agg(
            F.sum("members").alias("hub_rows"), F.max("members").alias("main_rows"),
            F.min_by("shard", "rank").alias("main"), F.max_by("shard", F.when(F.col("rank") <= 2, F.col("rank"))).alias("second"),
        )
        hubs = cut_lineage(hubs)
        outside = hubs.agg(F.sum(F.col("hub_rows") - F.col("main_rows"))).first()[0]
        gained = least is None or outside < least
        best, least, stalled = (state, outside, 0) if gained else (best, least, stalled + 1)
        if not outside or stalled >= STALLED or turn == rounds:
            break
        wide = (F.col("hub_rows") * shards * 64 > total) & (F.col("hub_rows") > SMALL_HUB)  # a class must be small against a quota
        group = F.when(wide, _pick(F.col("hub"), F.col("node"), turn)).otherwise(_pick(F.col("hub"), turn))
        other = ~wide & (F.pmod(_pick(F.col("hub"), turn, "second"), F.lit(2)) == 0) & F.lit(turn > 0)
        asked = even_join(state, hubs, "hub", "inner").withColumn("target", F.when(other, F.col("second")).otherwise(F.col("main")))
        asked = asked.select("node", "hub", "shard", "target", F.pmod(group, F.lit(CLASSES)).cast("int").alias("class"))
        allowed = _allowed(asked.where("target <> shard"), state, quota)
        decided = cut_lineage(asked.join(F.broadcast(allowed), ["shard", "target", "class"], "left"))
        cut = decided.where("take < wants")  # one class of a pair of shards at most
        place = F.row_number().over(Window.partitionBy("shard", "target").orderBy("hub", "node"))
        cut = cut.withColumn("moves", place <= F.col("take"))
        moved = decided.where("take is null or take = wants").withColumn("moves", F.col("take").isNotNull()).unionByName(cut)
        state = cut_lineage(moved.select("node", "hub", F.when(F.col("moves"), F.col("target")).otherwise(F.col("shard")).alias("shard")))
        turn += 1
    return best


def _allowed(asked: DataFrame, state: DataFrame, quota: DataFrame) -> DataFrame:
    """(shard, target, class, wants, take): how many of the rows that ask are let in, whole classes but the last.

    Between two shards as many as come back, and what is left while the target has room.
    """
    wants = cut_lineage(asked.groupBy("shard", "target", "class").agg(F.count("*").alias("wants")))
    flows = wants.groupBy("shard", "target").agg(F.sum("wants").alias("flow"))
    back = flows.select(F.col("target").alias("shard"), F.col("shard").alias("target"), F.col("flow").alias("back"))
    held = state.groupBy("shard").agg(F.count("*").alias("held"))
    room = quota.join(held, "shard", "left").select(F.col("shard").alias("target"), (F.col("quota") - F.coalesce("held", F.lit(0))).alias("room"))
    flows = flows.join(back, ["shard", "target"], "left").join(room, "target")
    flows = flows.withColumn("matched", F.least("flow", F.coalesce("back", F.lit(0)))).withColumn("rest", F.col("flow") - F.col("matched"))
    free = F.col("room") - (F.sum("rest").over(Window.partitionBy("target").orderBy("shard")) - F.col("rest"))
    flows = flows.select("shard", "target", (F.col("matched") + F.greatest(F.lit(0), F.least("rest", free))).alias("limit"))
    running = Window.partitionBy("shard", "target").orderBy("class")  # at most CLASSES rows a pair
    upto = wants.withColumn("before", F.sum("wants").over(running) - F.col("wants")).join(flows, ["shard", "target"])
    take = F.least("wants", F.col("limit") - F.col("before"))
    return upto.select("shard", "target", "class", "wants", take.alias("take")).where("take > 0")


def _within_quota(rows: DataFrame, quota: DataFrame) -> DataFrame:
    """Rows beyond a shard's quota go to shards with room, by their number in the overflow."""
    placed = _numbered(rows, "shard", "place", "hub", "node")
    checked = placed.join(F.broadcast(quota), "shard")
    held = checked.groupBy("shard").agg(F.count("*").alias("held"))
    room = quota.join(held, "shard", "left").withColumn("room", F.greatest(F.col("quota") - F.coalesce("held", F.lit(0)), F.lit(0)))
    kept = checked.where("place < quota").select("node", "hub", "shard")
    over = dense_ids(checked.where("place >= quota").select("node", "hub"), "hub", "node", name="place")
    return kept.unionByName(_fill(over, room.select("shard", "room")).select("node", "hub", "shard"))


def _numbered(rows: DataFrame, key: str, name: str, *order: str) -> DataFrame:
    """Number the rows of each key gapless from 0; the key has few values."""
    numbered = dense_ids(rows, key, *order, name="_all")
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)  # one row per key
    counts = numbered.groupBy(key).agg(F.count("*").alias("_n"))
    bases = counts.select(key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return numbered.join(F.broadcast(bases), key).withColumn(name, F.col("_all") - F.col("_base")).drop("_all", "_base")


def _fill(rows: DataFrame, room: DataFrame) -> DataFrame:
    """Give numbered rows (``place``) the shards with room, one after the other."""
    upto = Window.orderBy("shard")  # one row per shard
    spans = room.withColumn("stop", F.sum("room").over(upto)).withColumn("begin", F.col("stop") - F.col("room"))
    spans = F.broadcast(spans.where("room > 0").select("shard", "begin", "stop"))
    return rows.join(spans, (F.col("place") >= F.col("begin")) & (F.col("place") < F.col("stop")))


def shard_rows(rows: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """Add ``shard`` to rows with a unique ``node`` and a ``hub`` that links rows."""
    spark = rows.sparkSession
    sizes = rows.groupBy("hub").agg(F.count("*").alias("hub_size"))
    marked = even_join(rows, sizes, "hub", "inner")
    path = scratch_path(spark, "linked")
    marked.write.parquet(path)
    marked = spark.read.parquet(path)
    total = marked.count()
    number = F.col("id")
    quota = spark.range(shards).select(number.cast("int").alias("shard"), (F.lit(total // shards) + (number < total % shards).cast("long")).alias("quota"))
    linked = propagate(marked.where("hub_size > 1").select("node", "hub"), quota, shards, rounds)
    held = linked.groupBy("shard").agg(F.count("*").alias("held"))
    room = quota.join(held, "shard", "left").select("shard", (F.col("quota") - F.coalesce("held", F.lit(0))).alias("room"))
    single = dense_ids(marked.where("hub_size = 1").select("node"), "node", name="place")
    placed = linked.select("node", "shard").unionByName(_fill(single, room).select("node", "shard"))
    return marked.drop("hub_size").join(placed, "node")


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard (null)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    path = scratch_path(spark, "sizes")
    docs.select(
        F.monotonically_increasing_id().alias("node"),
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("hub"),
    ).write.parquet(path)
    placed = shard_rows(spark.read.parquet(path), shards, rounds)
    slots = _numbered(placed.drop("hub"), "shard", "slot", "doc_id", "node")
    return slots.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
