"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards under quotas."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.common import cut, forget

SHARDS = 16
ROUNDS = 3
#: Lines of fewer characters link nothing.
LINE_CHARS = 20
#: Groups of equal texts of more than this share of a shard are placed before all others; there are at most 8 for each shard.
LARGE_SHARE = 1 / 8
#: Rows that are numbered by one window.
BUCKET_ROWS = 10_000
#: Nodes of a line that are joined with its vote by one task; lines with more are dealt over several keys.
HUB_NODES = 5_000


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    # A null text has no bytes but is no copy of an empty one.
    return docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text, text.isNull()).alias("copy"),
        F.monotonically_increasing_id().alias("at"),  # tells rows apart that share an id; it is written once
    )


def _pick(values: list[int], index: Column) -> Column:
    return F.get(F.array(*[F.lit(int(v)) for v in values]), index)


def _links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, hub, part, parts: nodes that hold a line (hub) which at least one other node holds too; a hub's nodes are dealt over its parts."""
    text = F.col("text").cast("string")
    lines = docs.select(F.xxhash64(text, text.isNull()).alias("copy"), F.explode(F.split(text, "\n")).alias("raw"))
    held = lines.where(F.length("raw") >= LINE_CHARS).select("copy", F.xxhash64("raw").alias("hub")).distinct()
    placed = held.join(nodes.select("copy", "node"), "copy").select("node", "hub")
    shared = placed.groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    # Very common lines are few; their number of nodes is bounded from below, so the table of them is small and may be broadcast.
    hot = shared.where(F.col("n") > HUB_NODES).select("hub", F.ceil(F.col("n") / HUB_NODES).cast("int").alias("parts"))
    rare = shared.where(F.col("n") <= HUB_NODES).select("hub")
    dealt = placed.join(hot, "hub").withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int"))
    single = placed.join(hot, "hub", "left_anti").join(rare, "hub").select("hub", "node", F.lit(1).alias("parts"), F.lit(0).alias("part"))
    return single.unionByName(dealt).select("node", "hub", "part", "parts")


def _allowed(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], float]:
    """Share of each wanted move between shards that keeps sizes: as much as comes back, and what fits the room."""
    share = {}
    for (a, b), n in sorted(wanted.items()):
        back = min(n, wanted.get((b, a), 0))
        extra = max(0, min(n - back, room[b]))
        room[b] -= extra
        room[a] += extra
        share[a, b] = (back + extra) / n
    return share


def _placed_first(large: list[tuple[int, int]], quota: list[int]) -> tuple[dict[int, int], list[int]]:
    """Shards of large nodes (node, rows), the largest first into the emptiest shard, and the room left; one that no shard takes whole has none."""
    room, found = list(quota), {}
    for node, w in sorted(large, key=lambda x: (-x[1], x[0])):
        s = max(range(len(room)), key=lambda i: (room[i], -i))
        if w <= room[s]:
            found[node] = s
            room[s] -= w
    return found, room


def _first_shard(room: list[int]) -> Column:
    """A shard for every other node, drawn by its hash with the shards' room for weights."""
    total, upto, out = max(1, sum(room)), 0, F.lit(len(room) - 1)
    draw, tests = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 30)), []
    for s, n in enumerate(room):
        upto += n
        tests.append((draw * total < F.lit(upto << 30), s))
    for test, s in reversed(tests):
        out = F.when(test, s).otherwise(out)
    return out.cast("int")


def assign(docs: DataFrame, n_shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot; shards' row counts differ by one at most.

    Nodes are groups of equal texts (64-bit hash); only a group of more rows than a shard is several nodes. Large nodes
    are placed first and stay, the largest into the emptiest shard, and the others are drawn round them. Nodes that
    share a line are linked through it: a line votes for the shard where most of its rows are, and a node wants the
    shard with most of its lines' votes. Of each pair of shards as many rows move one way as the other, beyond which
    moves fill free room; which nodes of those move is drawn by a hash. After the rounds the exact quotas are met by
    moving the last rows of overfull shards to the places left: unlinked rows first, then other single ones, so that
    groups stay whole as long as a shard holds any.

    Only counts by shard, and nodes of over LARGE_SHARE of a shard, reach the driver. Null texts are one
    group, of size 1; repeated rows get a place each; null ids are kept; other columns are dropped; an empty table
    gives an empty result.
    """
    rows = cut(_rows(docs), "shard-rows")
    total = rows.count()
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    most = max(1, min(quota))
    whole = rows.groupBy("copy").agg(F.count("*").alias("n")).where(F.col("n") > most).select("copy", F.ceil(F.col("n") / most).cast("int").alias("k"))
    salted = rows.join(F.broadcast(whole), "copy", "left")  # fewer than twice as many as shards
    node = F.when(F.col("k").isNull(), F.col("copy")).otherwise(F.xxhash64("copy", F.pmod(F.xxhash64("doc_id", "at", F.lit(7)), F.col("k"))))
    rows = cut(salted.select("doc_id", "size", "text_crc32", "copy", "at", node.alias("node")), "shard-rows")
    nodes = cut(rows.groupBy("node").agg(F.min("copy").alias("copy"), F.count("*").alias("w")), "shard-nodes")
    large = nodes.where(F.col("w") > max(1, int(total / n_shards * LARGE_SHARE))).select("node", "w").collect()
    first, room = _placed_first([(x["node"], x["w"]) for x in large], quota)
    pinned = docs.sparkSession.createDataFrame(list(first.items()), "node long, own int")
    state = nodes.join(F.broadcast(pinned), "node", "left").select("node", "copy", "w", F.coalesce("own", _first_shard(room)).alias("shard"), F.col("own").isNotNull().alias("pinned"))
    state = cut(state, "shard-state")
    links = cut(_links(docs, state), "shard-links")
    for turn in range(rounds):
        placed = links.join(state.select("node", "shard", "w"), "node")
        votes = placed.groupBy("hub", "parts", "shard").agg(F.sum("w").alias("n")).groupBy("hub", "parts").agg(F.max(F.struct("n", (-F.col("shard")).alias("low"))).alias("top"))
        heard = votes.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), (-F.col("top.low")).alias("to"))
        asked = links.join(heard, ["hub", "part"]).groupBy("node", "to").agg(F.count("*").alias("n"))
        wish = asked.groupBy("node").agg(F.max(F.struct("n", (-F.col("to")).alias("low"))).alias("top")).select("node", (-F.col("top.low")).alias("to"))
        wished = cut(state.join(wish, "node", "left").withColumn("to", F.when(F.col("pinned"), F.col("shard")).otherwise(F.coalesce("to", "shard"))), "shard-wishes")
        flows = wished.groupBy("shard", "to").agg(F.sum("w").alias("n")).collect()
        size = [sum(f["n"] for f in flows if f["shard"] == s) for s in range(n_shards)]
        share = _allowed({(f["shard"], f["to"]): f["n"] for f in flows if f["shard"] != f["to"]}, [q - x for q, x in zip(quota, size, strict=True)])
        if not share:
            break
        table = [[share.get((a, b), 0.0) for b in range(n_shards)] for a in range(n_shards)]
        chance = F.get(F.array(*[F.lit(x) for line in table for x in line]), F.col("shard") * n_shards + F.col("to"))
        draw = F.pmod(F.xxhash64("node", F.lit(100 + turn)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        moved = cut(wished.select("node", "copy", "w", "pinned", F.when(draw < chance, F.col("to")).otherwise(F.col("shard")).alias("shard")), "shard-state")
        forget(state)
        state = moved
    linked = links.select("node").distinct().withColumn("linked", F.lit(True))
    loose = (F.col("w") == 1) & F.col("linked").isNull()
    n_buckets = max(1, ceil(total / n_shards / BUCKET_ROWS))
    # A node of many rows goes to many buckets; its rows stay in its shard all the same.
    own = F.when(F.col("w") > BUCKET_ROWS / 4, F.xxhash64("doc_id", "at", F.lit(2))).otherwise(F.xxhash64("node", F.lit(2)))
    # Groups stand first, so that what is beyond a quota is single rows.
    bucket = F.pmod(own, F.lit(n_buckets)) + F.when(F.col("loose"), 2 * n_buckets).when(F.col("w") == 1, n_buckets).otherwise(0)
    kept = state.join(linked, "node", "left").select("node", "shard", "w", loose.alias("loose"))
    placed = cut(rows.join(kept, "node").withColumn("bucket", bucket).drop("w", "loose", "at"), "shard-placed")
    return _exact(placed, quota)


def _exact(placed: DataFrame, quota: list[int]) -> DataFrame:
    """Number the rows of each shard and move those beyond its quota to the places that others have left."""
    by_shard = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(by_shard), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "bucket").orderBy("node", "doc_id")
    numbered = placed.join(before, ["shard", "bucket"]).withColumn("at", F.col("before") + F.row_number().over(inside) - 1)
    size = [0] * len(quota)
    for x in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        size[x["shard"]] = x["n"]
    over = [max(0, n - q) for n, q in zip(size, quota, strict=True)]
    free = [max(0, q - n) for n, q in zip(size, quota, strict=True)]
    sent = F.col("at") - _pick(quota, F.col("shard")) + _pick([sum(over[:s]) for s in range(len(over))], F.col("shard"))
    target, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in range(len(free)):
        if free[s]:
            first = sum(free[:s])
            own = (F.col("sent") >= first) & (F.col("sent") < first + free[s])
            target, slot = F.when(own, s).otherwise(target), F.when(own, F.col("sent") - first + size[s]).otherwise(slot)
    moved = numbered.withColumn("sent", F.when(F.col("at") >= _pick(quota, F.col("shard")), sent))
    return moved.select("doc_id", "size", "text_crc32", F.coalesce(target, F.col("shard")).cast("int").alias("shard"), F.coalesce(slot, F.col("at")).cast("long").alias("slot"))
