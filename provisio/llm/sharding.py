"""Sharding by balanced label propagation: linked texts move towards their neighbours' shards under quotas; counts end at most one apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, staged

#: Lines of at least so many characters link the documents that hold them (the parameter link_chars of assign()).
LINK_CHARS = 40
#: Rounds of propagation; in each, half of the nodes may move.
ROUNDS = 4
#: Rounds before that in which nodes take up labels without quotas, so that those of a community begin on one shard.
SEED_ROUNDS = 3
#: A shard may be over its quota by so much while labels move; the last step makes counts even.
SLACK = 0.1
#: A group of equal texts stays whole up to this share of a shard; a larger one is cut into as few parts as keep to it.
PART = 0.75
#: Nodes of at least 1 / LARGE of all rows (at most LARGE of them) are placed first, largest first, each on the emptiest shard.
LARGE = 1024
GAIN_BINS = 32


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("group"),
    )


def _part(parts: Column) -> Column:
    return F.when(parts > 1, F.pmod(F.xxhash64("doc_id", F.lit(7)), parts)).otherwise(F.lit(0))


def _nodes(rows: DataFrame, n_rows: int, shards: int) -> DataFrame:
    """rows with their node: the group of equal texts, or a part of a group too large for a shard."""
    most = max(1.0, PART * n_rows / shards)
    # groups larger than most are fewer than shards / PART, so the table may be broadcast
    large = rows.groupBy("group").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("group", F.ceil(F.col("_n") / most).alias("_parts"))
    cut = rows.join(F.broadcast(large), "group", "left")
    return cut.withColumn("node", F.xxhash64("group", _part(F.coalesce("_parts", F.lit(1))))).drop("_parts")


def _place_large(nodes: DataFrame, n_rows: int, shards: int) -> list[tuple[int, int]]:
    load, placed = [0] * shards, []
    for r in nodes.where(F.col("n") * LARGE >= n_rows).where("n > 1").orderBy(F.desc("n"), "node").limit(LARGE).collect():
        to = min(range(shards), key=lambda s: (load[s], s))
        load[to] += r["n"]
        placed.append((r["node"], to))
    return placed


def _seeds(links: DataFrame, sizes: DataFrame, most: float) -> DataFrame:
    """node, anchor: label propagation without quotas. A node begins with its rarest link as label, and takes up the least label of the nodes it is linked with, unless
    that label's nodes would then have more than most rows. Links of more nodes than that pass no label on."""
    labels = staged(links.groupBy("node").agg(F.min_by("key", F.struct("_k", "key")).alias("anchor")).join(sizes, "node"), "seeds")
    own = links.where(F.col("_k") <= most).select("node", "key")
    for _ in range(SEED_ROUNDS):
        least = own.join(labels, "node").groupBy("key").agg(F.min("anchor").alias("_a"))
        new = staged(labels.join(own.join(least, "key").groupBy("node").agg(F.min("_a").alias("_a")), "node", "left").withColumn("_a", F.coalesce("_a", "anchor")), "seeds")
        large = new.groupBy("_a").agg(F.sum("n").alias("_n")).where(F.col("_n") > most).select("_a", F.lit(True).alias("_large"))  # fewer than rows / most
        last, labels = labels, staged(new.join(F.broadcast(large), "_a", "left").select("node", "n", F.when(F.col("_large"), F.col("anchor")).otherwise(F.col("_a")).alias("anchor")), "seeds")
        drop_staged(last, new)
    return labels.select("node", "anchor")


def _propagate(labels: DataFrame, links: DataFrame, n_rows: int, shards: int, turn: int) -> DataFrame:
    """One round: node, n, shard after the moves that quotas allow."""
    each = [f"w{s}" for s in range(shards)]
    own = links.join(labels, "node")
    # a key's rows by shard, one wide row a key: a key held by a third of all documents is counted before it moves
    keys = own.groupBy("key").agg(F.sum("n").alias("_all"), *[F.sum(F.when(F.col("shard") == s, F.col("n")).otherwise(0)).alias(w) for s, w in enumerate(each)])
    votes = own.join(keys, "key").groupBy("node").agg(*[F.sum((F.col(w) - F.when(F.col("shard") == s, F.col("n")).otherwise(0)) / F.col("_all")).alias(w) for s, w in enumerate(each)])
    state = labels.join(votes, "node", "left").withColumn("_v", F.array(*[F.coalesce(w, F.lit(0.0)) for w in each])).withColumn("_best", F.array_max("_v"))
    gain = F.col("_best") - F.get("_v", F.col("shard"))
    moving = (gain > 1e-9) & (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0)
    target = (F.array_position("_v", F.col("_best")) - 1).cast("int")
    bin_ = F.least(F.lit(GAIN_BINS - 1), F.floor(F.log2(1 + 64 * gain) * 3)).cast("int")
    state = staged(state.select("node", "n", "shard", F.when(moving, target).alias("_to"), F.when(moving, bin_).alias("_bin")), "moves")
    # quotas: sums by shard, target and gain (shards ** 2 * GAIN_BINS rows at most) decide which share of each may move
    load = {r["shard"]: r["load"] for r in state.groupBy("shard").agg(F.sum("n").alias("load")).collect()}
    wishes = [(r["_bin"], r["shard"], r["_to"], r["n"]) for r in state.where("_to IS NOT NULL").groupBy("shard", "_to", "_bin").agg(F.sum("n").alias("n")).collect()]
    shares = allowed_shares(load, wishes, n_rows / shards * (1 + SLACK))
    allowed = labels.sparkSession.createDataFrame(shares, "shard int, _to int, _bin int, _share double")
    taken = F.pmod(F.xxhash64("node", F.lit(turn), F.lit(1)), F.lit(1 << 20)) < F.coalesce("_share", F.lit(0.0)) * (1 << 20)
    return staged(state.join(F.broadcast(allowed), ["shard", "_to", "_bin"], "left").select("node", "n", F.when(taken, F.col("_to")).otherwise(F.col("shard")).alias("shard")), "labels")


def allowed_shares(load: dict[int, int], wishes: list[tuple[int, int, int, int]], quota: float) -> list[tuple[int, int, int, float]]:
    """shard, target, bin and the share of these rows that may move, for wishes (bin, shard, target, rows), greatest gains first.

    A shard takes rows in while it is under its quota; what leaves it makes room for others, so passes go on until nothing moves.
    """
    now = {s: float(load.get(s, 0)) for s in {*load, *(t for _, _, t, _ in wishes)}}
    left = {w[:3]: float(w[3]) for w in sorted(wishes, reverse=True)}
    for _ in range(100):
        moved = 0.0
        for (b, s, t), n in left.items():
            m = min(n, quota - now[t])
            if m > 0:
                now[t], now[s], left[b, s, t] = now[t] + m, now[s] - m, n - m
                moved += m
        if moved < 1:
            break
    return [(s, t, b, 1 - left[b, s, t] / n) for b, s, t, n in wishes if left[b, s, t] < n]


def assign(docs: DataFrame, shards: int = 16, link_chars: int = LINK_CHARS) -> DataFrame:
    """doc_id, size, text_crc32, group, node, linked, shard, slot for every row of docs (doc_id, text).

    Equal texts are one node (several, of PART of a shard at most, where there are more of them); nodes that share a line of link_chars are linked. Nodes of one community begin on
    one shard. After propagation each shard keeps its quota of rows, those of groups first, then linked ones; single rows beyond it fill the other shards, so counts are at most
    one apart and groups stay whole, unless single rows are too few for that. Repeated rows count each; null
    texts count as empty; other columns are not read; no rows give no rows.
    """
    n_rows = docs.count()
    rows = staged(_nodes(_rows(docs), n_rows, shards), "rows")
    sizes = rows.groupBy("node").agg(F.count("*").alias("n"))
    line = F.explode(F.array_distinct(F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x) >= link_chars), lambda x: F.xxhash64(x))))
    of_group = docs.select(F.xxhash64(F.coalesce("text", F.lit("")), F.octet_length(F.coalesce("text", F.lit("")))).alias("group"), line.alias("key")).distinct()
    parts = rows.groupBy("group", "node").agg(F.count("*").alias("_n")).select("group", "node")
    by_node = of_group.join(parts, "group").select("node", "key")
    common = by_node.groupBy("key").agg(F.count("*").alias("_k")).where("_k > 1")
    found = staged(by_node.join(common, "key"), "links")
    linked = _seeds(found, sizes, n_rows / (8 * shards))
    links = found.select("node", "key")
    nodes = staged(sizes.join(linked, "node", "left").select("node", "n", "anchor", (F.col("anchor").isNotNull() | (F.col("n") > 1)).alias("linked")), "nodes")
    # communities that would bring more than an eighth of a shard to one place do not (fewer than 8 * shards rows)
    heavy = nodes.where("anchor IS NOT NULL").groupBy("anchor").agg(F.sum("n").alias("_n")).where(F.col("_n") * 8 * shards > n_rows).select("anchor", F.lit(True).alias("_heavy"))
    nodes = staged(nodes.join(F.broadcast(heavy), "anchor", "left").select("node", "n", "linked", F.when(F.col("_heavy").isNull(), F.col("anchor")).alias("anchor")), "nodes")
    start = F.pmod(F.xxhash64(F.coalesce("anchor", "node"), F.lit(5)), F.lit(shards)).cast("int")
    placed = _place_large(nodes, n_rows, shards)
    first = docs.sparkSession.createDataFrame(placed, "node long, _s int")  # at most LARGE rows
    labels = staged(nodes.where("linked").join(F.broadcast(first), "node", "left").select("node", "n", F.coalesce("_s", start).alias("shard")), "labels")
    for turn in range(ROUNDS):
        before, labels = labels, _propagate(labels, links, n_rows, shards, turn)
        drop_staged(before)
    labels = _relieve(labels, n_rows, shards)
    located = rows.join(nodes.select("node", "n", "anchor", "linked", start.alias("_start")), "node").join(labels.select("node", "shard"), "node", "left").withColumn("shard", F.coalesce("shard", "_start")).drop("_start")
    return _even(located, n_rows, shards).drop("anchor")


def _relieve(labels: DataFrame, n_rows: int, shards: int) -> DataFrame:
    """labels (node, n, shard) where nodes of several rows move, whole, from shards that such nodes alone fill beyond the quota to shards with room for them.

    Large nodes (LARGE of them at most) go one by one to the emptiest shard, small ones by ranges of running sums. What finds no room stays, and is cut when counts are made even.
    """
    quota, buckets = n_rows // shards, max(64, n_rows // 500_000)
    groups = labels.where("n > 1")
    held = {r["shard"]: r["n"] for r in groups.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    if all(n <= quota for n in held.values()):
        return labels
    is_large = F.col("n") * LARGE >= n_rows
    large = groups.where(is_large).orderBy(F.desc("n"), "node").collect()
    now, total = [0] * shards, [held.get(s, 0) for s in range(shards)]
    placed = []
    for r in large:
        s = to = r["shard"]
        if now[s] + r["n"] > quota:
            to = min((x for x in range(shards) if x != s), key=lambda x: (total[x], x), default=s)
            placed.append((r["node"], to))
            total[s], total[to] = total[s] - r["n"], total[to] + r["n"]
        now[to] += r["n"]
    at = lambda values: F.element_at(F.array(*[F.lit(x).cast("long") for x in values]), F.col("shard") + 1)
    small = groups.where(~is_large).withColumn("_b", F.pmod(F.xxhash64("node", F.lit(11)), F.lit(buckets)))
    before = small.groupBy("shard", "_b").agg(F.sum("n").alias("_n")).select("shard", "_b", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_b")) - F.col("_n")).alias("_before"))
    within = F.sum("n").over(Window.partitionBy("shard", "_b").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    moving = small.join(before, ["shard", "_b"]).withColumn("_at", within + F.col("_before") + at(now)).where(F.col("_at") + F.col("n") > quota).select("node", "n", "shard", "_at")
    moving = staged(moving, "moving")
    most = moving.agg(F.max("n")).first()[0] or 0
    # movers are numbered through by rows, from each shard's first; a shard with room takes a range of these numbers, less the rows by which the last node may pass its end
    first, rooms, a, b = [], [], 0, 0
    for s in range(shards):
        start = max(now[s], quota - most)
        first.append(a - start)
        a += max(0, total[s] - start) if total[s] > quota else 0
        room = max(0, quota - total[s] - most)
        rooms.append((b, b + room))
        b += room
    number = F.col("_at") + at(first)
    to = F.lit(None).cast("int")
    for s, (lo, hi) in enumerate(rooms):
        to = F.when(number.between(lo, hi - 1), s).otherwise(to)
    moved = moving.select("node", to.alias("_to"))
    alone = labels.sparkSession.createDataFrame(placed, "node long, _s int")  # at most LARGE rows
    out = labels.join(F.broadcast(alone), "node", "left").join(moved, "node", "left")
    out = staged(out.select("node", "n", F.coalesce("_s", "_to", "shard").cast("int").alias("shard")), "labels")
    drop_staged(moving)
    return out


def _even(rows: DataFrame, n_rows: int, shards: int) -> DataFrame:
    """rows with shard and slot such that counts are at most one apart; rows of a shard keep it by rank: those of groups first, which so stay whole, then linked ones, of one anchor together."""
    buckets, spread = max(64, n_rows // 500_000), max(1, n_rows // (128 * 500_000))  # an anchor has 1 / 128 of all rows at most
    order = F.when(F.col("n") > 1, 0).when(F.col("linked"), 1).otherwise(2)
    community = F.xxhash64(F.coalesce("anchor", "doc_id"), F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(spread)))
    rows = rows.withColumn("_b", order * buckets + F.pmod(community, F.lit(buckets))).drop("n")
    rows = staged(rows, "located")
    count = rows.groupBy("shard", "_b").agg(F.count("*").alias("_n"))
    before = count.select("shard", "_b", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_b")) - F.col("_n")).alias("_before"))
    load = {r["shard"]: r["n"] for r in count.groupBy("shard").agg(F.sum("_n").alias("n")).collect()}
    quota = [n_rows // shards + (s < n_rows % shards) for s in range(shards)]
    over, room, a, b = [], [], 0, 0  # first overflow number of each shard; first overflow number that fills each shard
    for s in range(shards):
        over.append(a)
        room.append((b, b + max(0, quota[s] - load.get(s, 0)), load.get(s, 0)))
        a, b = a + max(0, load.get(s, 0) - quota[s]), room[-1][1]
    # 3 * buckets rows for each shard: bounded by the number of rows over 250,000
    ranked = rows.join(F.broadcast(before) if buckets <= 4096 else before, ["shard", "_b"]).withColumn("_r", F.row_number().over(Window.partitionBy("shard", "_b").orderBy("group", "doc_id")) - 1 + F.col("_before"))
    at = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("shard") + 1)
    ranked = ranked.withColumn("_o", F.when(F.col("_r") >= at(quota), F.col("_r") - at(quota) + at(over)))
    shard, slot = F.col("shard"), F.col("_r")
    for s, (lo, hi, held) in enumerate(room):
        here = F.col("_o").between(lo, hi - 1)
        shard, slot = F.when(here, s).otherwise(shard), F.when(here, F.col("_o") - lo + held).otherwise(slot)
    return ranked.withColumn("slot", slot.cast("long")).withColumn("shard", shard.cast("int")).drop("_b", "_before", "_r", "_o")


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose counts are at most one apart."""
    out = assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
