"""Sharding: balanced label propagation over links, then gapless slots.

Links join a document with a key that it shares with others (a text, a host, a component), so a
group of n linked documents is n rows, never n * n pairs. At the start the few links that are large
for a shard are placed whole, largest first, and all other linked documents are dealt level over the
shards, whatever their links. Each round counts the members of every link per shard, lets the link
wish for the shard with most of them that has room for the others, lets every document ask for the
shard where most of its links' weight lies, and grants requests under quotas: what a shard may take
is what it has free plus what leaves it. Requests are granted in the order of a hash of the link, up
to the quota, so no ranking of all movers is needed. Documents without links take no part; they fill
what the linked ones leave free, in one line over the shards. So counts differ by one at most. A
group larger than a shard is taken as pieces of a shard's size; others are cut where the rounds end
before room is found.

Driver data: one table of shards * shards * HASH_STEPS counts a round and the large links, whatever the input.

Defined results: null text has no bytes and links with other empty texts; a document without links
goes where room is; repeated rows are placed one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from depscope.llm.common import ranked
from depscope.scratch import materialize

# Steps of the hash by which requests are granted; quotas are met to one part in so many.
HASH_STEPS = 256
# Links of more than one part in so many of a shard are placed whole at the start: at most LARGE of them for each shard.
LARGE = 8


def _quotas(asked: dict[tuple[int, int], list[int]], load: list[int], cap: int | list[int]) -> dict[tuple[int, int], int]:
    """For each (from, to): how many hash steps are granted.

    A swap between two shards changes neither load, so both directions are granted up to the
    smaller. Then each shard fills its free room step by step, from all shards alike, so that
    the members of one link, which share a step, are granted together.
    """
    caps = [cap] * len(load) if isinstance(cap, int) else cap
    granted = {pair: 0 for pair in asked}
    moved = {pair: 0 for pair in asked}
    load = list(load)

    def grant(pair, most):
        steps = asked[pair]
        while granted[pair] < HASH_STEPS and moved[pair] + steps[granted[pair]] <= most:
            moved[pair] += steps[granted[pair]]
            granted[pair] += 1

    order = sorted(asked, key=lambda p: (-sum(asked[p]), p))
    for pair in order:
        back = (pair[1], pair[0])
        if back in asked:
            grant(pair, min(sum(asked[pair]), sum(asked[back])))
    for (a, b), n in moved.items():
        load[a] -= n
        load[b] += n
    for to in dict.fromkeys(b for _, b in order):
        pairs = [pair for pair in order if pair[1] == to]
        for step in range(HASH_STEPS):
            due = [pair for pair in pairs if granted[pair] == step]
            n = sum(asked[pair][step] for pair in due)
            if n and load[to] + n > caps[to]:
                break
            for pair in due:
                granted[pair] += 1
                load[pair[0]] -= asked[pair][step]
            load[to] += n
    return granted


def _loads(labels: DataFrame, shards: int) -> list[int]:
    load = [0] * shards
    for row in labels.groupBy("shard").count().collect():
        load[row["shard"]] = row["count"]
    return load


def _start(links: DataFrame, caps: list[int]) -> DataFrame:
    """(node, shard): large links whole where they fit, largest first and in the fullest such shard; other nodes level, whatever their links."""
    shards, room = len(caps), list(caps)
    large = links.groupBy("link").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") * LARGE > caps[0])
    seeds = []
    for row in sorted(large.collect(), key=lambda r: (-r["members"], str(r["link"]))):
        fits = [s for s in range(shards) if room[s] >= row["members"]]
        if fits:
            s = min(fits, key=lambda s: (room[s], s))
            room[s] -= row["members"]
            seeds.append((row["link"], s, row["members"]))
    seeded = links.join(links.sparkSession.createDataFrame(seeds, large.select(
        "link", F.lit(0).alias("shard"), "members").schema), "link")
    seeded = materialize(seeded.groupBy("node").agg(F.max_by("shard", F.struct("members", (-F.col("shard")).alias("low"))).alias("shard")), "seeded")
    free = ranked(links.select("node").distinct().join(seeded, "node", "left_anti"), [], ["node"], "start", "place")
    count = free.count()
    room = [max(0, c - n) for c, n in zip(caps, _loads(seeded, shards), strict=True)]
    share = [count * r // max(1, sum(room)) for r in room]
    for s in range(shards):
        share[s] += min(room[s] - share[s], 1, count - sum(share))
    shard, end = F.lit(shards - 1), count
    for s in reversed(range(shards)):
        shard = F.when(F.col("place") < end, s).otherwise(shard)
        end -= share[s]
    return materialize(seeded.union(free.select("node", shard.alias("shard"))), "shards")


def propagate(links: DataFrame, caps: list[int], rounds: int = 4) -> DataFrame:
    """(node, shard) of the nodes of links (node, link): shards after the rounds, which fill none beyond its cap.

    A link wishes for the shard that has most of its members among those with room for the others;
    if none has, for the one with most. Ties are broken by a hash, so that wishes spread.
    """
    shards, labels = len(caps), _start(links, caps)
    for turn in range(rounds):
        load = _loads(labels, shards)
        room = [c - n for c, n in zip(caps, load, strict=True)]
        held = links.join(labels, "node")
        sizes = held.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("members"))
        # One entry per shard at most; the roomiest shard is a choice for links that have nobody there.
        roomiest = F.struct(F.lit(room.index(max(room))).alias("shard"), F.lit(0).cast("long").alias("members"))
        per = sizes.groupBy("link").agg(F.collect_list(F.struct("shard", "members")).alias("at"), F.sum("members").alias("all"))
        free = F.array(*[F.lit(r).cast("long") for r in room])
        choice = F.array_max(F.transform(F.concat("at", F.array(roomiest)), lambda o: F.struct(
            (F.col("all") - o["members"] <= F.get(free, o["shard"])).alias("fits"), o["members"].alias("members"),
            F.xxhash64("link", o["shard"], F.lit(turn)).alias("tie"), o["shard"].alias("shard"))))
        # A link of one document asks for nothing.
        best = per.where("all > 1").select("link", choice.alias("best")).select("link", F.col("best.shard").alias("wish"), F.col("best.members").alias("weight"))
        asks = held.join(best, "link").groupBy("node", "shard", "wish").agg(
            F.sum("weight").alias("weight"), F.min(F.pmod(F.xxhash64("link", F.lit(turn)), F.lit(HASH_STEPS))).cast("int").alias("step"))
        asks = asks.groupBy("node", "shard").agg(
            F.max_by(F.struct("wish", "step"), F.struct("weight", (-F.col("wish")).alias("low"))).alias("ask"))
        asks = materialize(asks.where("ask.wish <> shard").select("node", "shard", "ask.wish", "ask.step"), "requests")
        asked: dict[tuple[int, int], list[int]] = {}
        for row in asks.groupBy("shard", "wish", "step").count().collect():
            asked.setdefault((row["shard"], row["wish"]), [0] * HASH_STEPS)[row["step"]] = row["count"]
        if not asked:
            break
        granted = _quotas(asked, load, caps)
        may = F.create_map(*[F.lit(x) for (a, b), n in granted.items() for x in (a * shards + b, n)])
        goes = asks.where(F.col("step") < F.get(F.array(may[F.col("shard") * shards + F.col("wish")]), F.lit(0)))
        labels = materialize(
            labels.join(goes.select("node", "wish"), "node", "left").select("node", F.coalesce("wish", "shard").alias("shard")), "shards")
    return labels


def even_shards(nodes: DataFrame, shards: int = 8, rounds: int = 4) -> DataFrame:
    """Add shard and slot to (node, link, ...), in place of columns of these names: counts differ by one at most, links stay together where they fit.

    `node` tells rows apart; a null link links with nothing. Other columns may have any names.
    """
    others = [c for c in nodes.columns if c.lower() not in ("node", "link", "shard", "slot")]
    held = {c: f"_kept{i}" for i, c in enumerate(others)}
    placed = _even_shards(nodes.select("node", "link", *[F.col(c).alias(to) for c, to in held.items()]), shards, rounds)
    names = {"node": "node", "link": "link", **held}
    return placed.select(*[F.col(names[c]).alias(c) for c in nodes.columns if c in names], "shard", "slot")


def _even_shards(nodes: DataFrame, shards: int, rounds: int) -> DataFrame:
    """even_shards for frames whose other columns are out of the way."""
    size = nodes.groupBy("link").agg(F.count(F.lit(1)).alias("members")).where("link IS NOT NULL AND members > 1")
    links = materialize(nodes.join(size, "link").select("node", "link"), "links")
    small, more = divmod(nodes.count(), shards)  # the first `more` shards hold one document more
    caps = [small + (s < more) for s in range(shards)]
    # A link that no shard can hold is as few pieces as possible; fewer than `shards` links are that large.
    over = size.where(F.col("members") > caps[0]).select("link")
    pieces = ranked(links.join(over, "link", "left_semi").select("node", "link"), ["link"], ["node"], "pieces", "place")
    whole = links.join(over, "link", "left_anti").select("node", "link", F.lit(0).cast("long").alias("piece"))
    links = whole.union(pieces.select("node", "link", F.floor(F.col("place") / max(1, caps[0])).cast("long")))
    labels = propagate(materialize(links.select("node", F.struct("link", "piece").alias("link")), "pieces"), caps, rounds)
    laid = nodes.join(labels.withColumnRenamed("shard", "near"), "node", "left")

    inner = ranked(laid.where("near IS NOT NULL"), ["near"], ["link", "node"], "linked", "place")
    room = F.get(F.array(*[F.lit(c) for c in caps]), F.col("near"))
    held = {r["near"]: r["count"] for r in inner.groupBy("near").count().collect()}
    kept = [min(held.get(s, 0), caps[s]) for s in range(shards)]
    stay = inner.where(F.col("place") < room).select(*nodes.columns, F.col("near").alias("shard"), F.col("place").alias("slot"))

    over = inner.where(F.col("place") >= room).select(*nodes.columns, F.lit(0).alias("turn"))
    pool = over.union(laid.where("near IS NULL").select(*nodes.columns, F.lit(1)))
    line = ranked(pool, [], ["turn", "link", "node"], "others", "place")
    shard, slot, begin = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        end = begin + caps[s] - kept[s]
        mine = (F.col("place") >= begin) & (F.col("place") < end)
        shard = F.when(mine, s).otherwise(shard)
        slot = F.when(mine, F.col("place") - begin + kept[s]).otherwise(slot)
        begin = end
    return stay.union(line.select(*nodes.columns, shard.alias("shard"), slot.alias("slot")))


def cut_links(placed: DataFrame) -> DataFrame:
    """One row: pairs of linked documents, and those whose shards differ; counted per link, without pairs."""
    per = placed.where("link IS NOT NULL").groupBy("link", "shard").count().groupBy("link").agg(
        F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("same"))
    return per.agg(
        F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("links"),
        F.coalesce(F.sum(F.expr("(n * n - same) div 2")), F.lit(0)).alias("cut"))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7 by the law `rows`, linked by equal texts."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha1(text.cast("binary")).alias("link"))
    # A number per row tells repeated rows apart.
    nodes = ranked(docs, [], ["doc_id", "link"], "documents", "node")
    placed = even_shards(nodes, shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
