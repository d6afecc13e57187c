"""Shards: even counts, gapless slots, links kept together."""

import random
import zlib

from depscope.llm import sharding as S


def _nodes(spark, rows):
    return spark.createDataFrame(rows, "node long, link string, shard string")


def test_even_gapless_and_few_cuts(spark):
    rows = [(i, f"g{i // 5}" if i < 400 else None, "x") for i in range(1003)]
    placed = S.even_shards(_nodes(spark, rows).drop("shard"), shards=8)
    got = placed.collect()
    sizes = [sorted(r.slot for r in got if r.shard == s) for s in range(8)]
    assert sorted(map(len, sizes)) == [125] * 5 + [126] * 3
    assert all(slots == list(range(len(slots))) for slots in sizes)
    links, cut = S.cut_links(placed).first()
    assert links == 80 * 10 and cut == 0


def test_a_group_larger_than_a_shard_is_spread_evenly(spark):
    placed = S.even_shards(_nodes(spark, [(i, "hot" if i % 3 == 0 else f"s{i}", "x") for i in range(300)]).drop("shard"), shards=4)
    got = placed.groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [75] * 4
    # The hot group fills as few shards as it needs.
    assert placed.where("link = 'hot'").select("shard").distinct().count() == 2


def test_empty_single_and_null_links(spark):
    empty = spark.createDataFrame([], "node long, link string")
    assert S.even_shards(empty).count() == 0
    one = S.even_shards(spark.createDataFrame([(1, None)], "node long, link string")).collect()
    assert [(r.shard, r.slot) for r in one] == [(0, 0)]


def test_quotas_respect_room():
    steps = lambda n: [n // S.HASH_STEPS + (i < n % S.HASH_STEPS) for i in range(S.HASH_STEPS)]
    asked = {(0, 1): steps(100), (1, 0): steps(40), (2, 1): steps(10)}
    granted = S._quotas(asked, [50, 50, 50], 50)
    moved = {p: sum(asked[p][:n]) for p, n in granted.items()}
    assert moved[0, 1] == moved[1, 0] == 40
    assert moved[2, 1] == 0


def test_query_counts_rows(spark):
    got = S.op6_sharding(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and {r.law for r in got} == {"rows"}
    assert {sum(r.shard == s for r in got) for s in range(8)} == {25}


def _shard_by_hash(spark, names, shards):
    rows = spark.createDataFrame([(n,) for n in names], "link string").selectExpr("link", f"pmod(xxhash64(link), {shards}) AS at").collect()
    out = {}
    for r in rows:
        out.setdefault(r["at"], []).append(r.link)
    return out


def test_groups_that_hash_alike_are_not_cut(spark):
    # Three groups of 60 whose names hash to one shard, which holds 100; all fit somewhere.
    alike = next(v for v in _shard_by_hash(spark, [f"g{i}" for i in range(60)], 4).values() if len(v) >= 3)[:3]
    rows = [(i, alike[i // 60] if i < 180 else None) for i in range(400)]
    placed = S.even_shards(spark.createDataFrame([((k * 7) % 400, link) for k, link in rows], "node long, link string"), shards=4)
    assert S.cut_links(placed).first()["cut"] == 0
    assert sorted(r["count"] for r in placed.groupBy("shard").count().collect()) == [100] * 4


def test_rounds_bring_small_groups_together(spark):
    # 300 groups of 4 that all hash to one of 8 shards, scattered at the start; they fill half of the room.
    alike = max(_shard_by_hash(spark, [f"g{i}" for i in range(3000)], 8).values(), key=len)[:300]
    rows = [(node, alike[i // 4] if i < 1200 else None) for i, node in enumerate(random.Random(3).sample(range(2400), 2400))]
    nodes = spark.createDataFrame(rows, "node long, link string")
    caps, links = [300] * 8, nodes.where("link IS NOT NULL")
    cut = lambda labels: S.cut_links(links.join(labels, "node")).first()["cut"]
    start, end = S._start(links, caps), S.propagate(links, caps)
    assert cut(start) > 600 and cut(end) == 0
    assert max(r["count"] for r in end.groupBy("shard").count().collect()) <= 300
    assert S.cut_links(S.even_shards(nodes)).first()["cut"] == 0


def test_swaps_go_on_when_every_shard_is_full(spark):
    rows = [(node, f"p{i // 2}") for i, node in enumerate(random.Random(4).sample(range(800), 800))]
    nodes = spark.createDataFrame(rows, "node long, link string")
    placed = S.even_shards(nodes)
    assert sorted(r["count"] for r in placed.groupBy("shard").count().collect()) == [100] * 8
    start = S.cut_links(nodes.join(S._start(nodes, [100] * 8), "node")).first()["cut"]
    assert S.cut_links(placed).first()["cut"] < start / 2


def test_clashing_columns_do_not_matter(spark):
    rows = [(i, f"l{i % 9}", *range(6)) for i in range(80)]
    nodes = spark.createDataFrame(rows, "node long, link string, place long, near long, shard long, turn long, Slot long, piece long")
    got = S.even_shards(nodes, 4)
    assert got.columns == ["node", "link", "place", "near", "turn", "piece", "shard", "slot"]
    assert {tuple(r)[2:6] for r in got.collect()} == {(0, 1, 3, 5)}
    assert sorted(r["shard"] for r in got.groupBy("shard").count().collect()) == [0, 1, 2, 3]


def test_query_equals_plain_arithmetic(spark, tmp_path):
    r = random.Random(3)
    texts = [None, "", "é", "x" * 5000] + ["".join(r.choice("abé ") for _ in range(r.randint(0, 6))) for _ in range(200)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(7, texts[7], "s"), (None, "abc", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, shard string").write.parquet(str(tmp_path / "documents.parquet"))
    got = S.op6_sharding(spark, str(tmp_path)).collect()
    plain = lambda t: (t or "").encode()
    assert sorted(((g.doc_id, g.size, g.text_crc32) for g in got), key=repr) == sorted(((i, len(plain(t)) + 1, zlib.crc32(plain(t))) for i, t, _ in rows), key=repr)
    for s in range(8):
        slots = sorted(g.slot for g in got if g.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (len(rows) // 8, len(rows) // 8 + 1)


def test_cut_links_equal_pairs(spark):
    r = random.Random(4)
    rows = [(r.choice([None, "a", "b", "c", "d"]), r.randrange(3)) for _ in range(60)]
    got = S.cut_links(spark.createDataFrame(rows, "link string, shard int")).first()
    pairs = [(x, y) for i, x in enumerate(rows) for y in rows[:i] if x[0] is not None and x[0] == y[0]]
    assert tuple(got) == (len(pairs), sum(x[1] != y[1] for x, y in pairs))
