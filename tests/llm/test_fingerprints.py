"""SimHash, edits and radius search against plain Python."""

import hashlib
import random

from depscope.llm import fingerprints as P


def test_radius_search_equals_brute_force(spark):
    r = random.Random(1)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [r.getrandbits(64) for _ in range(40)]
    prints = [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(10)] + [0, 2**64 - 1, 1 << 63]
    table = spark.createDataFrame([(signed(x), "a") for x in prints + prints[:20]], "fingerprint long, found string")
    for radius, blocks in ((3, 6), (0, 4), (2, 5)):
        got = sorted(map(tuple, P.within_radius(table.limit(120), table, radius, blocks).collect()))
        asked = {row.fingerprint for row in table.limit(120).collect()}
        every = {signed(x) for x in prints}
        apart = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
        assert got == sorted((a, b, apart(a, b)) for a in asked for b in every if apart(a, b) <= radius)


def test_equal_texts_and_order_of_words(spark):
    rows = [(1, "the quick brown fox"), (2, "fox brown quick the the"), (3, None), (4, " \n"), (5, "another text altogether with words")]
    got = {r.doc_id: r.fingerprint for r in P.fingerprint_texts(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], "text").collect()}
    assert got[1] == got[2] and got[3] == got[4] == 0 and got[5] != got[1]


def test_query_equals_plain_edits(spark, tmp_path):
    r = random.Random(3)
    words = [f"{r.choice('abcdef')}{i}é" for i in range(300)]
    rows = [(d, " ".join(r.choice(words) for _ in range(r.choice((0, 1, 3, 30, 200))))) for d in r.sample(range(1000), 60)]
    rows += [(2000, None), (2001, ""), (2002, "abc"), (2003, rows[0][1]), (2004, rows[0][1]), (2004, rows[0][1])]
    spark.createDataFrame([(d, t, "z", "k") for d, t in rows], "doc_id long, text string, key string, own string").write.parquet(str(tmp_path / "documents.parquet"))
    got = P.op9_document_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    order = sorted({(d, t or "") for d, t in rows})
    edited = {}
    for i, (doc, text) in enumerate(order):
        take = len(text) // 4
        edited[doc] = text[: len(text) - take] + order[(i + 1) % len(order)][1][:take]
    for row in got:
        assert row.edited_sha256 == hashlib.sha256(edited[row.doc_id].encode()).hexdigest()
        assert len(row.fingerprint) == 16 and 0 <= row.near_next <= 1
        assert (row.n_within is None) == (row.doc_id % 50 != 0)
    by = {r.doc_id: r for r in got}
    assert by[2003].fingerprint == by[2004].fingerprint == by[rows[0][0]].fingerprint
    long = [r for r in got if r.n_chars > 300]
    assert sum(r.near_edited for r in long) / len(long) > sum(r.near_next for r in long) / len(long) + 0.1


def test_near_counts_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = P.op9_document_fingerprints(spark, sf).collect()
    prints = [int(r.fingerprint, 16) for r in got]
    for r in got:
        if r.doc_id % 50 == 0:
            assert r.n_within == sum(bin(int(r.fingerprint, 16) ^ p).count("1") <= P.RADIUS for p in prints)


def test_empty_and_single(spark, tmp_path):
    for name, rows in (("none", []), ("one", [(1, "abcd efgh")])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / name / "documents.parquet"))
    assert P.op9_document_fingerprints(spark, str(tmp_path / "none")).count() == 0
    row = P.op9_document_fingerprints(spark, str(tmp_path / "one")).collect()[0]
    assert row.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest() and row.near_next == 1.0


def test_long_rows_repeated_often_do_not_overflow(spark, tmp_path):
    long = " ".join(f"{i}x{'y' * 200}" for i in range(5000))
    once = spark.createDataFrame([(1, long), (2, "two words")], "doc_id long, text string")
    many = once.where("doc_id = 1").crossJoin(spark.range(2200)).select("doc_id", "text").union(once)
    once.write.parquet(str(tmp_path / "once" / "documents.parquet"))
    many.repartition(8).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    one, all_ = (P.op9_document_fingerprints(spark, str(tmp_path / d)) for d in ("once", "many"))
    shown = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert all_.count() == 2202 and sorted(map(tuple, all_.select(*shown).distinct().collect())) == sorted(map(tuple, one.select(*shown).collect()))
