"""Counts of texts against plain Python, and the rule learner."""

import random
import re

from depscope.llm import quality_rules as Q


def _brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    covered, seen = set(), {}
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_plain_python(spark):
    r = random.Random(2)
    texts = [None, "", " \n\t", "a " * 50, "x\n\nx\n x\nx", " a　b", "word " * 7, "é🎉 # <b> \x0b q\x0cz\rk"]
    for _ in range(300):
        texts.append("".join(r.choice(["a", "b", "aa ", " ", "\n", "c d e f g h i j ", "#", "é ", "\r\n"]) for _ in range(r.randint(0, 120))))
    texts.append("p q r s t u v w x y " * 3000)
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, _words string")
    got = Q.with_statistics(docs).select("doc_id", "_words", "stats.n_words", "stats.word_chars", "stats.n_symbols", "stats.n_dup_lines", "stats.n_repeat_words").collect()
    assert {row.doc_id: tuple(row)[2:] for row in got} == {i: _brute(t) for i, t in enumerate(texts)}
    assert {row["_words"] for row in got} == {"z"}


def test_learner_finds_the_thresholds(spark):
    r = random.Random(4)
    rows = []
    for i in range(3000):
        a, b, c = r.randint(0, 1000), r.randint(0, 1000), r.randint(0, 1000)
        rows.append((a, b, c, int((a >= 700 and b < 200) or c >= 900), i % 3 == 0))
    table = spark.createDataFrame(rows, "a long, b long, c long, bad int, held boolean")
    rules = Q.learn(table, ["a", "b", "c"], "bad", "held")
    values = {n: table[n] for n in "abc"}
    wrong = table.where(rules.keeps(values) == (table.bad == 1)).count()
    assert wrong == 0, str(rules)
    assert {frozenset(map(str, rule)) for rule in rules.rules} == {frozenset({"a >= 700", "b < 200"}), frozenset({"c >= 900"})}


def test_pruning_refuses_rules_that_do_not_hold(spark):
    rows = [(i, 0, 1 if i % 3 and i % 7 == 0 else 0, i % 3 == 0) for i in range(300)]
    table = spark.createDataFrame(rows, "a long, b long, bad int, held boolean")
    assert Q.learn(table, ["a", "b"], "bad", "held").rules == ()


def test_without_labels_only_the_base_checks_hold(spark):
    docs = spark.createDataFrame([(1, "w " * 5), (2, " ".join(f"w{i}" for i in range(40))), (3, None)], "doc_id long, text string")
    counted = Q.with_statistics(docs)
    rules = Q.learn_from(counted, spark.createDataFrame([], "doc_id long, quality int"))
    assert str(rules) == "keep"
    failed, kept = Q.judged(counted, rules)
    assert {r.doc_id: (r.f, r.k) for r in counted.select("doc_id", failed.alias("f"), kept.alias("k")).collect()} == {1: (True, False), 2: (False, True), 3: (True, False)}
    assert Q.with_statistics(docs.limit(0)).count() == 0


def test_held_out_accuracy_on_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op7_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed")
    right = got.where("kept = (quality = 1)").count()
    assert right >= 0.97 * got.count()


def test_stage_keeps_columns_and_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = Q.keep_by_rules(spark, docs.withColumn("stats", docs.doc_id), "/root/testdata/sf0.001")
    assert kept.columns == [*docs.columns, "stats"]
    assert 0.6 * docs.count() < kept.count() < docs.count()


def test_lists_of_many_rules_and_conditions(spark):
    r = random.Random(9)
    names = list("abcdefghij")
    rows = []
    for i in range(6000):
        v = [r.randint(0, 1000) for _ in names]
        rows.append((*v, int(any(x >= 970 for x in v) or (v[0] < 500 and v[1] < 500 and v[2] < 500 and v[3] < 500)), i % 3 == 0))
    table = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names) + ", bad int, held boolean")
    rules = Q.learn(table, names, "bad", "held")
    values = {n: table[n] for n in names}
    # More than eight rules, and one of four conditions.
    assert len(rules.rules) >= 11 and max(map(len, rules.rules)) >= 4, str(rules)
    assert table.where(rules.keeps(values) == (table.bad == 1)).count() < 200


def test_one_rule_equals_exhaustive_search(spark):
    r = random.Random(12)
    rows = [(r.randint(0, 30), r.randint(0, 30), i % 3 == 0) for i in range(400)]
    rows = [(a, b, int(a >= 22), held) for a, b, held in rows]
    table = spark.createDataFrame(rows, "a long, b long, bad int, held boolean")
    rules = Q.learn(table, ["a", "b"], "bad", "held")
    # Of all single thresholds over either statistic only one kind parts the table without a fault.
    right = {(n, least, e) for n, k in (("a", 0), ("b", 1)) for least in (True, False) for e in range(32)
             if all((row[k] >= e if least else row[k] < e) == bool(row[2]) for row in rows)}
    assert len(rules.rules) == 1 and len(rules.rules[0]) == 1
    c = rules.rules[0][0]
    assert (c.feature, c.least, c.edge) in right
    assert table.where(rules.keeps({n: table[n] for n in "ab"}) == (table.bad == 1)).count() == 0


def test_repeated_rows_are_judged_alike(spark):
    docs = spark.createDataFrame([(1, "w " * 30, 5), (1, "w " * 30, 5), (None, None, 5)], "doc_id long, text string, stats int")
    counted = Q.with_statistics(docs, stats="found")
    assert [Q.judged(counted, Q.DecisionList(()), "found")[1] is not None, counted.count()] == [True, 3]
    assert counted.select("found").distinct().count() == 2


def test_roundest_number_between():
    assert [Q.roundest(*p) for p in ((699, 702), (20, 60), (5, 6), (0, 1), (149, 151), (-3, 2), (12, 14), (98, 1003))] == [700, 50, 6, 1, 150, 0, 13, 1000]
