"""The weak-label model: EM, scorer and held-out accuracy."""

import numpy as np

from depscope.llm import quality_model as Q


def test_em_recovers_accuracies_without_labels():
    r = np.random.default_rng(1)
    k, n = len(Q.LABELLERS), 20_000
    kinds = r.choice(1 + len(Q.KINDS), size=n, p=[0.8, 0.05, 0.05, 0.05, 0.05])
    true = np.array([[0.02] * k, *[[0.9 if name in kind else 0.03 for name in Q.LABELLERS] for kind in Q.KINDS]])
    bad = r.random((n, k)) < true[kinds]
    votes = np.where(r.random((n, k)) < 0.1, 1, np.where(bad, 0, 2))
    patterns = {}
    for row in votes:
        key = bytes(row.tolist())
        patterns[key] = patterns.get(key, 0) + 1
    shares, tables = Q.estimate(patterns)
    assert abs(shares[0] - 0.8) < 0.02
    assert np.abs(tables[:, :, 0] - true).max() < 0.12
    # As good as the best possible guess from these votes, which knows the true chances.
    known = np.stack([true, np.ones_like(true), 1 - true], axis=2)
    right = lambda s, t: ((Q.chance_good(votes, s, t) >= 0.5) == (kinds == 0)).mean()
    assert right(shares, tables) >= right(np.array([0.8, 0.05, 0.05, 0.05, 0.05]), known) - 0.003


def test_votes_and_features_of_odd_texts():
    for text in (None, "", " \n"):
        assert set(Q.votes(text)) == {1} and Q.feature_row(text) is None
    for text in ("a", "é", "x" * 200_000, "w " * 100_000):
        assert len(Q.votes(text)) == len(Q.LABELLERS)
        assert np.isfinite(Q.feature_row(text)).all()


def test_held_out_accuracy_against_labels_it_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op8_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    clean = got.where("quality = 1")
    junk = got.where("quality = 0")
    assert clean.where("kept").count() >= 0.98 * clean.count()
    assert junk.where("NOT kept").count() >= 0.8 * junk.count()


def test_stage_keeps_all_columns_and_blank_documents(spark):
    rows = [(1, None, "a", [1]), (2, "", "b", [2]), (2, "", "b", [2]), (3, "Plain words of a sentence, as people write them.", "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, x array<int>")
    model = Q.Model(*(Q.fit(docs).__dict__[n] for n in ("shares", "tables", "weights")))
    got = Q.scored(docs, model, score="chance")
    assert got.columns == ["doc_id", "text", "score", "x", "chance"] and got.count() == 4
    assert [r.chance for r in got.where("doc_id < 3").collect()] == [1.0] * 3
    assert Q.keep_good(spark, docs.limit(0), "").count() == 0
    assert Q.keep_good(spark, docs, "").columns == docs.columns


def test_model_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(Q, "TRAIN_ROWS", 300)
    r = np.random.default_rng(6)
    word = lambda: "".join(r.choice(["an", "er", "tion", "st"], size=2))
    rows = [(i, " ".join(word() + ("!!" if i % 5 == 0 else "") for _ in range(40))) for i in range(1200)] + [(5000, "same text here")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models = [Q.fit(docs.repartition(n)) for n in (2, 7)]
    assert models[0].weights == models[1].weights
    scores = [sorted(map(tuple, Q.scored(docs, m).select("doc_id", "score").collect())) for m in models]
    assert scores[0] == scores[1]
