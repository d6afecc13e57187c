"""The pipeline, stage by stage, against brute force on what each stage got."""

import random

import corpus_pipeline as C
from depscope.llm import packing
from tests.llm.test_ngram_join import _brute


def _corpus(spark, folder):
    r = random.Random(5)
    word = lambda: "".join(r.choice(["an", "er", "tion", "st", "ou", "re"]) for _ in range(r.randint(1, 3)))
    clean = [" ".join(word() for _ in range(r.randint(30, 120))) + "." for _ in range(80)]
    junk = [" ".join(word() + "***" for _ in range(40)) for _ in range(8)] + [" ".join([word()] * 60) for _ in range(8)] + [" ".join(word().upper() + "!!" for _ in range(40)) for _ in range(8)]
    texts = clean + clean[:10] + [t + " extra" for t in clean[10:20]] + junk + [None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 100), 0) for i in range(len(rows) - 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_each_stage_decides_on_all_it_gets(spark, tmp_path):
    rows = _corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(C.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out-{k}")
        docs = spark.read.parquet(f"{tmp_path}/out-{k}")
        after = {r.doc_id for r in docs.collect()}
        sizes.append(len(after))
        if k < len(C.STAGES) - 1:
            assert docs.columns == columns
        if name in ("quality_classifier", "quality_rules"):
            assert not {i for i in before if i < 100} - after, name  # clean documents stay
        if name == "quality_rules":
            assert not {i for i in after if i >= 100}  # junk and blank documents are gone by now
        if name == "near_duplicates":
            assert after == {least for _, n, least, _ in _brute(list(before.items())) if n}
    assert sizes[1] <= sizes[0] - 20 and sizes[3] < sizes[2] == 100 and sizes[4] == sizes[3]
    assert {r.bucket_length - r.padding for r in docs.collect()} == {len(rows[r.doc_id][1].split()) for r in docs.collect()}


def test_run_equals_the_stages_and_the_empty_table_passes(spark, tmp_path):
    _corpus(spark, str(tmp_path))
    got = C.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "bucket", "bucket_length", "batch", "place", "padding"] and got.count() == 80
    assert packing.pack_documents(spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)).count() == 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert C.run(spark, f"{tmp_path}/none").count() == 0
