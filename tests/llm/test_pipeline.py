"""The pipeline's stages over a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline

rnd = random.Random(3)


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    texts = [prose(80, i) for i in range(200)]
    for i in range(0, 200, 4):
        words = texts[i].split()
        words[i % 70] = "horridword"
        texts[i] = " ".join(words)
    item = prose(30, 999)
    # the contaminated text, a near copy, an exact copy, and odd ones
    texts += [f"{prose(40, 300)} {item}", " ".join(texts[1].split()[:-1] + ["end"]), texts[2], None, "", f"first line\n{texts[3]}\n{texts[5]}"]
    spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts


def test_run(spark, corpus):
    folder, texts = corpus
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    clean = {i for i in range(200) if i % 4}
    assert len(clean & set(got)) > 0.95 * len(clean)
    assert len(set(got) - clean - {201, 202, 203, 204, 205}) <= 5  # toxic texts go
    assert 200 not in got  # holds an item
    assert all(r.round_trip for r in got.values())


def test_stages_keep_the_columns_of_documents(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("label", docs_extra())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(stage(spark, docs, folder).columns) == sorted(docs.columns), name
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("extra")


def test_near_duplicates_go_by_id_and_text(spark):
    one, other, third = prose(80, 700), prose(80, 701), prose(80, 702)
    near = [" ".join(t.split()[:-1] + ["end"]) for t in (one, third)]
    rows = [(1, one), (2, near[0]), (2, other), (None, near[0] + " more"), (None, third), (None, near[1]), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    left = [r for r in got if r[1] not in (third, near[1])]
    assert sorted(left, key=str) == sorted([(1, one), (2, other), (3, None), (3, "")], key=str)
    assert len(got) == 5  # and one of the two that have no id
