"""Rows that share an id, tables without labels, and other inputs that an operator might lose documents over."""

import corpus_pipeline
from marlstone.llm import mixing, simhash, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_row_of_each_group_stays(spark):
    a, b = "one two three four five six seven", "quite another text of many other words here"
    rows = [(1, a), (5, a), (5, b), (5, b), (None, b), (None, a), (None, "third"), (7, None), (8, ""), (None, None), (9, "third"), (9, "fourth")]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, key string, id int")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, a, "x", 3), (5, b, "x", 3), (7, None, "x", 3), (9, "third", "x", 3), (9, "fourth", "x", 3)], key=str)
    assert simhash.one_of_each(docs.limit(0)).collect() == []


def test_rows_are_told_apart_by_where_nulls_stand(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "a", None)], "doc_id long, text string, more string")
    assert simhash.one_of_each(docs).count() == 2


def test_nothing_to_learn_from_rejects_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)] + [(None, None)], "doc_id long, text string")
    for labels in ([], [(i, None) for i in range(30)], [(i, 0) for i in range(30)], [(i, 1) for i in range(30)], [(99, 1), (98, 0)]):
        model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert toxicity.clean(docs, model).count() == 31
        assert all(r["score"] < 0.5 for r in toxicity.scores(docs, model).collect())


def test_scores_do_not_depend_on_how_places_are_cut(monkeypatch):
    texts = ["you scum", "a nice day", "", None, "word " * 500 + "scum", "word " * 700] * 20
    model = toxicity.fit(["you scum", "a nice day"] * 20, [1, 0] * 20)
    whole = model.scores(texts, toxicity.Words())
    monkeypatch.setattr(toxicity, "PLACES", 7)
    assert abs(model.scores(texts, toxicity.Words()) - whole).max() < 1e-6
    assert all(abs(model.scores([t], toxicity.Words())[0] - s) < 1e-6 for t, s in zip(texts[:6], whole))


def test_a_cut_document_keeps_its_lines(spark):
    docs = spark.createDataFrame([(1, "  one\ntwo  three\n\nfour five\n", "a"), (2, "x " * 3, "b")], "doc_id long, text string, source string")
    texts = [r["text"] for r in mixing.mixed(docs, weights=(2, 1), share=0.9).where("source = 'a'").collect()]
    assert all(("  one\ntwo  three\n\nfour five").startswith(t.rstrip("\n")) for t in texts) and texts


def test_stages_on_strange_tables(spark, tmp_path):
    rows = [(1, "a b c d e f\ng h", "en", "s", 12), (1, "a b c d e f\ng h", "en", "s", 12), (1, "quite another text", None, None, None), (None, None, None, None, None), (None, "x y z", "de", "", 5), (3, "", "", "s", 0), (4, "word lines\n" * 4000, "en", "t", None)]
    for name, some in (("rows", rows), ("none", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame(some, COLUMNS).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        counts = []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, sf).write.parquet(f"{sf}/{k}")
            docs = spark.read.parquet(f"{sf}/{k}")
            counts.append(docs.count())
            assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert counts[:3] == ([7, 7, 5] if some else [0, 0, 0])
        assert (counts[3] > 0) == bool(some) and counts[4] == counts[3]
        assert corpus_pipeline.run(spark, sf).count() == counts[4]
