"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest

from marlstone.llm import embedjoin, linededup, lm, media, mixing, pii, piece_bpe, sharding, simhash, toxicity

SCHEMA = "doc_id long, text string, source string, key string, size int, id string, node int, taken string, lines string, n int"
LONG = "word lines\n" * 4000


def table(spark, empty=False):
    rows = [(1, "a b\nc d", "s"), (1, "a b\nc d", "s"), (2, None, None), (None, "x y z", "t"), (None, None, None), (3, "", "s"), (4, LONG, "t"), (5, LONG, ""), (6, "mail a.b@c.de 4111111111111111", "é")]
    return spark.createDataFrame([] if empty else [(*r, "k", 1, "i", 2, "t", "l", 3) for r in rows], SCHEMA)


def model_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def classifier():
    return toxicity.fit(["you scum", "a nice day"] * 20, [1, 0] * 20)


RUNS = {
    "simhash": lambda d: simhash.near_duplicates(d),
    "linededup": lambda d: linededup.without_repeats(d),
    "pii": lambda d: pii.find(d, pii.fit(["call +1 (509) 555-6973"])),
    "piece_bpe": lambda d: piece_bpe.encode(d, model_path()),
    "lm": lambda d: lm.scores(d),
    "sharding": lambda d: sharding.shards(d, bins=3),
    "media": lambda d: media.text_media(d),
    "mixing": lambda d: mixing.amounts(d),
    "toxicity": lambda d: toxicity.scores(d, classifier()),
}


@pytest.mark.parametrize("name", RUNS)
def test_one_row_for_each(spark, name):
    assert RUNS[name](table(spark)).count() == 9


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](table(spark, empty=True)).collect() == []


def test_mix_and_clean_keep_columns(spark):
    docs = table(spark)
    for made in (mixing.mixed(docs), toxicity.clean(docs, classifier())):
        assert made.columns == docs.columns
        assert made.count() > 0
    assert mixing.mixed(table(spark, empty=True)).collect() == []
    assert set(docs.columns) <= set(linededup.without_repeats(docs).columns)


def test_null_and_strange_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (9, [1.0]), (10, []), (1, [1.0, 0.0])]
    got = sorted(map(tuple, embedjoin.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=str)
    want = [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, True), *[(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10)]]
    assert got == sorted(want, key=str)
    assert embedjoin.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
