import corpus_pipeline
from marlstone.llm import mixing, toxicity
from tests.llm.test_against_brute_force import plain_dedup
from tests.llm.test_simhash import plain
from tests.llm.brute import groups

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, tmp_path):
    docs = []
    for i in range(60):
        body = " ".join(f"word{(i * 7 + k) % 97}" for k in range(30 + i))
        if i % 6 == 0:
            body += " scum trash"
        docs.append((i, body if i % 5 else docs[i - 3][1] if i > 3 else body, "en", f"s{i % 4}", len(body)))
    spark.createDataFrame(docs, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int("scum" in t)) for i, t, *_ in docs], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return docs


def test_stages_against_plain_versions(spark, tmp_path):
    docs = tables(spark, tmp_path)
    sf = str(tmp_path)
    given = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "simhash near-dedup", "mixing", "sentencepiece"]
    tox, lines, near, mix, tokens = (f for _, f in corpus_pipeline.STAGES)

    model = toxicity.learn(given, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = tox(spark, given, sf)
    want = {i for (i, t, *_), s in zip(docs, model.scores([d[1] for d in docs], toxicity.Words())) if s < 0.5}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == given.columns

    cut = lines(spark, kept, sf)
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == plain_dedup([(i, t) for i, t, *_ in docs if i in want])

    rows = sorted((r["doc_id"], r["text"]) for r in cut.collect())
    prints = [plain(t, 4) for _, t in rows]
    roots = groups([i for i, _ in rows], lambda a, b: bin((prints[a] ^ prints[b]) % (1 << 64)).count("1") <= 4)
    one = near(spark, cut, sf)
    assert {r["doc_id"] for r in one.collect()} == set(roots) and one.columns == given.columns

    mixed = mix(spark, one, sf)
    assert mixed.columns == given.columns
    assert sum(len(r["text"].split()) for r in mixed.collect()) == sum(r["taken"] for r in mixing.amounts(one).collect())

    last = tokens(spark, mixed, sf).collect()
    assert sorted(r["text"] for r in last) == sorted(r["text"] for r in mixed.collect())
    assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in last)
