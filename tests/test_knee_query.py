from marlstone.plans import registry


def test_only_capped_lookups(spark, monkeypatch):
    for rows in ([(8, 5)], []):
        monkeypatch.setattr(registry, "log2_histogram", lambda w, rows=rows: spark.createDataFrame(rows, "bin int, n long"))
        got = registry.MADE["knee_g"](type("W", (), {"spark": spark})())
        assert [tuple(r) for r in got.collect()] == [(256, 0)]
