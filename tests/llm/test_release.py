"""The driver lets go of ended steps within a block, not only at its end, and takes samples without boxed lists."""

from __future__ import annotations

from pyspark.sql import DataFrame

from canopy import storage
from canopy.llm import language


def test_steps_of_a_block_are_released(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(storage, "release", lambda *a, **k: calls.append(a))
    with storage.scratch(spark):
        storage.store(spark.range(3), "step")
        assert len(calls) == 1


def test_language_fit_takes_its_sample_as_arrow(spark, monkeypatch):
    def boxed(*_):
        raise AssertionError("the sample came as Python objects")

    docs = spark.createDataFrame([(i, ("the cat sat" if i % 2 else "le chat dort") + f" {i}", "en" if i % 2 else "fr") for i in range(40)], "doc_id long, text string, lang string")
    monkeypatch.setattr(DataFrame, "toPandas", boxed)
    model = language.fit(docs)
    assert language.predict_batch(["the cat", "le chat"], model)[0] == ["en", "fr"]
